from collections import defaultdict

import numpy as np

from vigilog.llm import neighbours


def brute(rows, queries, k):
    """Exact nearest by inner product in double precision."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and usable(v)}
    found = {}
    for i, v in queries:
        if i is None or not usable(v):
            continue
        near = [(-float((np.array(v) * np.array(w)).sum()), j) for j, w in good if j != i and len(w) == len(v)]
        found[i] = [(j, -s) for s, j in sorted(near)[:k]]
    return found


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def run(spark, rows, queries, k, **more):
    schema = "vec_id long, embedding array<double>, score string"
    index = neighbours.build_index(spark.createDataFrame([(*r, "x") for r in rows], schema), k, **more)
    found = neighbours.search(index, spark.createDataFrame([(*r, "x") for r in queries], schema), k)
    out = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_and_order(spark):
    random = np.random.default_rng(0)
    centres = random.normal(0, 1, (20, 16))
    data = centres[random.integers(20, size=3000)] + random.normal(0, 0.4, (3000, 16))
    data *= random.uniform(0.2, 3, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    queries = rows[::20]
    found, exact = run(spark, rows, queries, 20, shard_points=1200), brute(rows, queries, 20)
    hits = sum(len({j for j, _ in found[i]} & {j for j, _ in near}) for i, near in exact.items())
    assert hits / (20 * len(exact)) > 0.95
    for near in found.values():
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and len(near) == 20


def test_small_tables_are_exact_with_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)]
    rows += [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 1.0]),
             (104, [inf, 1.0, 1.0]), (None, [9.0, 9.0, 9.0]), (5, rows[5][1]), (105, [1.0, 2.0]), (106, [3.0, 1.0]), (107, [])]
    queries = [r for r in rows if r[0] is None or r[0] % 5 == 0]
    assert dict(run(spark, rows, queries, 4)) == brute(rows, queries, 4)
    # More asked for than there are.
    few = run(spark, rows[:6], rows[:2], 20)
    assert {i: len(near) for i, near in few.items()} == {0: 5, 1: 5}


def test_a_large_group_of_copies(spark):
    same = [1.0, 0.5]
    rows = [(i, same) for i in range(1000)] + [(2000, [0.1, 0.1]), (2001, [2.0, 2.0])]
    found = run(spark, rows, [(0, same), (7, same)], 5)
    assert [j for j, _ in found[0]] == [2001, 1, 2, 3, 4]
    assert [j for j, _ in found[7]] == [2001, 0, 1, 2, 3]


def test_empty_tables(spark):
    assert run(spark, [], [], 5) == {}
    assert run(spark, [(1, [1.0])], [], 5) == {}
    assert run(spark, [], [(1, [1.0])], 5) == {}


def test_query_recall(spark):
    from vigilog.llm.queries import QUERIES

    found = QUERIES["op9_neighbours"](spark, "/root/testdata/sf0.01").collect()
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding) for r in rows]
    exact = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = {(r.query_id, r.vec_id): r.score for r in found}
    wanted = {(i, j): s for i, near in exact.items() for j, s in near}
    assert len(got) == len(wanted) and len(got.keys() & wanted.keys()) / len(wanted) > 0.95
    assert all(abs(got[x] - wanted[x]) < 1e-12 for x in got.keys() & wanted.keys())
