import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from vigilog.llm import common, mixing


def best_sum(lengths, counts, goal):
    sums = {0}
    for n, c in zip(lengths, counts, strict=True):
        sums = {s + n * k for s in sums for k in range(c + 1)}
    return min(sums, key=lambda s: (abs(s - goal), s))


@pytest.mark.parametrize("seed", range(30))
def test_fit_is_the_best_subset_sum(seed):
    rng = random.Random(seed)
    lengths = rng.sample(range(1, 60), 6)
    counts = [rng.randrange(1, 8) for _ in lengths]
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    goal = rng.randrange(total + 1)
    picks = mixing.fit(lengths, counts, goal)
    assert all(0 <= p <= c for p, c in zip(picks, counts, strict=True))
    assert sum(n * p for n, p in zip(lengths, picks, strict=True)) == best_sum(lengths, counts, goal)


def test_fit_of_many_documents_is_exact_and_proportional():
    rng = random.Random(1)
    counts = Counter(int(rng.lognormvariate(5, 1)) for _ in range(50_000))
    lengths = sorted(counts)
    total = sum(n * c for n, c in counts.items())
    picks = mixing.fit(lengths, [counts[n] for n in lengths], total // 3)
    assert sum(n * p for n, p in zip(lengths, picks, strict=True)) == total // 3
    often = [(p, counts[n]) for n, p in zip(lengths, picks, strict=True) if counts[n] > 300]
    assert all(abs(p / c - 1 / 3) < 0.01 for p, c in often)


def test_fit_extremes():
    assert mixing.fit([0, 5], [3, 2], 0) == [0, 0]
    assert mixing.fit([0, 5], [3, 2], 10) == [3, 2]
    assert mixing.fit([], [], 0) == []
    assert mixing.fit([10_000_000, 3], [2, 1], 10_000_003) == [1, 1]


def test_targets_share_by_weight_and_stop_at_thrice():
    assert mixing.targets([("b", 10), ("a", 10), (None, 10)]) == {"a": 5, "b": 10, None: 15}
    found = mixing.targets([("a", 100), ("b", 1), ("c", 10), ("d", 5)])
    assert found["b"] == 3 and found["c"] == 30
    assert sum(found.values()) == pytest.approx(116)
    assert mixing.targets([("é", 5), ("z", 5)]) == {"z": pytest.approx(10 / 3), "é": pytest.approx(20 / 3)}
    assert mixing.targets([("a", 0), (None, 0)]) == {"a": 0, None: 0}
    assert mixing.targets([]) == {}


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, TAKEN int")
    sized = common.stage(docs.withColumn("size", mixing.words("text")))
    return mixing.mix(sized)


def test_mix_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, "big", "w " * rng.randrange(1, 40), 1) for i in range(400)]
    rows += [(1000 + i, "copies", "same words here", 1) for i in range(300)]
    rows += [(None, None, "a b", 1), (7, None, None, 1), (7, None, None, 1), (8, "", "\x0b \t", None)]
    rows += [(9, "é", "x y z", 2), (9, "é", "x y z", 2), (10, "long", "q " * 200_000, 3)]
    found = run(spark, rows).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[1]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[2] or ""))
    goal = mixing.targets(list(sizes.items()))
    taken = defaultdict(int)
    for r in found:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.source_size == sizes[r.source] and r.target == goal[r.source]
        assert r.taken == r["size"] * r.repeats and 0 <= r.repeats <= 3
        taken[r.source] += r.taken
    for name, words in taken.items():
        shortest = min((r["size"] for r in found if r.source == name and r["size"]), default=0)
        assert abs(int(goal[name] + 0.5) - words) < max(1, shortest)
    again = run(spark, rows[::-1]).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.taken)
    assert sorted(map(key, again)) == sorted(map(key, found))


def test_mix_of_nothing(spark):
    assert run(spark, []).count() == 0


def test_query(spark):
    from vigilog.llm.queries import QUERIES

    found = QUERIES["op2_mixing"](spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    size = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in docs}
    source = {d.doc_id: d.source for d in docs}
    assert {r.doc_id: r["size"] for r in found} == size
    total = Counter()
    for k, n in size.items():
        total[source[k]] += n
    goal = mixing.targets(list(total.items()))
    found.sort(key=lambda r: source[r.doc_id])
    for name, rows in itertools.groupby(found, key=lambda r: source[r.doc_id]):
        rows = list(rows)
        assert abs(sum(r.taken for r in rows) - goal[name]) <= min(r["size"] for r in rows)
        assert all(r.taken <= 3 * r["size"] for r in rows)
