import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from vigilog.llm import centroids

NAN, INF = float("nan"), float("inf")


def brute(rows, k=8, rounds=10, d=64):
    good = [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    xs = [[int(c) * 1024 if abs(c) >= 1e300 else math.floor(1024 * c) for c in v] for _, v in good]
    marks = [(i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in good]
    first = sorted(range(len(good)), key=lambda p: marks[p])[:k]
    centres = [xs[p] for p in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for x in xs:
            groups[nearest(x)[1]].append(x)
        centres = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if groups[j] else c for j, c in enumerate(centres)]
    last = [nearest(x) for x in xs]
    total, own = sum(dist for dist, _ in last), defaultdict(int)
    for dist, j in last:
        own[j] += dist
    return sorted((repr(i), j, dist, own[j], total, [str(c) for c in centres[j]]) for (i, _), (dist, j) in zip(good, last))


def run(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    found = centroids.cluster(frame, **more).collect()
    whole = lambda v: None if v is None else int(v)
    return sorted((repr(r.vec_id), r.cluster, whole(r.distance), whole(r.cluster_inertia), whole(r.inertia), list(r.centroid)) for r in found)


def test_matches_brute_force_with_odd_rows(spark):
    random = np.random.default_rng(5)
    rows = list(enumerate((random.normal(0, 0.1, (200, 64)) + random.normal(0, 0.2, (10, 64))[random.integers(10, size=200)]).tolist()))
    rows += [(500 + i, rows[0][1]) for i in range(80)]  # a large group of copies
    rows += [(None, rows[5][1]), (None, rows[9][1]), (3, rows[7][1]), (3, rows[3][1])]
    rows += [(900, None), (901, [1.0] * 63), (902, [NAN] + [0.0] * 63), (903, [-INF] + [0.0] * 63), (904, [None] + [0.0] * 63), (905, [])]
    assert run(spark, rows) == brute(rows)


def test_ties_and_empty_clusters(spark):
    # Whole numbers on a line: many vectors are as near to one centroid as to another.
    rows = [(i, [float(i % 9) / 1024, 0.0]) for i in range(60)]
    assert run(spark, rows, dimensions=2, rounds=3) == brute(rows, rounds=3, d=2)
    same = [(i, [0.5, 0.25]) for i in range(20)]
    found = run(spark, same, dimensions=2)
    assert found == brute(same, d=2) and {r[1] for r in found} == {0}


def test_few_or_no_rows(spark):
    rows = [(1, [0.0] * 64), (2, [1.0] * 64), (3, [-0.0001] * 64)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []


@pytest.mark.parametrize("scale", [1e9, 1e15, 1e30])
def test_large_values_stay_exact(spark, scale):
    random = np.random.default_rng(6)
    rows = list(enumerate((random.normal(0, 1, (30, 2)) * scale).tolist()))
    wanted = brute(rows, k=3, rounds=4, d=2)
    fits = lambda v: v if v < 10**38 else None
    wanted = sorted((i, j, fits(a), fits(b), fits(c), s) for i, j, a, b, c, s in wanted)
    assert sorted(run(spark, rows, clusters=3, rounds=4, dimensions=2), key=str) == sorted(wanted, key=str)


def test_tournament_is_the_nearest_with_the_smaller_number():
    random = np.random.default_rng(7)
    centres = random.integers(-4, 5, (8, 3)).tolist()
    x = random.integers(-6, 7, (500, 3)).astype(float)
    winner, distance = centroids.Tournament(centres).nearest(x)
    for row, j, dist in zip(x.tolist(), winner.tolist(), distance.tolist()):
        assert (dist, j) == min((sum((a - b) ** 2 for a, b in zip(row, c)), n) for n, c in enumerate(centres))
