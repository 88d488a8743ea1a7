from fractions import Fraction

import numpy as np
import pytest

from vigilog.llm import exact, whitening

NAN, INF = float("nan"), float("inf")


def brute(rows):
    """Exact sums over the fit list, for vectors of one size."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    xs = {i: tuple(int(np.floor(256 * c)) for c in v) for i, v in enumerate(v for _, v in good)}
    fit = sorted(set(xs.values()))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    cov = [[Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit), n**3) for b in range(d)] for a in range(d)]
    return good, xs, n, sums, np.array([[float(c) for c in row] for row in cov])


def run(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, n string")
    return whitening.whiten(frame, whitening.fit(frame, **more)).collect()


def data(n=300, d=6, seed=1):
    random = np.random.default_rng(seed)
    return (random.normal(0, 1, (n, d)) @ random.normal(0, 1, (d, d)) * 3 + 50).tolist()


def test_matches_exact_covariance(spark):
    rows = list(enumerate(data()))
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # copies count once in the fit
    rows += [(None, [51.0] * 6), (7, rows[3][1]), (7, rows[4][1])]
    rows += [(2000, None), (2001, [NAN] + [1.0] * 5), (2002, [INF] + [1.0] * 5), (2003, [None] + [1.0] * 5)]
    good, xs, n, sums, cov = brute(rows)
    found = run(spark, rows)
    assert len(found) == 4 * len(good)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    wanted = sorted(
        (str(i), sum((n * c - s) ** 2 for c, s in zip(xs[p], sums)), tuple(xs[p])) for p, (i, _) in enumerate(good)
    )
    assert sorted((str(r.vec_id), int(r.deviation)) for r in found if r.component == 1) == [w[:2] for w in wanted]
    by_key = {r.vec_id: [q for q in found if q.vec_id == r.vec_id] for r in found if r.vec_id not in (None, 7)}
    signs = {}
    for p, (i, _) in enumerate(good):
        if i not in by_key:
            continue
        for r in by_key[i]:
            k = r.component - 1
            mine = (np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(xs[p], sums)]) @ vectors[:, k]) / np.sqrt(values[k])
            if abs(mine) > 1e-6:
                signs.setdefault(k, np.sign(mine * r.whitened))
                assert abs(r.whitened - signs[k] * mine) < 1e-8
            assert abs(r.explained / (values[k] / values.sum()) - 1) < 1e-9
            assert r.n == n and r.identity_error < 1e-9


def test_few_or_equal_vectors_and_other_sizes(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, []), (4, [1.0, 0.0, 0.0]), (5, [2.0, 0.0, 0.0]), (6, [4.0, 0.0, 0.0])]
    found = {(r.vec_id, r.component): r for r in run(spark, rows)}
    assert set(found) == {(i, c) for i in (1, 2) for c in (1, 2)} | {(i, c) for i in (4, 5, 6) for c in (1, 2, 3)}
    same = found[1, 1]
    assert (same.n, int(same.deviation), same.whitened, same.explained, same.identity_error) == (1, 0, 0.0, 0.0, 1.0)
    line = [found[i, 1].whitened for i in (4, 5, 6)]
    assert np.allclose(np.cov(line, bias=True), 1) and found[4, 1].explained == pytest.approx(1)
    assert found[4, 2].whitened == 0.0 and found[4, 2].explained == 0.0


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [])]) == []


def test_large_values_stay_exact(spark):
    rows = [(i, [1e13 * (i % 5) + 0.125 * i, 3.0 * i]) for i in range(40)]
    good, xs, n, sums, cov = brute(rows)
    found = {r.vec_id: r for r in run(spark, rows) if r.component == 1}
    assert {i: int(r.deviation) for i, r in found.items()} == {
        i: sum((n * c - s) ** 2 for c, s in zip(xs[p], sums)) for p, (i, _) in enumerate(good)
    }


@pytest.mark.parametrize("most", [3, 1 << 20, 1 << 40, 1 << 60])
def test_sums_of_squares(most):
    x = np.random.default_rng(3).integers(-most, most, (500, 5))
    wanted = [sum(v * v for v in column) for column in x.T.tolist()]
    assert exact.square_sums(x) == wanted == exact.square_sums(x.astype(object))
    assert exact.column_sums(x) == [sum(c) for c in x.T.tolist()]
    signed = [*wanted, -wanted[0], -1, 0, 1 << 200, -(1 << 200)]
    assert exact.whole(exact.limbs(signed), len(signed)) == signed


def test_polarisation_equals_products():
    y = np.random.default_rng(4).integers(-1000, 1000, (200, 7))
    n = 200
    wanted = (y.T @ y) / n**3
    assert np.allclose(whitening.covariance(whitening.square_totals(y), n, 7), wanted, rtol=1e-15)


def test_query_over_the_table(spark):
    from vigilog.llm.queries import QUERIES

    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()]
    good, xs, n, sums, cov = brute(rows)
    found = QUERIES["op11_whitening"](spark, path).collect()
    values = np.linalg.eigvalsh(cov)[::-1]
    assert len(found) == 4 * len(good)
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(xs[p], sums)) for p, (i, _) in enumerate(good)}
    for r in found:
        assert r.deviation == deviation[r.vec_id] and r.n == n and r.identity_error < 1e-9
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
    for c in (1, 2, 3, 4):
        whitened = np.array([r.whitened for r in found if r.component == c])
        assert abs(whitened.mean()) < 1e-9 and abs(whitened.var() - 1) < 1e-9
