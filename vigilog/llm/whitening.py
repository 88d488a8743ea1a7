"""Whitening of vectors, with all covariances recovered from variances by polarisation.

Vectors are rounded to whole numbers x. The fit list holds each distinct x once: n vectors with sums
S. Tasks add up the exact squares of the centred values n * x - S for every dimension, and of their
sums for every pair of dimensions. As var(a + b) = var(a) + var(b) + 2 cov(a, b), these give the
whole covariance matrix without a product of two dimensions; it is exact until it is handed to
``eigh``. Only sums meet: d * (d + 1) / 2 numbers for vectors of size d, however many rows there are.

Vectors of different sizes are fitted apart. An axis without variance (a single vector, or fewer
directions than components) gives ``whitened`` 0 and ``explained`` 0, and then ``identity_error``
is 1, as no scaling gives it unit variance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm import common, exact

SCALE = 256
COMPONENTS = 4
#: Numbers in the models of all sizes of vectors, which go to the driver and to every task.
MOST_MODEL_NUMBERS = 1 << 22


@dataclass(frozen=True)
class Axes:
    """Model of the vectors of one size; ``directions`` has a row for each component."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float = 0.0

    def explained(self) -> np.ndarray:
        return self.variances / self.total if self.total else np.zeros(len(self.variances))


def finite(vector: str) -> Column:
    """Not null, and without null or non-finite entries."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.col(vector).isNotNull() & ~odd


def whole_numbers(rows: DataFrame, *keep: str, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The columns ``keep``, ``size`` and ``x`` = floor(scale * entry) of each finite vector.

    Vectors that are null or have null or non-finite entries are left out, and so are empty ones,
    as they have no component. What is beyond a long becomes the nearest long.
    """
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return rows.where(finite(vector) & (F.size(vector) > 0)).select(*keep, F.size(vector).alias("size"), x.alias("x"))


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as longs if these hold it and as Python integers if not."""
    if n * exact.largest(x) + max(map(abs, sums)) < exact.EXACT_LONG:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


_PARTIAL = "size int, place int, limb int, value bigint"


def _partial(totals: dict[int, list[int]]) -> pa.RecordBatch:
    found = [(size, *row) for size, sums in totals.items() for row in exact.limbs(sums)]
    columns = list(zip(*found, strict=True)) or [[]] * 4
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["size", "place", "limb", "value"]
    )


def _add(totals: dict[int, list[int]], size: int, sums: list[int]) -> None:
    before = totals.get(size)
    totals[size] = sums if before is None else [a + b for a, b in zip(before, sums, strict=True)]


def _sum_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per size: the sum of each dimension, and last the number of vectors."""
    totals: dict[int, list[int]] = {}
    for batch in batches:
        for size, _, x in exact.by_size(batch.column("size"), batch.column("x")):
            _add(totals, size, [*exact.column_sums(x), len(x)])
    yield _partial(totals)


def pair_place(i: int, j: int, size: int) -> int:
    """Where the sum for the dimensions i <= j stands: dimension i alone comes before its pairs."""
    return i * size - i * (i - 1) // 2 + j - i


def square_totals(y: np.ndarray) -> list[int]:
    """Sums of squares of each dimension and of each sum of two, as ``pair_place`` orders them."""
    out: list[int] = []
    for i in range(y.shape[1]):
        both = y[:, i:] + y[:, i : i + 1]
        both[:, 0] = y[:, i]
        out += exact.square_sums(both)
    return out


def covariance(totals: list[int], n: int, size: int) -> np.ndarray:
    """The covariance matrix of x from the exact sums of squares of n * x - S."""
    out = np.zeros((size, size))
    own = [totals[pair_place(i, i, size)] for i in range(size)]
    for i in range(size):
        out[i, i] = own[i] / n**3
        for j in range(i + 1, size):
            twice = totals[pair_place(i, j, size)] - own[i] - own[j]
            out[i, j] = out[j, i] = twice / (2 * n**3)
    return out


def principal(matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances, falling, and unit directions; what is rounding error of ``eigh`` counts as none."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:components]
    kept = values[order]
    kept[kept <= len(matrix) * np.finfo(float).eps * max(values.max(initial=0), 0)] = 0
    return kept, vectors[:, order].T


def _collect_sums(rows: DataFrame) -> dict[int, list[int]]:
    """Sums of each size; their number depends on the sizes of vectors alone."""
    added = rows.groupBy("size", "place", "limb").agg(F.sum("value").alias("value"))
    found: dict[int, list[tuple[int, int, int]]] = {}
    for size, place, limb, value in added.collect():
        found.setdefault(size, []).append((place, limb, value))
    return {size: exact.whole(parts, size + 1) for size, parts in found.items()}


def fit(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", scale: int = SCALE) -> dict[int, Axes]:
    """Axes for each size of vector, fitted on every distinct vector of whole numbers.

    No rows give no axes. More than ``MOST_MODEL_NUMBERS`` numbers in all models raise an error.
    """
    listed = common.stage(whole_numbers(rows, vector=vector, scale=scale).distinct())
    taken = listed.select("size").distinct().agg(F.sum(F.col("size").cast("long") * (components + 1))).first()[0]
    if (taken or 0) > MOST_MODEL_NUMBERS:
        raise ValueError(f"the models of all sizes of vectors have over {MOST_MODEL_NUMBERS} numbers")
    sums = _collect_sums(listed.mapInArrow(_sum_columns, _PARTIAL))

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for batch in batches:
            for size, _, x in exact.by_size(batch.column("size"), batch.column("x")):
                _add(totals, size, square_totals(_centred(x, sums[size][-1], sums[size][:-1])))
        yield _partial(totals)

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        size = key[0].as_py()
        parts = zip(*[rows[c].to_pylist() for c in ("place", "limb", "value")], strict=True)
        matrix = covariance(exact.whole(parts, size * (size + 1) // 2), sums[size][-1], size)
        variances, directions = principal(matrix, components)
        return pa.table(
            {
                "size": pa.array([size], pa.int32()),
                "total": pa.array([float(np.trace(matrix))]),
                "variances": pa.array([variances.tolist()], pa.list_(pa.float64())),
                "directions": pa.array([directions.reshape(-1).tolist()], pa.list_(pa.float64())),
            }
        )

    added = listed.mapInArrow(squares, _PARTIAL).groupBy("size", "place", "limb").agg(F.sum("value").alias("value"))
    solved = added.groupBy("size").applyInArrow(
        solve, "size int, total double, variances array<double>, directions array<double>"
    )
    axes = {
        size: Axes(n, total_sums, np.zeros((min(size, components), size)), np.zeros(min(size, components)), 0.0)
        for size, (*total_sums, n) in sums.items()
    }
    for row in solved.collect():
        directions = np.array(row.directions).reshape(-1, row["size"])
        before = axes[row["size"]]
        axes[row["size"]] = Axes(before.n, before.sums, directions, np.array(row.variances), row.total)
    return _with_errors(listed, axes, components)


def _with_errors(listed: DataFrame, axes: dict[int, Axes], components: int) -> dict[int, Axes]:
    """Measure the covariance of the whitened fit list; Spark's aggregates centre before they multiply."""
    seen = _project(listed, axes).select("size", F.transform("parts", lambda p: p["whitened"]).alias("w"))
    errors = []
    for i in range(components):
        for j in range(i, components):
            both = F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j)))
            errors.append(F.coalesce(F.abs(both - (1.0 if i == j else 0.0)), F.lit(0.0)))
    measured = seen.groupBy("size").agg(F.array_max(F.array(*errors)).alias("error")).collect()
    return {
        row["size"]: Axes(a.n, a.sums, a.directions, a.variances, a.total, row.error)
        for row in measured
        for a in [axes[row["size"]]]
    }


_PART = pa.struct(
    [("component", pa.int32()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
)
_FIELDS = [
    T.StructField("n", T.LongType()),
    T.StructField("deviation", T.DecimalType(38, 0)),
    T.StructField(
        "parts",
        T.ArrayType(
            T.StructType(
                [
                    T.StructField("component", T.IntegerType()),
                    T.StructField("whitened", T.DoubleType()),
                    T.StructField("explained", T.DoubleType()),
                    T.StructField("identity_error", T.DoubleType()),
                ]
            )
        ),
    ),
]


def _row_squares(y: np.ndarray) -> list[int] | np.ndarray:
    most = exact.largest(y)
    if y.dtype != object and most * most * y.shape[1] < 1 << 63:
        return np.einsum("ij,ij->i", y, y)
    y = y.astype(object)
    return (y * y).sum(axis=1).tolist()


def _project(rows: DataFrame, axes: dict[int, Axes]) -> DataFrame:
    """Append ``n``, ``deviation`` and ``parts`` to rows with ``size`` and ``x``."""

    def compute(_: object, sizes: pa.Array, lists: pa.Array) -> list[pa.Array]:
        n = np.zeros(len(sizes), np.int64)
        counts = np.zeros(len(sizes), np.int64)
        deviation: list = [None] * len(sizes)
        pieces: list[tuple[np.ndarray, np.ndarray, Axes]] = []
        for size, places, x in exact.by_size(sizes, lists):
            model = axes.get(size)
            if model is None:  # a size that was not fitted has no components
                continue
            y = _centred(x, model.n, model.sums)
            n[places], counts[places] = model.n, len(model.variances)
            for place, value in zip(places.tolist(), list(_row_squares(y)), strict=True):
                deviation[place] = Decimal(int(value)) if value < 10**38 else None
            scale = np.divide(1.0, np.sqrt(model.variances), out=np.zeros_like(model.variances), where=model.variances > 0)
            whitened = (y / model.n).astype(np.float64) @ (model.directions * scale[:, None]).T
            pieces.append((places, whitened, model))
        ends = np.concatenate(([0], np.cumsum(counts)))
        values = {name: np.zeros(ends[-1]) for name in ("whitened", "explained", "identity_error")}
        component = np.zeros(ends[-1], np.int32)
        for places, whitened, model in pieces:
            at = ends[places][:, None] + np.arange(whitened.shape[1])
            values["whitened"][at], values["explained"][at] = whitened, model.explained()
            values["identity_error"][at] = model.identity_error
            component[at] = np.arange(1, whitened.shape[1] + 1)
        flat = pa.StructArray.from_arrays(
            [pa.array(component), *[pa.array(v) for v in values.values()]], fields=list(_PART)
        )
        parts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        return [pa.array(n), pa.array(deviation, pa.decimal128(38, 0)), parts]

    return common.with_arrow_columns(rows, ["size", "x"], _FIELDS, compute)


def whiten(
    rows: DataFrame, axes: dict[int, Axes], key: str = "vec_id", vector: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """For each finite vector and component: key, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is the exact sum of squares of n * x - S (null beyond 38 digits), ``whitened`` the
    unrounded x - S / n along the component over its standard deviation. Rows are neither merged nor
    dropped for their key, be it null or repeated; other columns are left out.
    """
    found = _project(whole_numbers(rows, key, vector=vector, scale=scale), axes)
    return found.select(key, "n", "deviation", F.inline("parts"))
