"""Clusters around centroids, in whole numbers, with the nearest one found by a tournament of bisectors.

Between two centroids a and b the bisector is a plane: a vector x is nearer to b if
2 * x . (b - a) > |b|**2 - |a|**2. Normals and thresholds of all pairs are computed once a round.
Each vector then plays k - 1 sign tests: the winner so far, which always has the smaller number,
against the next centroid; zero keeps the winner, so ties go to the smaller number. Only the
distance to the last winner is computed. Tasks send sums by cluster, never vectors, so a group of
copies or a large cluster costs no more than other rows.

All arithmetic is exact: doubles where whole numbers below 2**53 suffice, Python integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm import common, exact
from vigilog.llm.whitening import finite

CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
DIMENSIONS = 64
SEED = 3


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * entry) as doubles where these are exact, as Python integers if some are not."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * scale)
    if not scaled.size or np.abs(scaled).max() < exact.EXACT_DOUBLE:
        return scaled
    # From 2**53 on an entry is a whole number itself.
    big = [int(c) * scale if abs(c) >= exact.EXACT_DOUBLE else int(np.floor(c * scale)) for c in vectors.reshape(-1).tolist()]
    return np.array(big, object).reshape(vectors.shape)


class Tournament:
    """Bisectors of all pairs of centroids."""

    def __init__(self, centroids: Sequence[Sequence[int]]) -> None:
        self.centroids = np.array([[int(c) for c in row] for row in centroids], object)
        k = len(self.centroids)
        lengths = [sum(c * c for c in row) for row in self.centroids.tolist()]
        # [a, b]: what b must beat to be nearer than a.
        self.normals = 2 * (self.centroids[None, :, :] - self.centroids[:, None, :])
        self.thresholds = np.array([[lengths[b] - lengths[a] for b in range(k)] for a in range(k)], object)
        self.most = max((abs(c) for row in self.centroids.tolist() for c in row), default=0)

    def _exact_doubles(self, x: np.ndarray) -> bool:
        reach = self.most + (exact.largest(x) if x.dtype != object else exact.EXACT_DOUBLE)
        return 4 * x.shape[1] * reach * reach < exact.EXACT_DOUBLE

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance to it, for each row."""
        kind = np.float64 if self._exact_doubles(x) else object
        rows = x if x.dtype == kind else self._integers(x)
        normals, thresholds = self.normals.astype(kind), self.thresholds.astype(kind)
        winner = np.zeros(len(rows), np.int64)
        for challenger in range(1, len(self.centroids)):
            side = (rows * normals[winner, challenger]).sum(axis=1) - thresholds[winner, challenger]
            winner[(side > 0).astype(bool)] = challenger
        apart = rows - self.centroids.astype(kind)[winner]
        return winner, (apart * apart).sum(axis=1)

    @staticmethod
    def _integers(x: np.ndarray) -> np.ndarray:
        return x if x.dtype == object else x.astype(np.int64).astype(object)


def _matrix(column: pa.Array, dimensions: int, scale: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions), scale)


def first_centroids(
    points: DataFrame, clusters: int, dimensions: int, scale: int, seed: int, key: str, vector: str
) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and key, fewer if there are fewer.

    Rows with one key come in the order of their vectors, rows without a key last.
    """
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    chosen = points.select(mark.alias("mark"), vector).orderBy(F.asc_nulls_last("mark"), vector).limit(clusters).collect()
    return [[int(c) for c in row] for row in whole(np.array([r[vector] for r in chosen]).reshape(-1, dimensions), scale).tolist()]


def _next_centroids(points: DataFrame, centroids: list[list[int]], vector: str, scale: int) -> list[list[int]]:
    """Floor of the mean of each cluster; a cluster without vectors keeps its centroid."""
    dimensions = len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        game = Tournament(centroids)
        totals = [[0] * (dimensions + 1) for _ in centroids]
        for batch in batches:
            x = _matrix(batch.column(0), dimensions, scale)
            winner, _ = game.nearest(x)
            x = x if x.dtype == object else x.astype(np.int64)
            for number in np.unique(winner).tolist():
                own = x[winner == number]
                added = [*exact.column_sums(own), len(own)]
                totals[number] = [a + b for a, b in zip(totals[number], added, strict=True)]
        flat = [total for row in totals for total in row]
        columns = list(zip(*exact.limbs(flat), strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64()), strict=True)],
            names=["place", "limb", "value"],
        )

    parts = points.select(vector).mapInArrow(sums, "place int, limb int, value bigint")
    added = parts.groupBy("place", "limb").agg(F.sum("value").alias("value")).collect()
    totals = exact.whole([tuple(r) for r in added], len(centroids) * (dimensions + 1))
    out = []
    for number, before in enumerate(centroids):
        *row, count = totals[number * (dimensions + 1) : (number + 1) * (dimensions + 1)]
        out.append([total // count for total in row] if count else before)
    return out


def _assigned(points: DataFrame, centroids: list[list[int]], vector: str, scale: int) -> DataFrame:
    """Replace the vectors by ``cluster`` and ``distance`` (null beyond 38 digits)."""
    dimensions = len(centroids[0])

    def compute(game: Tournament, column: pa.Array) -> list[pa.Array]:
        winner, distance = game.nearest(_matrix(column, dimensions, scale))
        if distance.dtype == object:
            kept = pa.array([d if d < 10**38 else None for d in distance.tolist()], pa.decimal128(38, 0))
        else:
            kept = pa.array(distance.astype(np.int64)).cast(pa.decimal128(38, 0))
        return [pa.array(winner.astype(np.int32)), kept]

    fields = [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DecimalType(38, 0))]
    found = common.with_arrow_columns(points, [vector], fields, compute, start=lambda: Tournament(centroids))
    return found.drop(vector)


_RESULT = (
    "cluster int, distance decimal(38,0), cluster_inertia decimal(38,0), inertia decimal(38,0), centroid array<string>"
)


def cluster(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """For each vector: key, cluster, distance, cluster_inertia, inertia and its centroid.

    Kept are vectors with exactly ``dimensions`` finite components, whatever their key; other
    columns are left out. Distances and their sums are exact (null beyond 38 digits); the centroid
    is given as decimal numbers. No vectors give no rows; fewer than ``clusters`` give as many clusters.
    """
    good = F.coalesce(finite(vector) & (F.size(vector) == dimensions), F.lit(False))
    points = common.stage(rows.where(good).select(key, F.col(vector).cast("array<double>").alias(vector)))
    centroids = first_centroids(points, clusters, dimensions, scale, seed, key, vector)
    if not centroids:
        kind = rows.schema[key].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"`{key}` {kind}, {_RESULT}")
    for _ in range(rounds):
        centroids = _next_centroids(points, centroids, vector, scale)
    assigned = common.stage(_assigned(points, centroids, vector, scale))
    # At most one row for each cluster.
    sums = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.try_sum("distance").alias("total")).collect()}
    total = None if None in sums.values() else sum(int(own) for own in sums.values())
    total = None if total is None or total >= 10**38 else Decimal(total)
    ends = [(number, own, total, [str(c) for c in centroids[number]]) for number, own in sums.items()]
    kinds = "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid array<string>"
    by_cluster = rows.sparkSession.createDataFrame(ends, kinds)
    return assigned.join(F.broadcast(by_cluster), "cluster").select(
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )
