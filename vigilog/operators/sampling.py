"""Even and shape-diverse samples, and the caps that come before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_positions(rows: DataFrame, keys: list[str], order: list[Column], cell: str | None = None) -> DataFrame:
    """Add ``position`` (from 0) and ``total`` of each row among the rows of its key.

    Without ``cell`` a key's rows are sorted in one task, which suits bounded keys. With
    ``cell``, a column that never decreases along ``order`` (a day, a minute), rows are only
    sorted within their cell, and the cells' offsets come from their counts.
    """
    if cell is None:
        group = Window.partitionBy(*keys)
        return rows.withColumn("position", F.row_number().over(group.orderBy(*order)) - 1).withColumn(
            "total", F.count(F.lit(1)).over(group)
        )
    counts = rows.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
        "total", F.sum("_n").over(group)
    )
    inside = Window.partitionBy(*keys, cell).orderBy(*order)
    return (
        rows.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets.drop("_n"), [*keys, cell])
        .withColumn("position", F.col("_before") + F.col("_inside"))
        .drop("_inside", "_before")
    )


def picked_evenly(position: Column, total: Column, limit: Column) -> Column:
    """Whether a position is one of ``floor(i * total / limit)``, ``i < limit``.

    At most one ``i`` can hit a position, and it is one of two neighbours.
    """
    step = total.cast("double") / limit
    nearest = F.floor(position / step)

    def hits(i: Column) -> Column:
        return (i < limit) & (F.floor(i * step) == position)

    return (limit > 0) & ((total <= limit) | hits(nearest) | hits(nearest + 1))


def sample_evenly(rows: DataFrame, keys: list[str], order: list[Column], limit: int, cell: str | None = None) -> DataFrame:
    """``limit`` rows per key, evenly spaced along ``order``; all of them if there are no more."""
    placed = with_positions(rows, keys, order, cell)
    return placed.where(picked_evenly(F.col("position"), F.col("total"), F.lit(limit))).drop("position", "total")


def shape_quota(rows: DataFrame, keys: list[str], order: list[Column], shape: str, limit: Column | int) -> DataFrame:
    """How many rows each shape of a key may contribute to a sample of ``limit``.

    Shapes take turns, the rarest first (ties: first seen), one row per turn, until the
    limit is spent. Each shape lists at most ``limit`` turns and the first ``limit`` turns
    of the key count, so the rows themselves are not needed here, only their counts.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    sizes = rows.groupBy(*keys, shape).agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct(*order)).alias("_first"), F.first(limit).alias("_limit")
    )
    turns = sizes.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.least("size", "_limit"))))
    sequence = Window.partitionBy(*keys).orderBy("_turn", "size", "_first")
    return (
        turns.withColumn("_slot", F.row_number().over(sequence))
        .where(F.col("_slot") <= F.col("_limit"))
        .groupBy(*keys, shape)
        .agg(F.count(F.lit(1)).alias("take"))
    )


def sample_diverse(
    rows: DataFrame, keys: list[str], order: list[Column], shape: str, limit: Column | int, cell: str | None = None
) -> DataFrame:
    """``limit`` rows per key that keep rare shapes: quotas per shape, evenly spaced within.

    If a key has no more rows than the limit, every shape's quota is its size.
    """
    quota = shape_quota(rows, keys, order, shape, limit)
    chosen = rows.join(quota, [*keys, shape])
    placed = with_positions(chosen, [*keys, shape], order, cell)
    return placed.where(picked_evenly(F.col("position"), F.col("total"), F.col("take"))).drop(
        "position", "total", "take"
    )


def cap_rows(rows: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first rows per key. Spark keeps only that many per task before it shuffles."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= limit).drop("_rank")
