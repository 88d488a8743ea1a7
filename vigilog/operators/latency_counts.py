"""The rollup from counts of latencies, which late lines are added to without rereading earlier ones.

A row says how many lines, and how many errors, of a (service, endpoint, bucket) had a latency;
the latency is null for lines without one, the endpoint ``''`` for lines without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog import schemas
from vigilog.functions import text
from vigilog.functions.numbers import round_half_up
from vigilog.operators.rollup import MOST_VALUES, PERCENTILES, hot_keys, interpolated, order_statistics, rank_of, same_keys
from vigilog.sources.increments import Increments
from vigilog.sources.logs import with_bucket

_KEYS = ["service", "endpoint", "bucket_start"]


def count_latencies(lines: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    """Rows of ``schemas.LATENCIES`` for some lines."""
    return (
        with_bucket(lines, bucket_seconds)
        .groupBy("bucket_start", "service", F.coalesce("endpoint", F.lit("")).alias("endpoint"), "latency_ms")
        .agg(F.count(F.lit(1)).alias("requests"), F.count_if(text.is_error_level(F.col("level"))).alias("errors"))
    )


def merge_latencies(counts: DataFrame) -> DataFrame:
    """One row for each latency of a key."""
    return (
        counts.groupBy("bucket_start", "service", "endpoint", "latency_ms")
        .agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"))
        .select(*schemas.LATENCIES.names)
    )


def latency_table(path: str, every: int = 32) -> Increments:
    return Increments(path, schemas.LATENCIES, merge_latencies, every)


def _ends(n: Column) -> dict[str, Column]:
    """Positions of the values below and above each percentile."""
    found: dict[str, Column] = {}
    for name, p in PERCENTILES.items():
        found |= {f"_low_{name}": F.floor(rank_of(n, p)), f"_high_{name}": F.ceil(rank_of(n, p))}
    return found


def _by_window(cells: DataFrame) -> DataFrame:
    """The values at these positions by a running count over the latencies of each key."""
    key = Window.partitionBy(*_KEYS)
    running = key.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)
    timed = F.when(F.col("latency_ms").isNotNull(), F.col("requests")).otherwise(0)
    seen = cells.withColumn("_here", timed).withColumns({"_upto": F.sum("_here").over(running), "_n": F.sum("_here").over(key)})

    def at(position: Column) -> Column:
        holds = (F.col("_upto") > position) & (F.col("_upto") - F.col("_here") <= position)
        return F.max(F.when(holds, F.col("latency_ms")))

    return seen.groupBy(*_KEYS).agg(
        F.sum("requests").alias("request_count"), F.sum("errors").alias("error_count"), F.max("_n").alias("_n"),
        *[at(position).alias(name) for name, position in _ends(F.col("_n")).items()],
    )


def _by_selection(cells: DataFrame) -> DataFrame:
    """The same for keys with very many different latencies, none of which are ordered in one task."""
    found = order_statistics(cells, _KEYS, "latency_ms", _ends(F.col("_n")), many="requests")
    totals = cells.groupBy(*_KEYS).agg(F.sum("requests").alias("request_count"), F.sum("errors").alias("error_count"))
    return totals.join(found, same_keys(totals, found, _KEYS)).select(*[totals[c] for c in totals.columns], "_n", *_ends(F.col("_n")))


def rollup_of_counts(counts: DataFrame, most_values: int = MOST_VALUES) -> DataFrame:
    """The rows that :func:`vigilog.operators.rollup.rollup` gives for the lines that were counted.

    Keys with at most ``most_values`` different latencies take their positions from a running count,
    others by selection; both give the same values.
    """
    both = F.when(F.col("endpoint") != "", F.array(F.lit(""), F.col("endpoint"))).otherwise(F.array(F.lit("")))
    cells = merge_latencies(counts.withColumn("endpoint", F.explode(both)))
    hot = hot_keys(cells, _KEYS, "latency_ms", most_values)
    if hot is None:
        found = _by_window(cells)
    else:
        few = cells.join(hot, same_keys(cells, hot, _KEYS), "left_anti")
        many = cells.join(hot, same_keys(cells, hot, _KEYS), "left_semi")
        found = _by_window(few).unionByName(_by_selection(many))
    values = {name: interpolated(F.col(f"_low_{name}"), F.col(f"_high_{name}"), F.col("_n"), p) for name, p in PERCENTILES.items()}
    return found.select(
        "bucket_start", "service", "endpoint", "request_count", "error_count",
        *[F.coalesce(round_half_up(value), F.lit(0)).cast("long").alias(f"{name}_ms") for name, value in values.items()],
    )
