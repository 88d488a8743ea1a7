"""Rollup of log lines per service, endpoint and time bucket, and what is read from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.functions import text, times
from vigilog.functions.numbers import round_half_up
from vigilog.sources.logs import with_bucket
from vigilog.sources.staging import staged

#: Days listed one by one in a filter.
MOST_DAYS = 1000

PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


#: Values of a key up to which they are sorted as one array; larger keys are searched by cells.
MOST_VALUES = 1 << 18
#: Cells that a search splits a range of values into at each step.
CELLS = 4096


def interpolated(low: Column, high: Column, n: Column, p: float) -> Column:
    """Linear interpolation between the values below and above the position of a percentile."""
    rank = rank_of(n, p)
    return low + (high - low) * (rank - F.floor(rank))


def rank_of(n: Column, p: float) -> Column:
    """Fractional position of a percentile among ``n`` sorted values, from 0."""
    return (n - 1) * F.lit(min(max(p, 0.0), 1.0))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys; null is a key like others."""
    return reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in keys])


def hot_keys(values: DataFrame, keys: list[str], value: str, most_values: int) -> DataFrame | None:
    """The keys with more values than may be sorted as one array, None if there are none."""
    counts = values.groupBy(*keys).agg(F.count(value).alias("_n")).where(F.col("_n") > most_values)
    return None if counts.isEmpty() else staged(counts)


def percentile_of(values: Column, p: float) -> Column:
    """Percentile of a sorted array without nulls; null if it is empty."""
    rank = rank_of(F.size(values), p)
    low, high = (F.get(values, place.cast("int")) for place in (F.floor(rank), F.ceil(rank)))
    return interpolated(low, high, F.size(values), p)


def _by_arrays(values: DataFrame, keys: list[str], value: str, percentiles: dict[str, float], sums: list[Column]) -> DataFrame:
    """Percentiles from one sorted array a key."""
    held = values.groupBy(*keys).agg(*sums, F.sort_array(F.collect_list(value)).alias("_v"))
    found = [percentile_of(F.col("_v"), p).alias(name) for name, p in percentiles.items()]
    return held.select("*", *found).drop("_v")


def _cell(value: Column, low: Column, high: Column, first: bool) -> Column:
    """A cell number that never falls as the value rises; infinities and NaN have cells of their own.

    The first step goes by sign and magnitude, as a radix of the exponent would, so that one value
    far out does not put all others into one cell. Later steps cut a range evenly.
    """
    if first:
        value, low, high = (F.signum(v) * F.log1p(F.abs(v)) for v in (value, low, high))
    even = F.floor((value - low) / F.nullif(high - low, F.lit(0.0)) * CELLS)
    infinite = F.abs(value) == float("inf")
    return (
        F.when(F.isnan(value), CELLS + 2)
        .when(infinite, F.when(value > 0, CELLS + 1).otherwise(-1))
        .otherwise(F.least(F.coalesce(even, F.lit(0)), F.lit(CELLS)))
    )


def order_statistics(
    values: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], many: str | None = None
) -> DataFrame:
    """The values at given positions (from 0, in terms of ``_n``, the key's count) by selection.

    A row stands for as many values as the column ``many`` says, without it for one.

    Equal values are counted. Then the range that holds a wanted position is cut into cells, the
    cells are counted, and only the one with the position is cut again, until it holds one value.
    A step orders at most ``CELLS`` counts of a key, never its values, and its counting combines in
    the tasks, so one key may hold all rows. Each step narrows a range at least 4096-fold.
    """
    counted = staged(values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_value")).agg((F.count("*") if many is None else F.sum(many)).alias("_many")))
    finite = F.when(~F.isnan("_value") & (F.abs("_value") != float("inf")), F.col("_value"))
    spans = counted.groupBy(*keys).agg(
        F.sum("_many").alias("_n"), F.min(finite).alias("_low"), F.max(finite).alias("_high")
    )
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
    # The first range has all values, infinities too, whatever its finite ends.
    open_ = staged(
        spans.select(*keys, "_n", "_low", "_high", F.lit(0).cast("long").alias("_below"), wanted.alias("_w"))
        .select(*keys, "_n", "_low", "_high", "_below", "_w.name", "_w.rank")
    )
    done: list[DataFrame] = []
    first = True
    while not open_.isEmpty():
        inside = F.lit(True) if first else F.col("_value").between(F.col("_low"), F.col("_high"))
        target = open_.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in open_.columns if c not in keys])
        match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        cells = (
            counted.join(target, match)
            .where(inside)
            .groupBy(*keys, "name", "rank", "_n", "_below", _cell(F.col("_value"), F.col("_low"), F.col("_high"), first).alias("_cell"))
            .agg(F.sum("_many").alias("_here"), F.min("_value").alias("_low"), F.max("_value").alias("_high"))
        )
        upto = Window.partitionBy(*keys, "name").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        picked = staged(
            cells.withColumn("_upto", F.col("_below") + F.sum("_here").over(upto))
            .where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("_here") <= F.col("rank")))
            .withColumn("_below", F.col("_upto") - F.col("_here"))
            .select(*keys, "_n", "_low", "_high", "_below", "name", "rank")
        )
        done.append(picked.where("_low = _high"))
        open_ = picked.where("_low <> _high")
        first = False
    every = reduce(DataFrame.unionByName, done) if done else open_
    return every.groupBy(*keys).agg(
        F.max("_n").alias("_n"), *[F.max(F.when(F.col("name") == name, F.col("_low"))).alias(name) for name in ranks]
    )


def _by_cells(values: DataFrame, keys: list[str], value: str, percentiles: dict[str, float], sums: list[Column]) -> DataFrame:
    """Percentiles of hot keys, which have at least one value."""
    ranks: dict[str, Column] = {}
    for name, p in percentiles.items():
        rank = rank_of(F.col("_n"), p)
        ranks |= {f"_low_{name}": F.floor(rank), f"_high_{name}": F.ceil(rank)}
    found = order_statistics(values, keys, value, ranks)
    picked = found.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[interpolated(F.col(f"_low_{n}"), F.col(f"_high_{n}"), F.col("_n"), p).alias(n) for n, p in percentiles.items()],
    )
    if not sums:
        return picked.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *percentiles)
    match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    totals = values.groupBy(*keys).agg(*sums)
    return totals.join(picked, match).drop(*[f"_k{i}" for i in range(len(keys))])


def percentiles_with(
    values: DataFrame, keys: list[str], value: str, percentiles: dict[str, float], sums: list[Column], most_values: int = MOST_VALUES
) -> DataFrame:
    """Per key the aggregates ``sums`` and exact, linearly interpolated percentiles (null without values).

    Keys with at most ``most_values`` values sort them as one array of bounded size; what is beyond
    goes through :func:`order_statistics`. Both give the same values.
    """
    hot = hot_keys(values, keys, value, most_values)
    if hot is None:
        return _by_arrays(values, keys, value, percentiles, sums)
    few = values.join(hot, same_keys(values, hot, keys), "left_anti")
    many = values.join(hot, same_keys(values, hot, keys), "left_semi")
    rest = _by_arrays(few, keys, value, percentiles, sums)
    return rest.unionByName(_by_cells(many, keys, value, percentiles, sums))


def grouped_percentiles(
    values: DataFrame, keys: list[str], value: str, percentiles: dict[str, float], most_values: int = MOST_VALUES
) -> DataFrame:
    """Exact, linearly interpolated percentiles per key; 0 for a key without values."""
    found = percentiles_with(values, keys, value, percentiles, [], most_values)
    return found.select(*keys, *[F.coalesce(F.col(name), F.lit(0.0)).alias(name) for name in percentiles])


def rollup(lines: DataFrame, bucket_seconds: int = 60, most_values: int = MOST_VALUES) -> DataFrame:
    """Counts and latency percentiles per (service, bucket) and (service, endpoint, bucket).

    The service-wide rows have endpoint ``''``. Lines without an endpoint count only in the
    service-wide row; lines without a latency only in the counts.
    """
    named = F.coalesce(F.col("endpoint"), F.lit("")) != ""
    both = with_bucket(lines, bucket_seconds).select(
        "service", "bucket_start", "level", "latency_ms",
        F.explode(F.when(named, F.array(F.lit(""), F.col("endpoint"))).otherwise(F.array(F.lit("")))).alias("endpoint"),
    )
    sums = [
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(text.is_error_level(F.col("level"))).alias("error_count"),
    ]
    totals = percentiles_with(both, ["service", "endpoint", "bucket_start"], "latency_ms", PERCENTILES, sums, most_values)
    return totals.select(
        "bucket_start", "service", "endpoint", "request_count", "error_count",
        *[F.coalesce(round_half_up(F.col(name)), F.lit(0)).cast("long").alias(f"{name}_ms") for name in PERCENTILES],
    )


def lines_of_dirty(lines: DataFrame, dirty: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    """All lines of the dirty (service, bucket) keys.

    The days of a table by day are put in as literals, so that only they are scanned.
    """
    keys = dirty.select("service", "bucket_start").distinct()
    bucketed = with_bucket(lines, bucket_seconds)
    if "dt" in lines.columns:
        bucketed = bucketed.where(on_days(dirty))
        bucketed = bucketed.join(
            keys.withColumn("dt", F.to_date("bucket_start")), ["dt", "service", "bucket_start"], "left_semi"
        )
    else:
        bucketed = bucketed.join(keys, ["service", "bucket_start"], "left_semi")
    return bucketed.drop("bucket_start")


def rollup_dirty(lines: DataFrame, dirty: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    """Recompute the dirty (service, bucket) keys from all of their lines.

    Lateness is unbounded, so late lines are never dropped: they make their bucket dirty.
    """
    return rollup(lines_of_dirty(lines, dirty, bucket_seconds), bucket_seconds)


def on_days(dirty: DataFrame) -> Column:
    """Whether ``dt`` is a day of a dirty bucket, as a list of days that prunes partitions.

    Beyond some years' days the first and the last bound a range instead, which prunes less.
    """
    days = dirty.select(F.to_date("bucket_start").alias("dt")).where("dt IS NOT NULL").distinct()
    few = [row.dt for row in days.limit(MOST_DAYS + 1).collect()]
    if len(few) <= MOST_DAYS:
        return F.col("dt").isin(few) if few else F.lit(False)
    first, last = days.agg(F.min("dt"), F.max("dt")).first()
    return F.col("dt").between(F.lit(first), F.lit(last))


def dirty_buckets(new_lines: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    return with_bucket(new_lines, bucket_seconds).select("service", "bucket_start").distinct()


def coalesce_runs(dirty: DataFrame, before: Column | None = None, bucket_seconds: int = 60) -> DataFrame:
    """Distinct dirty buckets as contiguous half-open runs per service."""
    buckets = dirty.select("service", "bucket_start").distinct()
    if before is not None:
        buckets = buckets.where(F.col("bucket_start") < before)
    at = times.seconds_of(F.col("bucket_start"))
    by_time = Window.partitionBy("service").orderBy("bucket_start")
    return (
        buckets.withColumn("_island", at - F.row_number().over(by_time) * bucket_seconds)
        .groupBy("service", "_island")
        .agg(
            F.min("bucket_start").alias("run_start"),
            times.shift(F.max("bucket_start"), bucket_seconds).alias("run_end"),
        )
        .drop("_island")
    )


def bucket_grid(ranges: DataFrame, rollup_rows: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    """Every bucket of each range: 0 counts where nothing happened, latency NULL without requests.

    ``ranges`` has ``service, range_start, range_end`` and any identifying columns.
    """
    width = F.expr(f"INTERVAL {bucket_seconds} SECONDS")
    first = times.floor_to_bucket(F.col("range_start"), bucket_seconds)
    last = times.floor_to_bucket(F.timestamp_micros(F.unix_micros("range_end") - 1), bucket_seconds)
    spine = ranges.where(first <= last).withColumn("bucket_start", F.explode(F.sequence(first, last, width)))
    wide = rollup_rows.where(F.col("endpoint") == "").select(
        "service", "bucket_start", "request_count", "error_count", "p95_ms"
    )
    return spine.join(wide, ["service", "bucket_start"], "left").select(
        *ranges.columns, "bucket_start",
        F.coalesce("request_count", F.lit(0)).cast("long").alias("requests"),
        F.coalesce("error_count", F.lit(0)).cast("long").alias("errors"),
        F.when(F.col("request_count") > 0, F.col("p95_ms")).alias("p95"),
    )
