"""Sliding windows and their trailing baselines over the service-wide rollup."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.config import DetectionConfig
from vigilog.functions import times
from vigilog.functions.numbers import exact_square, mean_of, sample_sd


def chunk_seconds(config: DetectionConfig) -> int:
    """Length of the time chunks that frames are evaluated in: a few times the reach."""
    return 4 * config.reach_seconds


def spread_over_chunks(rows: DataFrame, at: Column, config: DetectionConfig) -> DataFrame:
    """Copy each row into every time chunk whose frames can see it.

    Frames are then partitioned by (key, chunk), so that a long history of one service is
    evaluated by many tasks. ``_owned`` marks the copy that yields an output row.
    """
    length = chunk_seconds(config)
    own = F.floor(at / length)
    last = F.floor((at + config.reach_seconds) / length)
    return rows.withColumn("_chunk", F.explode(F.sequence(own, last))).withColumn("_owned", F.col("_chunk") == own)


def _frame_columns(in_window, in_baseline) -> dict[str, Column]:
    """Statistics of one end point; the arguments turn an aggregate into a frame's aggregate."""
    errors, p95 = F.col("error_count"), F.col("p95_ms")
    return {
        "window_rows": in_window(F.count, F.lit(1)),
        "request_count": in_window(F.sum, F.col("request_count")),
        "error_count": in_window(F.sum, errors),
        "p95_total": in_window(F.sum, p95),
        "p99_total": in_window(F.sum, F.col("p99_ms")),
        "baseline_buckets": in_baseline(F.count, F.lit(1)),
        "baseline_errors": in_baseline(F.sum, errors),
        "baseline_squares": in_baseline(F.sum, exact_square(errors)),
        "baseline_p95": in_baseline(lambda c: F.percentile(c, 0.5), p95),
    }


def _statistics(raw: DataFrame) -> DataFrame:
    """Rates, means and deviations from the raw sums of the frames.

    Buckets without traffic have no row and are not filled with zeros: a rate divides by
    the buckets present.
    """
    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    buckets = F.greatest(zero("window_rows"), F.lit(1)).cast("long")
    count = zero("baseline_buckets")
    return raw.select(
        "service",
        "window_start",
        "window_end",
        buckets.alias("window_buckets"),
        zero("request_count").cast("long").alias("request_count"),
        zero("error_count").cast("long").alias("error_count"),
        mean_of(zero("p95_total"), zero("window_rows")).alias("window_p95"),
        mean_of(zero("p99_total"), zero("window_rows")).alias("window_p99"),
        (zero("error_count").cast("double") / buckets).alias("error_rate"),
        count.cast("long").alias("baseline_buckets"),
        mean_of(zero("baseline_errors"), count).alias("baseline_mean"),
        sample_sd(zero("baseline_errors"), zero("baseline_squares"), count).alias("baseline_sd"),
        F.coalesce(F.col("baseline_p95").cast("double"), F.lit(0.0)).alias("baseline_p95"),
    )


def sliding_frames(rollup_rows: DataFrame, config: DetectionConfig) -> DataFrame:
    """Window and baseline statistics for every end point: each bucket a service has."""
    wide = rollup_rows.where(F.col("endpoint") == "")
    at = times.seconds_of(F.col("bucket_start"))
    step = config.bucket_seconds
    by_time = Window.partitionBy("service", "_chunk").orderBy("_at")
    window = by_time.rangeBetween(-(config.window_buckets - 1) * step, 0)
    near = config.window_buckets + config.gap_buckets
    baseline = by_time.rangeBetween(-(near + config.baseline_buckets - 1) * step, -near * step)
    columns = _frame_columns(lambda f, c: f(c).over(window), lambda f, c: f(c).over(baseline))
    rows = spread_over_chunks(wide.withColumn("_at", at), F.col("_at"), config)
    end = F.col("_at") + step
    raw = rows.select(
        "service",
        "_owned",
        times.from_seconds(end - config.window_seconds).alias("window_start"),
        times.from_seconds(end).alias("window_end"),
        *[column.alias(name) for name, column in columns.items()],
    ).where("_owned")
    return _statistics(raw)


def newest_bucket(rollup_rows: DataFrame) -> datetime | None:
    """One value: where the newest bucket starts."""
    seconds = rollup_rows.agg(F.max(F.unix_seconds("bucket_start"))).first()[0]
    return None if seconds is None else datetime.fromtimestamp(seconds, timezone.utc)


def latest_frames(rollup_rows: DataFrame, config: DetectionConfig) -> DataFrame:
    """The same statistics at one end point for all services: the newest bucket of any.

    A busy service therefore moves the window of one that lags behind. Services are those
    with a bucket since the start of the baseline.
    """
    newest = rollup_rows.agg(F.max(times.seconds_of(F.col("bucket_start"))).alias("_newest"))
    wide = rollup_rows.where(F.col("endpoint") == "").crossJoin(newest)  # one row
    at = times.seconds_of(F.col("bucket_start"))
    end = F.col("_newest") + config.bucket_seconds
    window_start = end - config.window_seconds
    baseline_end = window_start - config.baseline_offset_seconds
    baseline_start = baseline_end - config.baseline_seconds
    in_window = (at >= window_start) & (at < end)
    in_baseline = (at >= baseline_start) & (at < baseline_end)
    columns = _frame_columns(
        lambda f, c: f(F.when(in_window, c)), lambda f, c: f(F.when(in_baseline, c))
    )
    raw = (
        wide.where(at >= baseline_start)
        .groupBy("service", "_newest")
        .agg(*[column.alias(name) for name, column in columns.items()])
        .withColumn("window_start", times.from_seconds(window_start))
        .withColumn("window_end", times.from_seconds(end))
    )
    return _statistics(raw)
