"""Rollups of a stream of log lines."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilog.functions import text
from vigilog.functions.numbers import round_half_up
from vigilog.operators.latency_counts import count_latencies, latency_table, rollup_of_counts
from vigilog.operators.rollup import PERCENTILES, dirty_buckets, lines_of_dirty, percentile_of, rollup_dirty
from vigilog.operators.signatures import signature_increments, stored_buckets
from vigilog.sources.logs import project_lines, read_logs
from vigilog.sources.rollups import upsert_rollup, upsert_signatures


def closed_buckets(lines: DataFrame, bucket_seconds: int = 60, lateness: str = "5 minutes") -> DataFrame:
    """Rollup in append mode: a bucket is emitted once, after the watermark closed it.

    Lines later than the watermark are dropped here. Where they must count,
    use :func:`start_rollup`, which never drops any.
    """
    named = F.coalesce(F.col("endpoint"), F.lit("")) != ""
    endpoints = F.when(named, F.array(F.lit(""), F.col("endpoint"))).otherwise(F.array(F.lit("")))
    grouped = (
        lines.withWatermark("timestamp", lateness)
        .withColumn("endpoint", F.explode(endpoints))
        .groupBy(F.window("timestamp", f"{bucket_seconds} seconds"), "service", "endpoint")
        .agg(
            F.count(F.lit(1)).alias("request_count"),
            F.count_if(text.is_error_level(F.col("level"))).alias("error_count"),
            F.sort_array(F.collect_list("latency_ms")).alias("_v"),
        )
    )
    percentiles = [
        F.coalesce(round_half_up(percentile_of(F.col("_v"), p)), F.lit(0)).cast("long").alias(f"{name}_ms")
        for name, p in PERCENTILES.items()
    ]
    return grouped.select(
        F.col("window.start").alias("bucket_start"), "service", "endpoint", "request_count", "error_count", *percentiles
    )


def recompute_dirty(
    bucket_seconds: int, logs_path: str, rollup_path: str, signatures_path: str | None = None
) -> Callable[[DataFrame, int], None]:
    """Micro-batch step: recompute every bucket that new lines fell into from all its lines.

    Lateness is unbounded and nothing is kept in memory between batches. A repeated batch
    recomputes the same buckets from the same table. With ``signatures_path`` the signatures of
    these buckets are stored too.
    """

    def step(new_logs: DataFrame, epoch: int) -> None:
        spark = new_logs.sparkSession
        dirty = dirty_buckets(new_logs, bucket_seconds)
        lines = project_lines(read_logs(spark, logs_path))
        upsert_rollup(spark, rollup_dirty(lines, dirty, bucket_seconds), dirty, rollup_path)
        if signatures_path is not None:
            fresh = stored_buckets(lines_of_dirty(lines, dirty, bucket_seconds), bucket_seconds)
            upsert_signatures(spark, fresh, dirty, signatures_path)

    return step


def add_to_counts(
    bucket_seconds: int, counts_path: str, rollup_path: str, signatures_path: str | None = None, every: int = 32
) -> Callable[[DataFrame, int], None]:
    """Micro-batch step with the results of :func:`recompute_dirty` that reads no line but the new ones.

    Counts of latencies, and of signatures, are kept by bucket in tables under ``counts_path``. The
    new lines are counted and added under their epoch; dirty buckets are then computed from the
    counts of these buckets. A repeated epoch replaces what it had added. The stream must begin with
    the first line of the log table.
    """
    latencies = latency_table(f"{counts_path}/latencies", every)
    stored = signature_increments(f"{counts_path}/signatures", every)

    def step(new_logs: DataFrame, epoch: int) -> None:
        spark = new_logs.sparkSession
        dirty = dirty_buckets(new_logs, bucket_seconds)
        lines = project_lines(new_logs)
        latencies.add(spark, count_latencies(lines, bucket_seconds), epoch)
        upsert_rollup(spark, rollup_of_counts(latencies.rows_of(spark, dirty, epoch)), dirty, rollup_path)
        if signatures_path is not None:
            stored.add(spark, stored_buckets(lines, bucket_seconds), epoch)
            upsert_signatures(spark, stored.rows_of(spark, dirty, epoch), dirty, signatures_path)

    return step


def prune_counts(spark: SparkSession, counts_path: str, before: datetime, epoch: int) -> None:
    """Drop the days of the counts that end before an instant, in the step of an epoch."""
    for table in (latency_table(f"{counts_path}/latencies"), signature_increments(f"{counts_path}/signatures")):
        table.fold(spark, epoch - 1, before.date())


def start_rollup(
    logs: DataFrame, logs_path: str, rollup_path: str, checkpoint: str, bucket_seconds: int = 60,
    then: Callable[[DataFrame, int], None] | None = None, signatures_path: str | None = None,
    counts_path: str | None = None, **trigger,
) -> StreamingQuery:
    """Keep the rollup table up to date with a stream of stored log rows.

    With ``counts_path`` dirty buckets come from stored counts and not from their lines.
    ``then`` runs after the rollup of each micro-batch, see :mod:`vigilog.streaming.watch`.
    """
    if counts_path is not None:
        recompute = add_to_counts(bucket_seconds, counts_path, rollup_path, signatures_path)
    else:
        recompute = recompute_dirty(bucket_seconds, logs_path, rollup_path, signatures_path)

    def step(batch: DataFrame, epoch: int) -> None:
        recompute(batch, epoch)
        if then is not None:
            then(batch, epoch)

    return logs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()
