"""Retention: what is too old, and dropping it by day partition."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions import times
from vigilog.config import RetentionPolicy
from vigilog.sources import files, versions


def cutoff(now: datetime, days: float) -> datetime | None:
    """Rows strictly older than this go; ``None`` keeps everything."""
    if days != days or days in (float("inf"), float("-inf")) or days < 0:
        raise ValueError(f"days to keep must be finite and not negative: {days}")
    if days == 0:
        return None
    if days < 1:
        raise ValueError(f"at least one day must be kept, as detection compares with it: {days}")
    return now - timedelta(days=days)


def retention_cutoffs(now: datetime, policy: RetentionPolicy) -> dict[str, datetime | None]:
    return {"logs": cutoff(now, policy.log_days), "rollups": cutoff(now, policy.rollup_days)}


def services(lines: DataFrame, rollup: DataFrame) -> DataFrame:
    """Services known from either table."""
    return lines.select("service").union(rollup.select("service")).distinct()


def prune_preview(lines: DataFrame, rollup: DataFrame, now: datetime, policy: RetentionPolicy) -> DataFrame:
    """Dry run: rows per service that pruning would delete."""
    limits = retention_cutoffs(now, policy)

    def doomed(frame: DataFrame, moment: str, limit: datetime | None, name: str) -> DataFrame:
        old = F.lit(False) if limit is None else F.col(moment) < times.instant(limit)
        return frame.where(old).groupBy("service").agg(F.count(F.lit(1)).alias(name))

    counts_of_logs = doomed(lines, "timestamp", limits["logs"], "logs_deleted")
    counts_of_rollups = doomed(rollup, "bucket_start", limits["rollups"], "rollups_deleted")
    return (
        services(lines, rollup)
        .join(counts_of_logs, "service", "left")
        .join(counts_of_rollups, "service", "left")
        .select(
            "service",
            F.coalesce("logs_deleted", F.lit(0)).cast("long").alias("logs_deleted"),
            F.coalesce("rollups_deleted", F.lit(0)).cast("long").alias("rollups_deleted"),
        )
    )


def prune(spark: SparkSession, path: str, moment: str, limit: datetime | None) -> None:
    """Delete rows older than the limit from a table by ``dt``.

    Whole days are dropped; only the day the limit falls in is rewritten. A table with manifests
    (:mod:`vigilog.sources.versions`) changes in one step for its readers.
    """
    if limit is None:
        return
    boundary = limit.date().isoformat()
    if files.exists(spark, f"{path}/_manifests"):
        _, days = versions.newest(spark, path)
        old = [day for day in days if day < boundary]
        if not old and boundary not in days:
            return
        own = days.get(boundary)
        if own is None:
            rows, touched = None, []
        else:
            stored = spark.read.option("basePath", path).parquet(f"{path}/dt={boundary}/v={own}").drop("v")
            rows, touched = stored.where(F.col(moment) >= times.instant(limit)), [limit.date()]
        versions.replace_days(spark, path, rows, touched, old)
        return
    table = spark.read.parquet(path)
    kept = table.where((F.col("dt") == F.to_date(times.instant(limit))) & (F.col(moment) >= times.instant(limit)))
    kept.write.partitionBy("dt").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    # A directory listing: one entry per day kept, however large the days are.
    for name in files.names(spark, path):
        if name.startswith("dt=") and name[3:] < boundary:
            files.delete(spark, f"{path}/{name}")
