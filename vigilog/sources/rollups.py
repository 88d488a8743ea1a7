"""The tables by bucket, by day and rewritten only where buckets changed.

Changes are published whole, see :mod:`vigilog.sources.versions`.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.functions import times
from vigilog import schemas
from vigilog.operators.rollup import on_days
from vigilog.sources import versions

KEYS = ["service", "endpoint", "bucket_start"]


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, path, schemas.ROLLUP)


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """Signatures by bucket: which occurred, how often, and the first message."""
    return versions.read(spark, path, schemas.SIGNATURES)


def upsert_rollup(spark: SparkSession, fresh: DataFrame, dirty: DataFrame, path: str) -> None:
    """Replace all rows of the dirty (service, bucket) keys by freshly computed ones."""
    _upsert(spark, fresh, dirty, path, schemas.ROLLUP)


def upsert_signatures(spark: SparkSession, fresh: DataFrame, dirty: DataFrame, path: str) -> None:
    """The same for the table of signatures by bucket."""
    _upsert(spark, fresh, dirty, path, schemas.SIGNATURES)


def _upsert(spark: SparkSession, fresh: DataFrame, dirty: DataFrame, path: str, schema: T.StructType) -> None:
    """Days with no dirty bucket are not touched. Buckets whose logs are gone lose their rows.

    Repeating the call with the same input gives the same table, so a retried batch is safe.
    """
    days = [row.dt for row in dirty.select(F.to_date("bucket_start").alias("dt")).where("dt IS NOT NULL").distinct().collect()]
    if not days:
        return
    kept = (
        versions.read(spark, path, schema)
        .where(on_days(dirty))
        .join(dirty.select(F.to_date("bucket_start").alias("dt")).distinct(), "dt", "left_semi")
        .join(dirty.select("service", "bucket_start").distinct(), ["service", "bucket_start"], "left_anti")
    )
    rows = fresh.select(*schema.names, F.to_date("bucket_start").alias("dt"))
    rows = kept.select(*rows.columns).unionByName(rows)
    rows = rows.repartition("dt", "service").sortWithinPartitions("dt", *schema.names[:3])
    versions.replace_days(spark, path, rows, days)


def series(rollup: DataFrame, service: str, start: datetime, end: datetime) -> DataFrame:
    """Service-wide rows of a half-open range in time order."""
    return (
        rollup.where(
            (F.col("service") == service)
            & (F.col("endpoint") == "")
            & (F.col("bucket_start") >= times.instant(start))
            & (F.col("bucket_start") < times.instant(end))
        )
        .select("bucket_start", "request_count", "error_count", "p95_ms")
        .orderBy("bucket_start")
    )
