"""The log table: raw batches in, partitioned Parquet out, range scans back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog import schemas
from vigilog.functions import times


def read_log_batches(spark: SparkSession, path: str) -> DataFrame:
    """One row per posted batch: ``batch_id, received_at, idempotency_key, body``.

    ``body`` is the posted JSON text; it is taken apart by ``operators.ingest``.
    """
    return spark.read.schema(batch_schema()).json(path)


def stream_log_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(batch_schema()).json(path)


def batch_schema() -> str:
    return "batch_id string, received_at timestamp, idempotency_key string, body string"


def write_logs(logs: DataFrame, path: str) -> None:
    """Append accepted rows, one directory per day.

    Rows of a day are spread over tasks by service and minute, so that a service that sends
    most of the traffic does not end up in one task; inside a file they are sorted for
    min/max pruning.
    """
    laid_out = (
        logs.repartition("dt", "service", F.date_trunc("minute", "timestamp"))
        .sortWithinPartitions("dt", "service", "timestamp")
    )
    laid_out.write.partitionBy("dt").mode("append").parquet(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LOGS).parquet(path)


def project_lines(logs: DataFrame) -> DataFrame:
    """Lift the metadata fields that analysis reads; the rest is pruned from the scan."""
    return logs.select(
        "ingest_seq", "timestamp", "service", "level", "message", "error_signature",
        F.col("metadata.endpoint").alias("endpoint"),
        F.col("metadata.statusCode").alias("status_code"),
        F.col("metadata.latencyMs").alias("latency_ms"),
        *(["dt"] if "dt" in logs.columns else []),
    )


def scan_logs(
    lines: DataFrame,
    service: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    levels: list[str] | None = None,
) -> DataFrame:
    """Rows of a half-open time range; the day partition is pruned along with it."""
    out = lines
    if service is not None:
        out = out.where(F.col("service") == service)
    if start is not None:
        out = out.where(F.col("timestamp") >= times.instant(start))
    if end is not None:
        out = out.where(F.col("timestamp") < times.instant(end))
    if "dt" in lines.columns:
        if start is not None:
            out = out.where(F.col("dt") >= F.to_date(times.instant(start)))
        if end is not None:
            out = out.where(F.col("dt") <= F.to_date(times.instant(end)))
    if levels is not None:
        out = out.where(F.col("level").isin(levels))
    return out


def last_ingested_at(lines: DataFrame) -> DataFrame:
    """Event time of the row that arrived last, which need not be the latest event."""
    return lines.agg(F.max_by("timestamp", "ingest_seq").alias("last_ingested_at"))


def with_bucket(lines: DataFrame, bucket_seconds: int) -> DataFrame:
    return lines.withColumn("bucket_start", times.floor_to_bucket(F.col("timestamp"), bucket_seconds))
