"""Posted batches as a stream: deduplicate, validate, store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilog import fixed_values as V
from vigilog.operators import ingest


def deduplicated(envelopes: DataFrame) -> DataFrame:
    """First delivery of each idempotency key within its lifetime.

    Only usable batches are remembered. Batches without a key go around the deduplication,
    which would take all NULL keys for the same key.
    """
    usable = envelopes.where(F.col("batch_error").isNull())
    keyed = (
        usable.where(F.col("idempotency_key").isNotNull())
        .withWatermark("received_at", f"{V.IDEMPOTENCY_TTL_MINUTES} minutes")
        .dropDuplicatesWithinWatermark(["idempotency_key"])
    )
    return keyed.unionByName(usable.where(F.col("idempotency_key").isNull()))


def validated(batches: DataFrame) -> DataFrame:
    """Validated entries of a stream of batches; a batch's arrival is its ``now``."""
    entries = ingest.explode_entries(deduplicated(ingest.check_envelopes(batches)))
    return ingest.validate_entries(entries, F.col("received_at"))


def start_log_writer(batches: DataFrame, logs_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Store accepted rows. The file sink commits each micro-batch exactly once."""
    return (
        ingest.accepted_logs(validated(batches))
        .writeStream.format("parquet")
        .partitionBy("dt")
        .option("path", logs_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )


def start_reject_writer(batches: DataFrame, rejects_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return (
        ingest.rejects(validated(batches))
        .writeStream.format("parquet")
        .option("path", rejects_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )
