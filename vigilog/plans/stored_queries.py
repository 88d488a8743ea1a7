"""Registered queries that write a table as the engine does and read it back.

Each writes to a folder of its own in the shared storage; rows and tables come from the given data.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog import schemas
from vigilog.functions import triggers as T
from vigilog.operators import ingest, reports, rollup, signatures
from vigilog.operators.latency_counts import count_latencies, latency_table, rollup_of_counts
from vigilog.plans.derived import BUCKET, Derived
from vigilog.plans.queries import NOW_AT, accepted_columns, commit_columns, git_export, joined, posted_batches, registered, validated_entries
from vigilog.sources import commits as commit_source
from vigilog.sources import logs as log_source
from vigilog.sources import retention, rollups
from vigilog.sources.adapters import EVENTS_CONFIG
from vigilog.sources.events import EventLog
from vigilog.sources.staging import shared_folder
from vigilog.streaming import watch
from vigilog.streaming.rollup import closed_buckets as closing_buckets

PRUNED_BEFORE = datetime(2024, 1, 15, 12, tzinfo=timezone.utc)


def folder(d: Derived) -> str:
    return f"{shared_folder(d.spark)}/stored-{uuid.uuid4().hex}"


def stored_logs(d: Derived, path: str) -> None:
    """The lines of the test data as a log table by day."""
    metadata = {
        "endpoint": F.col("endpoint"), "statusCode": F.col("status_code"), "latencyMs": F.col("latency_ms")
    }
    fields = [metadata.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.METADATA]
    logs = d.lines.withColumn("metadata", F.struct(*fields)).withColumn("dt", F.to_date("timestamp"))
    log_source.write_logs(logs.select(*schemas.LOGS.names), path)


@registered
def reread_batches(d: Derived) -> DataFrame:
    """Posted batches written as JSON lines, read again, and freed of replays."""
    path = folder(d)
    posted_batches(d).write.json(path)
    kept = ingest.deduplicate_batches(ingest.check_envelopes(log_source.read_log_batches(d.spark, path)))
    return kept.groupBy("idempotency_key", "received_at").agg(F.count(F.lit(1)).alias("n"))


@registered
def reread_commits(d: Derived) -> DataFrame:
    """Exports written as text files and read in splits."""
    path = folder(d)
    git_export(d).select("value").write.text(path)
    return commit_columns(commit_source.read_commits(d.spark, path))


@registered
def stored_lines(d: Derived) -> DataFrame:
    """Accepted lines as the log table gives them back."""
    path = folder(d)
    log_source.write_logs(ingest.accepted_logs(validated_entries(d)), path)
    return accepted_columns(log_source.read_logs(d.spark, path))


@registered
def upserted_rollup(d: Derived) -> DataFrame:
    """A rollup that first lacks all errors, with the buckets that they make dirty replaced."""
    path = folder(d)
    calm = d.lines.where("level <> 'error'")
    rollups.upsert_rollup(d.spark, rollup.rollup(calm, BUCKET), rollup.dirty_buckets(calm, BUCKET), path)
    dirty = rollup.dirty_buckets(d.lines.where("level = 'error'"), BUCKET)
    rollups.upsert_rollup(d.spark, rollup.rollup_dirty(d.lines, dirty, BUCKET), dirty, path)
    return rollups.read_rollup(d.spark, path).drop("dt")


def counted_parts(d: Derived) -> list[DataFrame]:
    """The lines in three parts, each of which reaches into the buckets of the others."""
    return [d.lines.where(F.col("ingest_seq") % 3 == part) for part in range(3)]


@registered
def counted_rollup(d: Derived) -> DataFrame:
    """The rollup from stored counts: three epochs, one of them merged into days, one tried twice."""
    table = latency_table(folder(d), every=1)
    for epoch, lines in enumerate(counted_parts(d)):
        for _ in range(1 + (epoch == 2)):
            table.add(d.spark, count_latencies(lines, BUCKET), epoch)
    return rollup_of_counts(table.rows_of(d.spark, rollup.dirty_buckets(d.lines, BUCKET)))


@registered
def counted_signatures(d: Derived) -> DataFrame:
    """Signatures by bucket, kept in the same way."""
    table = signatures.signature_increments(folder(d), every=1)
    for epoch, lines in enumerate(counted_parts(d)):
        table.add(d.spark, signatures.stored_buckets(lines, BUCKET), epoch)
    return table.read(d.spark).select("bucket_start", "service", "error_signature", "n", F.col("first.message").alias("message"))


@registered
def pruned_rollup(d: Derived) -> DataFrame:
    """What retention leaves of a stored rollup."""
    path = folder(d)
    rollups.upsert_rollup(d.spark, d.rollup, rollup.dirty_buckets(d.lines, BUCKET), path)
    retention.prune(d.spark, path, "bucket_start", PRUNED_BEFORE)
    return rollups.read_rollup(d.spark, path).drop("dt")


@registered
def stored_signatures(d: Derived) -> DataFrame:
    """Signatures by bucket as detection reads them."""
    path = folder(d)
    fresh = signatures.stored_buckets(d.lines, BUCKET)
    rollups.upsert_signatures(d.spark, fresh, rollup.dirty_buckets(d.lines, BUCKET), path)
    table = rollups.read_signatures(d.spark, path)
    return table.select("bucket_start", "service", "error_signature", "n", F.col("first.message").alias("message"))


@registered
def stored_incidents(d: Derived) -> DataFrame:
    """The state of incidents that were resolved many epochs after they were found."""
    opened = d.open_anomalies.withColumns({"action": F.lit("created"), "added_kinds": F.array().cast("array<string>")})
    log: EventLog = watch.Watch("", "", folder(d)).anomalies
    log.append(opened, 3, watch.STEPS["detected"])
    longer = d.incidents.where("firing_count > 1").select("anomaly_id")
    log.append(opened.join(longer, "anomaly_id", "left_semi").withColumn("status", F.lit("resolved")), 70, watch.STEPS["diagnosed"])
    return log.state(d.spark).select("anomaly_id", "window_start", "window_end", "status")


@registered
def watch_run(d: Derived) -> DataFrame:
    """One run of the watch over stored logs and rollup, silence included."""
    base = folder(d)
    settings = watch.Watch(f"{base}/logs", f"{base}/rollup", f"{base}/anomalies", EVENTS_CONFIG, clock=lambda: NOW_AT)
    stored_logs(d, settings.logs_path)
    rollups.upsert_rollup(d.spark, d.rollup, rollup.dirty_buckets(d.lines, BUCKET), settings.rollup_path)
    watch.run_detection(d.spark, settings, 0)
    events = watch.anomaly_events(d.spark, settings.anomalies_path)
    return events.select(
        "service", "window_start", "window_end", joined(T.kinds(F.col("triggers"))).alias("kinds"), "action"
    )


@registered
def closed_buckets(d: Derived) -> DataFrame:
    """Buckets that a stream of the stored lines has closed, in append mode."""
    base = folder(d)
    stored_logs(d, f"{base}/logs")
    logs = d.spark.readStream.schema(schemas.LOGS).parquet(f"{base}/logs")
    closed = closing_buckets(log_source.project_lines(logs), BUCKET, lateness="5 minutes")
    query = (
        closed.writeStream.format("parquet").option("path", f"{base}/closed")
        .option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return d.spark.read.schema(closed.schema).parquet(f"{base}/closed")


@registered
def alert_log(d: Derived) -> DataFrame:
    """Attempts to tell of one incident, the first of those with any."""
    first = d.attempts.agg(F.min("anomaly_id")).first()[0] or ""
    return reports.alert_log(d.attempts, first).select("anomaly_id", "reason", "channel", "succeeded", "error", "created_at")
