"""Views of the benchmark tables as the tables this engine works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.config import DetectionConfig
from vigilog.functions import text
from vigilog.session import prepare

# Events are far sparser than one per minute, so the frames are made of 3-hour buckets.
EVENTS_CONFIG = DetectionConfig(
    bucket_seconds=3 * 3600,
    window_buckets=1,
    gap_buckets=1,
    baseline_buckets=56,
    min_baseline_buckets=28,
    min_errors_per_bucket=2.0,
    sd_multiplier=3.0,
    min_latency_ms=100.0,
    latency_ratio=1.5,
    min_occurrences=2,
    silence_min_minutes=60,
    silence_min_lines_per_minute=0.005,
    silence_baseline_minutes=1440,
    silence_lookback_minutes=4320,
    merge_gap_minutes=180,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def logs_from_events(events: DataFrame) -> DataFrame:
    """The ``events`` table as log lines."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    suffix = F.when(k >= 95, F.concat(F.lit(" via "), F.char(97 + k % 5))).otherwise("")
    lines = events.select(
        F.col("event_id").alias("ingest_seq"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")).alias("service"),
        F.when(kind == "error", "error").when(kind == "purchase", "warn").otherwise("info").alias("level"),
        F.when(
            kind == "error",
            F.concat(
                F.lit("Order "), k.cast("string"), F.lit(" not found for user "),
                F.col("user_id").cast("string"), suffix,
            ),
        )
        .otherwise(F.concat(kind, F.lit(" "), k.cast("string")))
        .alias("message"),
        F.concat(F.lit("/"), kind).alias("endpoint"),
        F.when(kind == "error", 500).when(kind == "purchase", 429).otherwise(200).cast("int").alias("status_code"),
        F.col("value").alias("latency_ms"),
    )
    return lines.withColumn("error_signature", text.signature_for(F.col("level"), F.col("message"))).select(
        "ingest_seq", "timestamp", "service", "level", "message", "error_signature",
        "endpoint", "status_code", "latency_ms",
    )


def commits_from_orders(orders: DataFrame) -> DataFrame:
    """The ``orders`` table as commits, moved into the weeks the events cover.

    The sha is the hash of the order key; file counts and texts derive from the row.
    """
    key = F.col("o_orderkey").cast("string")
    minute = (F.col("o_orderkey") * 7919 + F.col("o_custkey") * 13) % 43_200
    at = F.timestamp_seconds(F.lit(1_704_067_200) + minute * 60)
    files = F.transform(
        F.sequence(F.lit(1), (F.col("o_orderkey") % 15 + 1).cast("int")),
        lambda i: F.struct(
            F.concat(F.lit("src/mod"), (F.col("o_custkey") % 9).cast("string"), F.lit("/file"), i.cast("string"), F.lit(".js")).alias("path"),
            F.when((F.col("o_custkey") + i) % 7 > 0, (F.col("o_orderkey") + i) % 40).cast("int").alias("added"),
            F.when((F.col("o_custkey") + i) % 7 > 0, (F.col("o_custkey") + i) % 30).cast("int").alias("deleted"),
        ),
    )
    diff = F.concat(
        F.lit("diff --git a/x b/x"),
        F.repeat(F.lit("\n+ line of the patch"), (F.col("o_orderkey") % 60).cast("int")),
    )
    return orders.select(
        F.sha1(key).alias("sha"),
        at.alias("committed_at"),
        F.concat(F.lit("author "), (F.col("o_custkey") % 50).cast("string")).alias("author"),
        F.concat(F.lit("Change order "), key, F.lit(" to "), F.col("o_orderstatus")).alias("subject"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Priority\n"), F.col("o_orderpriority"))).otherwise("").alias("body"),
        files.alias("files"),
        F.when(F.col("o_orderkey") % 4 > 0, diff).otherwise("").alias("diff"),
    )


def calls_from_conversations(conversations: DataFrame) -> DataFrame:
    """The ``conversations`` table as model calls: one call per turn."""
    turn, conv = F.col("turn"), F.col("conv_id")
    size = F.length("text").cast("long")
    return conversations.select(
        F.concat_ws("-", conv.cast("string"), turn.cast("string")).alias("call_id"),
        F.when(conv % 11 > 0, F.concat(F.lit("a"), (conv % 97).cast("string"))).alias("anomaly_id"),
        F.when(conv % 3 == 0, "gemini").when(conv % 3 == 1, "openai").otherwise("ollama").alias("provider"),
        F.concat(F.lit("model-"), (conv % 2).cast("string")).alias("model"),
        F.when(turn % 3 == 0, "classifier").when(turn % 3 == 1, "correlator").otherwise("root_cause").alias("agent"),
        F.when(turn % 5 > 0, size).alias("input_tokens"),
        F.when(turn % 7 > 0, size % 100).cast("long").alias("output_tokens"),
        (size * 3 + turn).alias("latency_ms"),
        F.greatest(size % 4 - 1, F.lit(0)).cast("long").alias("repair_attempts"),
        (size % 4 != 3).alias("succeeded"),
        F.timestamp_seconds(F.lit(1_704_067_200) + conv * 12_101 % 1_209_600 + turn * 61).alias("created_at"),
    )
