"""Table schemas. Timestamps are instants; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _L, _I, _D, _B, _TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)

METADATA = _struct(
    ("requestId", _S, True), ("endpoint", _S, True), ("method", _S, True), ("statusCode", _I, True),
    ("latencyMs", _D, True), ("errorType", _S, True), ("stack", _S, True), ("extra", _S, True),
)

LOGS = _struct(
    ("ingest_seq", _L, False), ("timestamp", _TS, False), ("service", _S, False), ("level", _S, False),
    ("message", _S, False), ("error_signature", _S, True), ("metadata", METADATA, True),
    ("dt", T.DateType(), False),
)

# A log row with the metadata fields that analysis reads lifted to columns.
LINES = _struct(
    ("ingest_seq", _L, False), ("timestamp", _TS, False), ("service", _S, False), ("level", _S, False),
    ("message", _S, False), ("error_signature", _S, True), ("endpoint", _S, True),
    ("status_code", _I, True), ("latency_ms", _D, True),
)

ROLLUP = _struct(
    ("bucket_start", _TS, False), ("service", _S, False), ("endpoint", _S, False),
    ("request_count", _L, False), ("error_count", _L, False),
    ("p50_ms", _L, False), ("p95_ms", _L, False), ("p99_ms", _L, False),
)

# How many lines, and how many errors, of an endpoint had a latency in a bucket.
LATENCIES = _struct(
    ("bucket_start", _TS, False), ("service", _S, False), ("endpoint", _S, False),
    ("latency_ms", _D, True), ("requests", _L, False), ("errors", _L, False),
)

# How often a signature occurred in a bucket, and the first message with it.
SIGNATURES = _struct(
    ("bucket_start", _TS, False), ("service", _S, False), ("error_signature", _S, False), ("n", _L, False),
    ("first", _struct(("at", _TS, True), ("seq", _L, True), ("message", _S, True)), False),
)

# One shape for all four trigger kinds; fields of other kinds stay NULL.
TRIGGER = _struct(
    ("kind", _S, False), ("service", _S, False),
    ("observed_errors", _L, True), ("baseline_mean", _D, True), ("baseline_sd", _D, True), ("z_score", _D, True),
    ("metric", _S, True), ("observed_ms", _D, True), ("baseline_ms", _D, True), ("ratio", _D, True),
    ("signature", _S, True), ("sample_message", _S, True), ("occurrences", _L, True),
    ("last_seen_at", _TS, True), ("silent_minutes", _L, True), ("lines_per_minute", _D, True),
)

FIRING = _struct(
    ("service", _S, False), ("window_start", _TS, False), ("window_end", _TS, False),
    ("triggers", T.ArrayType(TRIGGER), False),
)

ANOMALY = _struct(
    ("anomaly_id", _S, False), ("detected_at", _TS, False), ("window_start", _TS, False),
    ("window_end", _TS, False), ("service", _S, False), ("triggers", T.ArrayType(TRIGGER), False),
    ("severity", _S, True), ("summary", _S, True), ("is_real_incident", _B, True),
    ("affected_area", _S, True), ("injection_suspected", _B, True), ("injection_evidence", _S, True),
    ("status", _S, False),
)

CHANGED_FILE = _struct(("path", _S, False), ("added", _I, True), ("deleted", _I, True))

COMMIT = _struct(
    ("sha", _S, False), ("committed_at", _TS, False), ("author", _S, True), ("subject", _S, True),
    ("body", _S, True), ("files", T.ArrayType(CHANGED_FILE), True), ("diff", _S, True),
)

CORRELATION = _struct(
    ("anomaly_id", _S, False), ("suspected_commit_sha", _S, True), ("confidence", _D, False),
    ("reasoning", _S, False), ("implicated_files", T.ArrayType(_S), False), ("created_at", _TS, False),
)

HYPOTHESIS = _struct(
    ("anomaly_id", _S, False), ("explains_the_failure", _B, False), ("root_cause", _S, False),
    ("suggested_fix", _S, False), ("confidence", _D, False), ("applied", _B, False), ("created_at", _TS, False),
)

CALL = _struct(
    ("call_id", _S, False), ("anomaly_id", _S, True), ("provider", _S, False), ("model", _S, False),
    ("agent", _S, False), ("input_tokens", _L, True), ("output_tokens", _L, True), ("latency_ms", _L, False),
    ("repair_attempts", _L, False), ("succeeded", _B, False), ("created_at", _TS, False),
)

ALERT = _struct(
    ("anomaly_id", _S, False), ("reason", _S, False), ("channel", _S, False), ("succeeded", _B, False),
    ("error", _S, True), ("created_at", _TS, False),
)

CLASSIFICATION_CASE = T.StructType([
    T.StructField("name", _S), T.StructField("scenario", _S), T.StructField("capturedAt", _S),
    T.StructField("expect", _struct(("isRealIncident", _B, True), ("severity", _S, True), ("note", _S, True))),
    T.StructField("context", _S),
])

CORRELATION_CASE = T.StructType([
    T.StructField("name", _S), T.StructField("scenario", _S), T.StructField("capturedAt", _S),
    T.StructField("expect", _struct(
        ("suspectedCommitSha", _S, True), ("implicatedFiles", T.ArrayType(_S), True), ("note", _S, True))),
    T.StructField("context", _S),
])

DIAGNOSIS_CASE = T.StructType([
    T.StructField("name", _S), T.StructField("scenario", _S), T.StructField("capturedAt", _S),
    T.StructField("sha", _S),
    T.StructField("expect", _struct(("explainsTheFailure", _B, True), ("note", _S, True))),
    T.StructField("commitFiles", T.ArrayType(_S)), T.StructField("context", _S),
])

PINNED_VERDICT = T.StructType([
    T.StructField(name, _S)
    for name in ("scenario", "severity", "summary", "affectedArea", "note", "capturedFrom", "model")
])


def same_shape(df, schema: T.StructType):
    """Project ``df`` onto ``schema``: same names, order and types."""
    return df.select(*[df[field.name].cast(field.dataType).alias(field.name) for field in schema])
