"""What the logs and the rollup say about each anomaly's window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.config import PacketBudget
from vigilog.functions import text, times
from vigilog.functions.numbers import round_half_up
from vigilog.operators.sampling import cap_rows, sample_diverse
from vigilog.operators.signatures import signature_table
from vigilog.sources.logs import with_bucket
from vigilog.sources.staging import staged
from vigilog.sources.tables import latest_per

LINE_ORDER = ["timestamp", "ingest_seq"]


def window_cells(anomalies: DataFrame, bucket_seconds: int) -> DataFrame:
    """One row per anomaly and bucket its window touches: the equi key of interval joins."""
    first = times.floor_to_bucket(F.col("window_start"), bucket_seconds)
    last = times.floor_to_bucket(F.timestamp_micros(F.unix_micros("window_end") - 1), bucket_seconds)
    return anomalies.where(first <= last).select(
        "anomaly_id", "service", "window_start", "window_end",
        F.explode(F.sequence(first, last, F.expr(f"INTERVAL {bucket_seconds} SECONDS"))).alias("bucket_start"),
    )


def lines_in_windows(anomalies: DataFrame, lines: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    """Log lines of each anomaly's half-open window.

    Joined on service and bucket (and day, which prunes partitions), never on the interval
    alone, so Spark hashes or sorts both sides, and splits a hot bucket if there is one.
    """
    cells = window_cells(anomalies, bucket_seconds)
    on = ["service", "bucket_start"]
    if "dt" in lines.columns:
        cells = cells.withColumn("dt", F.to_date("bucket_start"))
        on = ["dt", *on]
    joined = with_bucket(lines, bucket_seconds).join(cells, on)
    moment = F.col("timestamp")
    return joined.where((moment >= F.col("window_start")) & (moment < F.col("window_end")))


def rollup_in_windows(anomalies: DataFrame, rollup_rows: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    cells = window_cells(anomalies, bucket_seconds).where(F.col("bucket_start") >= F.col("window_start"))
    return rollup_rows.join(cells, ["service", "bucket_start"])


def _rounded_mean(name: str) -> Column:
    total, count = F.sum(name), F.count(name)
    return F.coalesce(round_half_up(total.cast("double") / count), F.lit(0)).cast("long").alias(name)


def evidence_totals(anomalies: DataFrame, in_window: DataFrame, rollup_window: DataFrame) -> DataFrame:
    """Counts from the lines themselves; latencies as rounded means of the rollup's buckets."""
    counts = in_window.groupBy("anomaly_id").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(text.is_error_level(F.col("level"))).alias("error_count"),
    )
    latency = (
        rollup_window.where(F.col("endpoint") == "")
        .groupBy("anomaly_id")
        .agg(*[_rounded_mean(name) for name in ("p50_ms", "p95_ms", "p99_ms")])
    )
    names = ["request_count", "error_count", "p50_ms", "p95_ms", "p99_ms"]
    return (
        anomalies.select("anomaly_id")
        .join(counts, "anomaly_id", "left")
        .join(latency, "anomaly_id", "left")
        .select("anomaly_id", *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in names])
    )


def endpoint_metrics(rollup_window: DataFrame) -> DataFrame:
    return (
        rollup_window.where(F.col("endpoint") != "")
        .groupBy("anomaly_id", "endpoint")
        .agg(
            F.sum("request_count").alias("request_count"),
            F.sum("error_count").alias("error_count"),
            _rounded_mean("p95_ms"),
        )
    )


def timeline(rollup_window: DataFrame) -> DataFrame:
    return rollup_window.where(F.col("endpoint") == "").select(
        "anomaly_id", "bucket_start", "request_count", "error_count", "p95_ms"
    )


def top_signatures(in_window: DataFrame, limit: int = 8) -> DataFrame:
    """Most frequent signatures per anomaly, ties in alphabetical order."""
    table = signature_table(in_window, ["anomaly_id"])
    return cap_rows(table, ["anomaly_id"], [F.col("occurrences").desc(), F.col("error_signature")], limit)


def slowest_endpoints(endpoints: DataFrame, limit: int = 6) -> DataFrame:
    return cap_rows(endpoints, ["anomaly_id"], [F.col("p95_ms").desc(), F.col("endpoint")], limit)


def line_shape() -> Column:
    """Lines of one shape differ only in what signatures hide."""
    return F.concat_ws(
        " ",
        F.coalesce(F.col("endpoint"), F.lit("")),
        F.coalesce(F.col("status_code").cast("string"), F.lit("")),
        text.normalize_signature(F.col("message")),
    )


def scanned_lines(in_window: DataFrame, limit: int) -> DataFrame:
    """The earliest lines of each class: those that can carry an error, and info."""
    flagged = in_window.withColumn("carries_error", text.has_error_signature(F.col("level")))
    return cap_rows(flagged, ["anomaly_id", "carries_error"], [F.col(c) for c in LINE_ORDER], limit)


def sampled_lines(in_window: DataFrame, budget: PacketBudget = PacketBudget()) -> DataFrame:
    """Diverse sample per anomaly: failing lines, and the others including warnings.

    Sampled are all lines of the window. They are only ever sorted within a minute; positions in
    the window come from the minutes' counts.
    """
    prepared = (
        in_window.withColumn("shape", line_shape())
        .withColumn("failing", text.is_error_level(F.col("level")))
        .withColumn("_info", (~text.has_error_signature(F.col("level"))).cast("int"))
        .withColumn("_cell", F.col("_info") * F.lit(10**12) + F.floor(times.seconds_of(F.col("timestamp")) / 60))
    )
    limit = F.when(F.col("failing"), budget.error_lines).otherwise(budget.healthy_lines).cast("long")
    order = [F.col("_info"), *[F.col(c) for c in LINE_ORDER]]
    return sample_diverse(prepared, ["anomaly_id", "failing"], order, "shape", limit, "_cell").drop("_info", "_cell", "shape")


def window_sample(in_window: DataFrame, limit: int = 12) -> DataFrame:
    """The first lines that can carry an error, as the trace view shows them."""
    flagged = in_window.where(text.has_error_signature(F.col("level")))
    return cap_rows(flagged, ["anomaly_id"], [F.col(c) for c in LINE_ORDER], limit).select(
        "anomaly_id", "timestamp", "ingest_seq", "level", "message", "endpoint", "status_code"
    )


def classification_evidence(
    anomalies: DataFrame,
    lines: DataFrame,
    rollup_rows: DataFrame,
    bucket_seconds: int = 60,
    budget: PacketBudget = PacketBudget(),
) -> DataFrame:
    """One row per anomaly with everything a classification packet shows.

    Every list is cut to its budget before it is collected; the uncut sizes are kept.
    """
    # Four steps read the lines and four the rollup rows: join them to the windows once.
    in_window = staged(lines_in_windows(anomalies, lines, bucket_seconds))
    rolled = staged(rollup_in_windows(anomalies, rollup_rows, bucket_seconds))
    key = ["anomaly_id"]

    minutes = timeline(rolled)
    shown_minutes = (
        cap_rows(minutes, key, [F.col("bucket_start").desc()], budget.timeline_buckets)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("bucket_start", "request_count", "error_count", "p95_ms"))).alias("timeline"))
    )
    endpoints = endpoint_metrics(rolled)
    shown_endpoints = (
        slowest_endpoints(endpoints, budget.endpoints)
        .groupBy(*key)
        .agg(
            F.array_sort(
                F.collect_list(F.struct((-F.col("p95_ms")).alias("slow"), "endpoint", "request_count", "error_count", "p95_ms"))
            ).alias("endpoints")
        )
    )
    signatures = signature_table(in_window, key)
    shown_signatures = (
        cap_rows(signatures, key, [F.col("occurrences").desc(), F.col("error_signature")], budget.signatures)
        .groupBy(*key)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct((-F.col("occurrences")).alias("rare"), "error_signature", "occurrences", "sample_message")
                )
            ).alias("signatures")
        )
    )
    shown_lines = (
        sampled_lines(in_window, budget)
        .groupBy(*key)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("timestamp", "ingest_seq", "level", "endpoint", "status_code", "message"))
            ).alias("lines")
        )
    )

    def size_of(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy(*key).agg(F.count(F.lit(1)).alias(name))

    out = anomalies.join(evidence_totals(anomalies, in_window, rolled), "anomaly_id")
    for part in (
        shown_minutes, size_of(minutes, "timeline_size"), shown_endpoints, size_of(endpoints, "endpoint_count"),
        shown_signatures, size_of(signatures, "signature_count"), shown_lines,
    ):
        out = out.join(part, "anomaly_id", "left")
    return out


def injection_findings(packets: DataFrame, key: str = "anomaly_id", text_column: str = "packet") -> DataFrame:
    """Findings per packet: the lines aimed at an automated reader, each payload once."""
    lines = packets.select(key, F.posexplode(F.split(text_column, "\n")).alias("line_no", "line"))
    written = lines.where(text.trim_space(F.col("line")) != "")
    found = (
        text.with_injection_rule(written)
        .where(F.col("rule").isNotNull())
        .withColumn("finding_key", text.injection_key(F.col("line")))
    )
    return latest_per(found, [key, "finding_key"], F.col("line_no")).select(
        key, "line_no", "rule", text.injection_excerpt(F.col("line")).alias("excerpt")
    )


def scan_packets(packets: DataFrame, key: str = "anomaly_id", text_column: str = "packet") -> DataFrame:
    """Per packet: whether anything was found, and one line about it.

    The summary needs the first finding and the number of findings, so no list is collected.
    """
    found = injection_findings(packets, key, text_column)
    first = found.groupBy(key).agg(
        F.min(F.struct("line_no", "rule", "excerpt")).alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    more = F.when(F.col("_n") > 1, F.concat(F.lit(" (+"), (F.col("_n") - 1).cast("string"), F.lit(" more)"))).otherwise("")
    summary = F.concat(F.lit("["), F.col("_first.rule"), F.lit("] "), F.col("_first.excerpt"), more)
    return packets.select(key).join(first, key, "left").select(
        key, F.col("_n").isNotNull().alias("injection_suspected"), summary.alias("injection_evidence")
    )


def flag_injection(anomalies: DataFrame, packets: DataFrame) -> DataFrame:
    """Anomalies with the outcome of the scan of their packets."""
    scanned = scan_packets(packets)
    return anomalies.drop("injection_suspected", "injection_evidence").join(scanned, "anomaly_id", "left")
