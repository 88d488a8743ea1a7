"""The four detectors and the status of every service at every end point."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog import fixed_values as V
from vigilog.config import DetectionConfig
from vigilog.functions import times
from vigilog.functions.numbers import safe_z
from vigilog.functions.triggers import make_trigger
from vigilog.operators.frames import latest_frames, sliding_frames
from vigilog.operators.signatures import new_signatures, new_signatures_at, new_signatures_stored

TEXT_SILENT_SERVICE = "silent: covered by the service_silent check"


def enough_baseline(config: DetectionConfig) -> Column:
    return F.col("baseline_buckets") >= config.min_baseline_buckets


def error_rate_fires(config: DetectionConfig) -> Column:
    threshold = F.col("baseline_mean") + F.lit(config.sd_multiplier) * F.col("baseline_sd")
    return (F.col("error_rate") >= config.min_errors_per_bucket) & (F.col("error_rate") > threshold)


def latency_ratio() -> Column:
    return F.when(F.col("baseline_p95") > 0, F.col("window_p95") / F.col("baseline_p95"))


def latency_fires(config: DetectionConfig) -> Column:
    return F.coalesce(
        (F.col("window_p95") >= config.min_latency_ms) & (latency_ratio() >= config.latency_ratio), F.lit(False)
    )


def error_rate_spikes(frames: DataFrame, config: DetectionConfig) -> DataFrame:
    """End points whose error rate is above the floor and above mean + k deviations."""
    return frames.where(enough_baseline(config) & error_rate_fires(config)).select(
        "service", "window_start", "window_end", "error_count", "error_rate", "baseline_mean", "baseline_sd",
        safe_z(F.col("error_rate"), F.col("baseline_mean"), F.col("baseline_sd")).alias("z_score"),
    )


def latency_jumps(frames: DataFrame, config: DetectionConfig) -> DataFrame:
    """End points whose p95 is above the floor and a multiple of the baseline's median."""
    return frames.where(enough_baseline(config) & latency_fires(config)).select(
        "service", "window_start", "window_end", "window_p95", "baseline_p95", latency_ratio().alias("ratio")
    )


def last_seen(lines: DataFrame, now: Column, config: DetectionConfig) -> DataFrame:
    """Per service: the last line within the lookback and the rate in the period before it.

    The period is closed at both ends, unlike every other range.
    """
    lookback = times.shift(now, -config.silence_lookback_minutes * 60)
    horizon = times.shift(now, -(config.silence_lookback_minutes + config.silence_baseline_minutes) * 60)
    recent = lines.where(F.col("timestamp") >= horizon).select("service", "timestamp")
    last = (
        recent.where(F.col("timestamp") >= lookback)
        .groupBy("service")
        .agg(F.max("timestamp").alias("last_seen_at"))
    )
    since = times.shift(F.col("last_seen_at"), -config.silence_baseline_minutes * 60)
    return (
        recent.join(last, "service")
        .where(F.col("timestamp") >= since)
        .groupBy("service", "last_seen_at")
        .agg((F.count(F.lit(1)) / F.lit(float(config.silence_baseline_minutes))).alias("lines_per_minute"))
    )


def silent_services(lines: DataFrame, now: Column, config: DetectionConfig) -> DataFrame:
    """Services that used to send lines steadily and have stopped."""
    minutes = (F.unix_micros(now) - F.unix_micros("last_seen_at")) / F.lit(60_000_000.0)
    return (
        last_seen(lines, now, config)
        .withColumn("_minutes", minutes)
        .where(
            (F.col("_minutes") >= config.silence_min_minutes)
            & (F.col("_minutes") <= config.silence_lookback_minutes)
            & (F.col("lines_per_minute") >= config.silence_min_lines_per_minute)
        )
        .select(
            "service", "last_seen_at", F.floor("_minutes").cast("long").alias("silent_minutes"), "lines_per_minute",
            times.floor_to_bucket(F.col("last_seen_at")).alias("window_start"),
            times.floor_to_bucket(now).alias("window_end"),
        )
    )


def silence_firings(lines: DataFrame, now: Column, config: DetectionConfig) -> DataFrame:
    trigger = make_trigger(
        V.SERVICE_SILENT, F.col("service"), last_seen_at=F.col("last_seen_at"),
        silent_minutes=F.col("silent_minutes"), lines_per_minute=F.col("lines_per_minute"),
    )
    return silent_services(lines, now, config).select(
        "service", "window_start", "window_end", F.array(trigger).alias("triggers")
    )


def _run_detectors(frames: DataFrame, fresh: DataFrame, config: DetectionConfig) -> DataFrame:
    """Add ``triggers`` in the order spike, latency, signature, and the status."""
    service = F.col("service")
    ready = enough_baseline(config)
    spike = F.when(
        ready & error_rate_fires(config),
        make_trigger(
            V.ERROR_RATE_SPIKE, service, observed_errors=F.col("error_count"),
            baseline_mean=F.col("baseline_mean"), baseline_sd=F.col("baseline_sd"),
            z_score=safe_z(F.col("error_rate"), F.col("baseline_mean"), F.col("baseline_sd")),
        ),
    )
    latency = F.when(
        ready & latency_fires(config),
        make_trigger(
            V.LATENCY_JUMP, service, metric=F.lit("p95"), observed_ms=F.col("window_p95"),
            baseline_ms=F.col("baseline_p95"), ratio=latency_ratio(),
        ),
    )
    signature = F.when(
        ready & F.col("signature").isNotNull(),
        make_trigger(
            V.NEW_ERROR_SIGNATURE, service, signature=F.col("signature"),
            sample_message=F.col("sample_message"), occurrences=F.col("occurrences"),
        ),
    )
    skipped = F.when(
        ~ready,
        F.concat(
            F.lit("only "), F.col("baseline_buckets").cast("string"),
            F.lit(f" of {config.min_baseline_buckets} baseline buckets of {config.bucket_seconds} s needed"),
        ),
    )
    return (
        frames.join(fresh, ["service", "window_end"], "left")
        .withColumn("triggers", F.array_compact(F.array(spike, latency, signature)))
        .select(
            "service", "window_start", "window_end", "triggers",
            F.when(~ready, "skipped").when(F.size("triggers") > 0, "firing").otherwise("clean").alias("status"),
            skipped.alias("skipped_reason"),
        )
    )


def backtest(lines: DataFrame, rollup_rows: DataFrame, config: DetectionConfig) -> DataFrame:
    """Status and triggers of every service at every end point, in one plan."""
    return _run_detectors(sliding_frames(rollup_rows, config), new_signatures(lines, config), config)


def reach_of(newest: datetime, config: DetectionConfig) -> datetime:
    """Nothing at the end point of the bucket that begins at ``newest`` looks further back."""
    return newest - timedelta(seconds=config.reach_seconds)


def detect_latest(
    lines: DataFrame,
    rollup_rows: DataFrame,
    config: DetectionConfig,
    now: Column | None = None,
    buckets: DataFrame | None = None,
) -> DataFrame:
    """One detection run at the newest bucket.

    With ``now`` the silence detector runs first; a silent service is not judged by its
    stale window. Its silence is reported as a row of its own with status ``silent``.
    With ``buckets``, the stored signatures by bucket, no line is read but for silence.
    """
    frames = latest_frames(rollup_rows, config)
    if buckets is None:
        fresh = new_signatures_at(lines, frames, config)
    else:
        fresh = new_signatures_stored(buckets, frames, config)
    judged = _run_detectors(frames, fresh, config)
    if now is None:
        return judged
    silent = silence_firings(lines, now, config)
    flags = silent.select("service", F.lit(True).alias("_silent"))
    is_silent = F.coalesce(F.col("_silent"), F.lit(False))
    rest = judged.join(flags, "service", "left").select(
        "service", "window_start", "window_end",
        F.when(is_silent, F.filter("triggers", lambda _: F.lit(False))).otherwise(F.col("triggers")).alias("triggers"),
        F.when(is_silent, "skipped").otherwise(F.col("status")).alias("status"),
        F.when(is_silent, TEXT_SILENT_SERVICE).otherwise(F.col("skipped_reason")).alias("skipped_reason"),
    )
    return rest.unionByName(
        silent.withColumn("status", F.lit("silent")).withColumn("skipped_reason", F.lit(None).cast("string"))
    )


def firings(statuses: DataFrame) -> DataFrame:
    """What fired: the input of incident merging."""
    return statuses.where(F.size("triggers") > 0).select("service", "window_start", "window_end", "triggers")
