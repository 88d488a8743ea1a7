"""Error signatures: how often each occurs, and which are new against their baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog import schemas
from vigilog.config import DetectionConfig
from vigilog.functions import times
from vigilog.operators.frames import spread_over_chunks
from vigilog.sources.increments import Increments
from vigilog.sources.logs import with_bucket


def first_message() -> Column:
    """Aggregate: the earliest line as ``struct(at, seq, message)``, a total order."""
    return F.min(F.struct(F.col("timestamp").alias("at"), F.col("ingest_seq").alias("seq"), F.col("message").alias("message")))


def window_signatures(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and signature: occurrences and the first message seen."""
    return (
        lines.where(F.col("error_signature").isNotNull())
        .groupBy(*keys, "error_signature")
        .agg(F.count(F.lit(1)).alias("occurrences"), first_message().alias("_first"))
        .select(*keys, "error_signature", "occurrences", F.col("_first.message").alias("sample_message"))
    )


def signature_table(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and signature: occurrences and the alphabetically first message."""
    return (
        lines.where(F.col("error_signature").isNotNull())
        .groupBy(*keys, "error_signature")
        .agg(F.count(F.lit(1)).alias("occurrences"), F.min("message").alias("sample_message"))
    )


def signature_buckets(lines: DataFrame, config: DetectionConfig) -> DataFrame:
    """Occurrences and first message per (service, signature, bucket)."""
    return (
        with_bucket(lines.where(F.col("error_signature").isNotNull()), config.bucket_seconds)
        .groupBy("service", "error_signature", "bucket_start")
        .agg(F.count(F.lit(1)).alias("n"), first_message().alias("_first"))
    )


def baseline_signatures(lines: DataFrame) -> DataFrame:
    """Distinct signatures of a range of lines, per service."""
    return lines.where(F.col("error_signature").isNotNull()).select("service", "error_signature").distinct()


def _most_frequent(candidates: DataFrame) -> DataFrame:
    """One signature per end point: most occurrences, then first seen, then alphabetical."""
    order = Window.partitionBy("service", "window_end").orderBy(
        F.col("occurrences").desc(), F.col("_first.at"), F.col("_first.seq"), F.col("error_signature")
    )
    return (
        candidates.withColumn("_rank", F.row_number().over(order))
        .where("_rank = 1")
        .select(
            "service", "window_end", F.col("error_signature").alias("signature"), "occurrences",
            F.col("_first.message").alias("sample_message"),
        )
    )


def new_signatures(lines: DataFrame, config: DetectionConfig) -> DataFrame:
    """For every end point, the most frequent signature that its baseline does not contain.

    Each bucket of a signature counts towards the next ``window_buckets`` end points. Whether
    the baseline contains it is a range frame over the signature's own buckets, not a join.
    """
    step = config.bucket_seconds
    near = config.window_buckets + config.gap_buckets
    seen = signature_buckets(lines, config).withColumn("_own", times.seconds_of(F.col("bucket_start")))
    ends = (
        seen.withColumn("_at", F.explode(F.sequence(F.col("_own"), F.col("_own") + (config.window_buckets - 1) * step, F.lit(step).cast("long"))))
        .groupBy("service", "error_signature", "_at")
        .agg(
            F.sum("n").alias("occurrences"),
            F.min("_first").alias("_first"),
            F.max(F.when(F.col("_own") == F.col("_at"), F.lit(1))).alias("_present"),
        )
    )
    by_time = Window.partitionBy("service", "error_signature", "_chunk").orderBy("_at")
    baseline = by_time.rangeBetween(-(near + config.baseline_buckets - 1) * step, -near * step)
    judged = (
        spread_over_chunks(ends, F.col("_at"), config)
        .withColumn("_known", F.max("_present").over(baseline))
        .where(F.col("_owned") & F.col("_known").isNull() & (F.col("occurrences") >= config.min_occurrences))
        .withColumn("window_end", times.from_seconds(F.col("_at") + step))
    )
    return _most_frequent(judged)


def _ranges(frames: DataFrame, config: DetectionConfig) -> DataFrame:
    """Window and baseline of each service; few rows."""
    baseline_end = times.shift(F.col("window_start"), -config.baseline_offset_seconds)
    return frames.select(
        "service", "window_start", "window_end",
        times.shift(baseline_end, -config.baseline_seconds).alias("_from"), baseline_end.alias("_until"),
    )


def _fresh(joined: DataFrame, at: str, count: Column, first: Column, config: DetectionConfig) -> DataFrame:
    """One pass over window and baseline: how often in the one, whether at all in the other."""
    moment = F.col(at)
    in_window = (moment >= F.col("window_start")) & (moment < F.col("window_end"))
    in_baseline = (moment >= F.col("_from")) & (moment < F.col("_until"))
    judged = (
        joined.where(in_window | in_baseline)
        .groupBy("service", "window_end", "error_signature")
        .agg(
            F.sum(F.when(in_window, count)).alias("occurrences"),
            F.min(F.when(in_window, first)).alias("_first"),
            F.max(in_baseline).alias("_known"),
        )
    )
    return _most_frequent(judged.where(~F.col("_known") & (F.col("occurrences") >= config.min_occurrences)))


def new_signatures_at(lines: DataFrame, frames: DataFrame, config: DetectionConfig) -> DataFrame:
    """The same at one end point per service, from lines.

    Bound the lines by literals to what the frames can see, so that the rest is not read.
    """
    joined = lines.where(F.col("error_signature").isNotNull()).join(_ranges(frames, config), "service")
    first = F.struct(F.col("timestamp").alias("at"), F.col("ingest_seq").alias("seq"), F.col("message").alias("message"))
    return _fresh(joined, "timestamp", F.lit(1), first, config)


def new_signatures_stored(buckets: DataFrame, frames: DataFrame, config: DetectionConfig) -> DataFrame:
    """The same from the stored :func:`signature_buckets`; windows and baselines are whole buckets."""
    return _fresh(buckets.join(_ranges(frames, config), "service"), "bucket_start", F.col("n"), F.col("first"), config)


def stored_buckets(lines: DataFrame, bucket_seconds: int) -> DataFrame:
    """Rows of the table of signatures by bucket, see ``schemas.SIGNATURES``."""
    return (
        with_bucket(lines.where(F.col("error_signature").isNotNull()), bucket_seconds)
        .groupBy("bucket_start", "service", "error_signature")
        .agg(F.count(F.lit(1)).alias("n"), first_message().alias("first"))
    )


def merge_buckets(buckets: DataFrame) -> DataFrame:
    """One row for all rows of a (service, signature, bucket)."""
    return (
        buckets.groupBy("bucket_start", "service", "error_signature")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        .select(*schemas.SIGNATURES.names)
    )


def signature_increments(path: str, every: int = 32) -> Increments:
    """Signatures by bucket as a table that new lines are added to."""
    return Increments(path, schemas.SIGNATURES, merge_buckets, every)
