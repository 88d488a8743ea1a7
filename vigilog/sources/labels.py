"""Golden cases and pinned verdicts: small reviewed label files, read strictly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog import fixed_values as V
from vigilog import schemas

_KINDS = {
    "classification": schemas.CLASSIFICATION_CASE,
    "correlation": schemas.CORRELATION_CASE,
    "diagnosis": schemas.DIAGNOSIS_CASE,
}
DIFF_ARM_PREFIX = "diff-"


def _require(frame: DataFrame, valid, what: str) -> DataFrame:
    """Fail the job on a row that breaks the label format, instead of dropping it."""
    first, *rest = frame.columns
    guarded = F.when(F.coalesce(valid, F.lit(False)), F.col(first)).otherwise(
        F.raise_error(F.concat(F.lit(f"invalid {what}: "), F.coalesce(F.col(first), F.lit("(no name)"))))
    )
    return frame.select(guarded.alias(first), *rest)


def _rows(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def read_labels(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Cases of one kind, one JSON file each, ordered by name."""
    frame = _rows(spark, path, _KINDS[kind])
    named = (F.length("name") >= 1) & (F.length("scenario") >= 1) & (F.length("context") >= 1)
    if kind == "classification":
        valid = named & F.col("expect.isRealIncident").isNotNull() & F.col("expect.severity").isin(V.SEVERITIES)
    elif kind == "correlation":
        sha = F.col("expect.suspectedCommitSha")
        valid = named & F.col("expect").isNotNull() & (sha.isNull() | sha.rlike("^[0-9a-f]{40}$"))
    else:
        valid = named & F.col("sha").rlike("^[0-9a-f]{40}$") & F.col("expect.explainsTheFailure").isNotNull()
    out = _require(frame, valid & F.col("expect.note").isNotNull(), f"{kind} case")
    if kind == "correlation":
        files = F.coalesce(F.col("expect.implicatedFiles"), F.array().cast("array<string>"))
        out = out.withColumn("expect", F.col("expect").withField("implicatedFiles", files))
    if kind == "diagnosis":
        out = out.withColumn("commitFiles", F.coalesce("commitFiles", F.array().cast("array<string>")))
    return out.orderBy("name")


def correlation_arm(cases: DataFrame, arm: str = "default") -> DataFrame:
    """Cases shown with patches or without; the two sets are never mixed."""
    with_diff = F.col("name").startswith(DIFF_ARM_PREFIX)
    return cases.where(with_diff if arm == "diff" else ~with_diff)


def read_pinned_verdicts(spark: SparkSession, path: str) -> DataFrame:
    frame = _rows(spark, path, schemas.PINNED_VERDICT)
    valid = (
        (F.length("scenario") >= 1)
        & F.col("severity").isin(V.SEVERITIES)
        & (F.length("summary") >= 10)
        & (F.length("affectedArea") >= 1)
        & (F.length("model") >= 1)
    )
    return _require(frame, valid, "pinned verdict")


def with_pinned_verdict(rows: DataFrame, pinned: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Attach the fixed verdict of each row's scenario; an unknown scenario fails the job."""
    fixed = pinned.select(
        F.col("scenario").alias("_scenario"),
        F.col("severity").alias("pinned_severity"),
        F.col("summary").alias("pinned_summary"),
        F.col("affectedArea").alias("pinned_area"),
    )
    joined = rows.join(fixed, rows[scenario] == F.col("_scenario"), "left")
    known = F.when(F.col("_scenario").isNotNull(), F.col("pinned_severity")).otherwise(
        F.raise_error(F.concat(F.lit("no pinned verdict for scenario "), F.col(scenario)))
    )
    return joined.withColumn("pinned_severity", known).drop("_scenario")
