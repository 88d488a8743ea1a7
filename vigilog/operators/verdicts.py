"""Answers to packets: reading them, applying them, and queues of what is still open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog import fixed_values as V
from vigilog.functions import answers as A
from vigilog.functions.triggers import has_readable_trigger, kinds, severity_for_score, trigger_score
from vigilog.operators.candidates import ground_correlations
from vigilog.sources.tables import latest_per

TEXT_NO_JSON = "(root): no JSON object in the response"

def parse_responses(responses: DataFrame, agent: str, text: str = "response") -> DataFrame:
    """Add ``answer`` (variant) and ``issues``; an answer is valid if it has none.

    Types are checked strictly: a number is not taken for a string, and an absent field is
    not taken for an explicit null.
    """
    objects = responses.withColumn("_json", A.extract_json_object(F.col(text))).withColumn(
        "answer", F.try_parse_json("_json")
    )
    unpacked = A.unpack(objects, "answer", A.ANSWER_FIELDS[agent], "_")
    issues = F.when(A.is_object(F.col("answer")), A.answer_issues(agent)).otherwise(F.array(F.lit(TEXT_NO_JSON)))
    return unpacked.select(*responses.columns, "answer", issues.alias("issues"))


_ANSWER_COLUMNS = {
    "classifier": [
        ("severity", "severity", "string"), ("summary", "summary", "string"),
        ("isRealIncident", "is_real_incident", "boolean"), ("affectedArea", "affected_area", "string"),
    ],
    "correlator": [
        ("suspectedCommitSha", "suspected_commit_sha", "string"), ("confidence", "confidence", "double"),
        ("reasoning", "reasoning", "string"), ("changedFilesImplicated", "implicated_files", "array<string>"),
    ],
    "root_cause": [
        ("explainsTheFailure", "explains_the_failure", "boolean"), ("rootCause", "root_cause", "string"),
        ("suggestedFix", "suggested_fix", "string"), ("confidence", "confidence", "double"),
    ],
}


def typed_answers(parsed: DataFrame, agent: str) -> DataFrame:
    """Typed columns of every answer, NULL where it is not valid; ``issues`` stays."""
    rest = [c for c in parsed.columns if c != "answer"]
    columns = [
        F.when(F.size("issues") == 0, F.try_variant_get("answer", f"$.{name}", kind)).alias(alias)
        for name, alias, kind in _ANSWER_COLUMNS[agent]
    ]
    return parsed.select(*rest, *columns)


def valid_answers(parsed: DataFrame, agent: str) -> DataFrame:
    return typed_answers(parsed, agent).where(F.size("issues") == 0).drop("issues")


def failed_answers(parsed: DataFrame) -> DataFrame:
    rest = [c for c in parsed.columns if c not in ("answer", "issues")]
    return parsed.where(F.size("issues") > 0).select(*rest, F.array_join("issues", "\n").alias("error"))


# --- baselines that need no model ---------------------------------------------------


def statistical_verdict(anomalies: DataFrame) -> DataFrame:
    """Verdict from the detectors that fired alone: a weighted score decides."""
    score = trigger_score(F.col("triggers"))
    count = F.size("triggers").cast("string")
    names = F.when(F.size("triggers") > 0, F.array_join(kinds(F.col("triggers")), ", ")).otherwise("none")
    return anomalies.select(
        "anomaly_id",
        severity_for_score(score).alias("severity"),
        F.concat(
            F.lit("Statistical verdict for "), F.col("service"), F.lit(": "), count,
            F.lit(" signal(s) fired ("), names, F.lit(")."),
        ).alias("summary"),
        (score >= 2).alias("is_real_incident"),
        F.col("service").alias("affected_area"),
    )


def decline_verdict(pending: DataFrame) -> DataFrame:
    """Baseline diagnosis: always declines."""
    return pending.select(
        "anomaly_id",
        F.lit(False).alias("explains_the_failure"),
        F.lit("No mechanism can be derived without reading the patch.").alias("root_cause"),
        F.lit("None proposed.").alias("suggested_fix"),
        F.lit(0.1).alias("confidence"),
    )


# --- queues -------------------------------------------------------------------------


def _excluding(rows: DataFrame, exclude: DataFrame | None) -> DataFrame:
    return rows if exclude is None else rows.join(exclude.select("anomaly_id").distinct(), "anomaly_id", "left_anti")


def _oldest(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy("detected_at", "anomaly_id").limit(limit)


def pending_classification(anomalies: DataFrame, limit: int = 10, exclude: DataFrame | None = None) -> DataFrame:
    """Unclassified anomalies that left something to read, oldest first."""
    open_rows = anomalies.where(F.col("severity").isNull() & has_readable_trigger(F.col("triggers")))
    return _oldest(_excluding(open_rows, exclude), limit)


def uncorrelated(anomalies: DataFrame, correlations: DataFrame) -> DataFrame:
    """Real incidents without any correlation row; a declined one counts as a row."""
    done = correlations.select("anomaly_id").distinct()
    return anomalies.where(F.col("is_real_incident")).join(done, "anomaly_id", "left_anti")


def pending_correlation(
    anomalies: DataFrame, correlations: DataFrame, limit: int = 10, exclude: DataFrame | None = None
) -> DataFrame:
    return _oldest(_excluding(uncorrelated(anomalies, correlations), exclude), limit)


def attributed(anomalies: DataFrame, correlations: DataFrame) -> DataFrame:
    """Anomalies joined with the correlations that name a commit."""
    named = correlations.where(F.col("suspected_commit_sha").isNotNull()).select(
        "anomaly_id", F.col("suspected_commit_sha").alias("sha"), "confidence", "reasoning", "implicated_files"
    )
    return anomalies.join(named, "anomaly_id")


def pending_diagnosis(
    anomalies: DataFrame, correlations: DataFrame, hypotheses: DataFrame, limit: int = 10,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """Attributed real incidents without a hypothesis, oldest first."""
    done = hypotheses.select("anomaly_id").distinct()
    rows = attributed(anomalies.where(F.col("is_real_incident")), correlations).join(done, "anomaly_id", "left_anti")
    return _oldest(_excluding(rows, exclude), limit)


def most_recent(anomalies: DataFrame, only_real: bool = False) -> DataFrame:
    rows = anomalies.where(F.col("is_real_incident")) if only_real else anomalies
    return rows.orderBy(F.col("detected_at").desc(), F.col("anomaly_id")).limit(1)


# --- applying answers ---------------------------------------------------------------


def apply_verdicts(anomalies: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Set the verdict of the anomalies that got a valid one; benign ones are dismissed.

    Anomalies without a valid verdict keep their NULLs, which keeps them in the queue.
    """
    given = verdicts.select(
        "anomaly_id",
        *[F.col(c).alias(f"_{c}") for c in ("severity", "summary", "is_real_incident", "affected_area")],
    )
    hit = F.col("_severity").isNotNull()

    def updated(name: str) -> Column:
        return F.when(hit, F.col(f"_{name}")).otherwise(F.col(name)).alias(name)

    changed = ("severity", "summary", "is_real_incident", "affected_area")
    status = F.when(hit, F.when(F.col("_is_real_incident"), "open").otherwise("dismissed")).otherwise(F.col("status"))
    joined = anomalies.join(given, "anomaly_id", "left")
    return joined.select(
        *[updated(c) if c in changed else status.alias("status") if c == "status" else F.col(c) for c in anomalies.columns]
    )


def override_verdicts(anomalies: DataFrame, pinned: DataFrame, key: str = "anomaly_id") -> DataFrame:
    """Verdict columns with a pinned verdict taking precedence where there is one."""
    fixed = pinned.select(
        key, F.col("severity").alias("_severity"), F.col("summary").alias("_summary"),
        F.col("affected_area").alias("_affected_area"),
    )
    joined = anomalies.join(fixed, key, "left")
    names = ("severity", "summary", "affected_area")
    return joined.select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in anomalies.columns]
    )


def _with_status(anomalies: DataFrame, done: DataFrame, status: str) -> DataFrame:
    flags = done.select("anomaly_id").distinct().withColumn("_done", F.lit(True))
    new = F.when(F.col("_done"), status).otherwise(F.col("status"))
    return anomalies.join(flags, "anomaly_id", "left").select(
        *[new.alias("status") if c == "status" else F.col(c) for c in anomalies.columns]
    )


def apply_correlations(
    anomalies: DataFrame, answers: DataFrame, candidates: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grounded answers become correlation rows and set the status; others store nothing.

    Returns (correlation rows, anomalies, failures).
    """
    judged = ground_correlations(answers, candidates)
    good = judged.where("grounded")
    rows = good.select(
        "anomaly_id", F.col("sha").alias("suspected_commit_sha"), "confidence", "reasoning",
        F.col("kept_files").alias("implicated_files"), now.alias("created_at"),
    )
    return rows, _with_status(anomalies, good, "correlated"), judged.where(~F.col("grounded"))


def apply_hypotheses(anomalies: DataFrame, answers: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Hypothesis rows and the anomalies they diagnose. Nothing is ever marked as applied."""
    rows = answers.select(
        "anomaly_id", "explains_the_failure", "root_cause", "suggested_fix", "confidence",
        F.lit(False).alias("applied"), now.alias("created_at"),
    )
    return rows, _with_status(anomalies, answers, "diagnosed")


def latest_correlation(correlations: DataFrame) -> DataFrame:
    return latest_per(correlations, ["anomaly_id"], F.col("created_at").desc(), F.col("suspected_commit_sha"))


def latest_hypothesis(hypotheses: DataFrame) -> DataFrame:
    return latest_per(hypotheses, ["anomaly_id"], F.col("created_at").desc(), F.col("root_cause"))
