"""Scoring answers against labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions.answers import check_grounding, fix_names_commit_file, sha_matches
from vigilog.functions.numbers import round_half_up
from vigilog.functions.triggers import severity_distance


def match_cases(cases: DataFrame, answers: DataFrame, key: str = "name") -> DataFrame:
    """Every case with its answer; ``answered`` is false where there is none.

    ``cases`` carries expected columns as ``expected_*``. Answers may say themselves, in a column
    ``answered``, that they failed.
    """
    given = answers if "answered" in answers.columns else answers.withColumn("answered", F.lit(True))
    return cases.join(given, key, "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def classification_scores(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Per case: verdict, severity and grounding, each judged on its own.

    Cases: ``name, expected_is_real, expected_severity, context``. Answers: ``name,
    severity, is_real_incident, affected_area, latency_ms, repair_attempts, input_tokens,
    output_tokens``.
    """
    distance = severity_distance(F.col("expected_severity"), F.col("severity"))
    grounded = check_grounding(F.col("affected_area"), F.col("context"))
    answered = F.col("answered")
    return match_cases(cases, answers).select(
        "name", "answered",
        (~F.col("expected_is_real")).alias("benign_case"),
        F.when(answered, F.col("is_real_incident") == F.col("expected_is_real")).alias("verdict_correct"),
        F.when(answered, distance == 0).alias("severity_exact"),
        F.when(answered, distance <= 1).alias("severity_within_one"),
        F.when(answered, grounded).alias("grounded"),
        "latency_ms", "repair_attempts", "input_tokens", "output_tokens",
    )


def _cost_columns() -> list[Column]:
    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("answered"), F.col(name))), F.lit(0)).cast("long")

    answered = F.count_if(F.col("answered"))
    mean = F.try_divide(F.sum(F.when(F.col("answered"), F.col("latency_ms"))).cast("double"), answered)
    return [
        F.count_if(~F.col("answered")).alias("failures"),
        total("repair_attempts").alias("total_repairs"),
        total("input_tokens").alias("total_input_tokens"),
        total("output_tokens").alias("total_output_tokens"),
        F.coalesce(round_half_up(mean), F.lit(0)).cast("long").alias("mean_latency_ms"),
    ]


def _tally(name: str, right: Column, among: Column) -> list[Column]:
    return [
        F.count_if(F.col("answered") & among & right).alias(f"{name}_correct"),
        F.count_if(F.col("answered") & among).alias(f"{name}_total"),
    ]


def summarise_classification(scores: DataFrame) -> DataFrame:
    """Dismissals and incidents apart: confirming everything must not look good."""
    benign = F.col("benign_case")
    return scores.agg(
        F.count_if(F.col("answered")).alias("total"),
        *_tally("dismissals", F.col("verdict_correct"), benign),
        *_tally("incidents", F.col("verdict_correct"), ~benign),
        F.count_if(F.col("verdict_correct")).alias("verdict_correct"),
        F.count_if(F.col("severity_exact")).alias("severity_exact"),
        F.count_if(F.col("severity_within_one")).alias("severity_within_one"),
        F.count_if(F.col("grounded")).alias("grounded"),
        *_cost_columns(),
    )


def correlation_scores(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Per case: attribution, and the files only where the attribution is right.

    Cases: ``name, expected_sha, expected_files``. Answers: ``name, suspected_commit_sha,
    implicated_files, confidence`` and the cost columns.
    """
    answered = F.col("answered")
    right = sha_matches(F.col("suspected_commit_sha"), F.col("expected_sha"))
    decline = F.col("expected_sha").isNull()
    score_files = answered & right & ~decline & (F.size("expected_files") > 0)
    missing = F.array_except("expected_files", "implicated_files")
    return match_cases(cases, answers).select(
        "name", "answered",
        decline.alias("decline_case"),
        F.when(answered, right).alias("attribution_correct"),
        F.when(score_files, F.size(missing) == 0).alias("files_correct"),
        F.when(score_files, missing).otherwise(F.array().cast("array<string>")).alias("missing_files"),
        "confidence", "latency_ms", "repair_attempts", "input_tokens", "output_tokens",
    )


def _confidence(right: Column) -> list[Column]:
    """Mean confidence of right and of wrong answers; NULL if there are none."""
    return [
        F.avg(F.when(F.col("answered") & right, F.col("confidence"))).alias("confidence_when_correct"),
        F.avg(F.when(F.col("answered") & ~right, F.col("confidence"))).alias("confidence_when_wrong"),
    ]


def summarise_correlation(scores: DataFrame) -> DataFrame:
    right, decline = F.col("attribution_correct"), F.col("decline_case")
    return scores.agg(
        F.count_if(F.col("answered")).alias("total"),
        *_tally("attributions", right, ~decline),
        *_tally("declines", right, decline),
        F.count_if(F.col("files_correct")).alias("files_correct"),
        F.count("files_correct").alias("files_total"),
        *_confidence(right),
        *_cost_columns(),
    )


def diagnosis_scores(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Per case: the judgement, and whether the fix names a changed file.

    The fix is only looked at where the answer claims the commit explains the failure.
    Cases: ``name, expected_explains, commit_files``. Answers: ``name,
    explains_the_failure, suggested_fix, confidence`` and the cost columns.
    """
    answered = F.col("answered")
    claims = answered & F.col("explains_the_failure")
    return match_cases(cases, answers).select(
        "name", "answered",
        (~F.col("expected_explains")).alias("reject_case"),
        F.when(answered, F.col("explains_the_failure") == F.col("expected_explains")).alias("judgement_correct"),
        F.when(claims, fix_names_commit_file(F.col("suggested_fix"), F.col("commit_files"))).alias("fix_grounded"),
        "confidence", "latency_ms", "repair_attempts", "input_tokens", "output_tokens",
    )


def summarise_diagnosis(scores: DataFrame) -> DataFrame:
    right, reject = F.col("judgement_correct"), F.col("reject_case")
    return scores.agg(
        F.count_if(F.col("answered")).alias("total"),
        *_tally("explains", right, ~reject),
        *_tally("rejects", right, reject),
        F.count_if(F.col("fix_grounded")).alias("fixes_grounded"),
        F.count("fix_grounded").alias("fixes_total"),
        *_confidence(right),
        *_cost_columns(),
    )
