"""Relating incidents to commits: the candidate search, and checking answers against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.config import CommitBudget
from vigilog.functions import times
from vigilog.functions.text import trim_space
from vigilog.operators.sampling import cap_rows

HOUR, MINUTE = 3600, 60


def _search_cells(lookback: int) -> Column:
    """Hours that lie wholly in the search of an anomaly, and the minutes at its two ends."""
    since, until = F.col("_until") - lookback, F.col("_until")
    first_hour, last_hour = F.floor(since / HOUR), F.floor(until / HOUR)
    first, last = F.floor(since / MINUTE), F.floor(until / MINUTE)
    per_hour = HOUR // MINUTE

    def cells(low: Column, high: Column, width: int) -> Column:
        numbers = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(numbers, lambda n: F.struct(F.lit(width).alias("width"), n.alias("cell")))

    spread = F.concat(
        cells(first, (first_hour + 1) * per_hour - 1, MINUTE),
        cells(first_hour + 1, last_hour - 1, HOUR),
        cells(last_hour * per_hour, last, MINUTE),
    )
    return F.when(first_hour < last_hour, spread).otherwise(cells(first, last, MINUTE))


def candidate_commits(anomalies: DataFrame, commits: DataFrame, budget: CommitBudget = CommitBudget()) -> DataFrame:
    """The newest commits of the two days up to each window's end, both ends included.

    ``found`` is the number of all commits in that span, shown or not. Commits are counted per
    hour and minute; going back from the end, only the cells that can still hold one of the newest
    are joined, each with its newest commits only (sha and time), so that pairs do not grow with
    the density of commits. Cells at the very ends are joined whole, as they lie partly outside.
    The other columns are attached to the commits that are kept.
    """
    lookback = budget.lookback_hours * 3600
    moment = F.col("committed_at")
    searched = anomalies.select(
        "anomaly_id",
        times.shift(F.col("window_end"), -lookback).alias("since"),
        F.col("window_end").alias("until"),
        times.seconds_of(F.col("window_end")).alias("_until"),
    )
    ends = F.array(*[F.floor((F.col("_until") - ago) / MINUTE) for ago in (0, lookback)])
    cells = searched.withColumn("_at", F.explode(_search_cells(lookback))).select(
        "anomaly_id", "since", "until",
        F.col("_at.width").alias("_width"), F.col("_at.cell").alias("_cell"),
        ((F.col("_at.width") == MINUTE) & F.array_contains(ends, F.col("_at.cell"))).alias("_end"),
    )
    seconds = times.seconds_of(moment)
    light = commits.select("sha", "committed_at").withColumn("_width", F.explode(F.array(F.lit(HOUR), F.lit(MINUTE))))
    light = light.withColumn("_cell", F.floor(seconds / F.col("_width")))
    key = ["_width", "_cell"]
    newest_first = [moment.desc(), F.col("sha")]
    counts = light.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    capped = cap_rows(light, key, newest_first, budget.commits)

    inside = (moment >= F.col("since")) & (moment <= F.col("until"))
    at_ends = cells.where("_end").join(light, key).where(inside)
    whole = cells.where(~F.col("_end")).join(counts, key)
    newer = (
        Window.partitionBy("anomaly_id")
        .orderBy((F.col("_cell") * F.col("_width")).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    needed = whole.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
    needed = needed.where(F.col("_newer") < budget.commits)
    keep = ["anomaly_id", "since", "until", "sha", "committed_at"]
    pairs = needed.join(capped, key).select(*keep).unionByName(at_ends.select(*keep))
    order = Window.partitionBy("anomaly_id").orderBy(*newest_first)
    ranked = pairs.withColumn("position", F.row_number().over(order)).where(F.col("position") <= budget.commits)
    found = (
        whole.select("anomaly_id", "_n")
        .unionByName(at_ends.select("anomaly_id", F.lit(1).cast("long").alias("_n")))
        .groupBy("anomaly_id")
        .agg(F.sum("_n").alias("found"))
    )
    return ranked.join(found, "anomaly_id").join(commits, ["sha", "committed_at"])


def newest_commit_verdict(anomalies: DataFrame, candidates: DataFrame) -> DataFrame:
    """Baseline: blame the newest candidate; decline if there is none."""
    newest = candidates.where("position = 1").select("anomaly_id", F.col("sha").alias("suspected_commit_sha"))
    named = F.col("suspected_commit_sha").isNotNull()
    return anomalies.select("anomaly_id").join(newest, "anomaly_id", "left").select(
        "anomaly_id",
        F.substring("suspected_commit_sha", 1, 10).alias("suspected_commit_sha"),
        F.when(named, F.lit(0.25)).otherwise(F.lit(0.1)).alias("confidence"),
        F.when(named, "Baseline answer: the latest candidate.")
        .otherwise("Baseline answer: no candidates.")
        .alias("reasoning"),
        F.array().cast("array<string>").alias("implicated_files"),
    )


def resolve_sha(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Match each answered sha, as a prefix, against the candidates that were shown.

    Adds ``sha`` (the full one, if exactly one candidate matches), ``candidate_count`` and
    ``grounded``. A declined answer (NULL) is grounded. An anomaly has at most
    ``CommitBudget.commits`` candidates, which bounds the pairs.
    """
    needle = F.lower(trim_space(F.col("suspected_commit_sha")))
    shown = candidates.select("anomaly_id", F.col("sha").alias("_sha"), F.col("files").alias("_files"))
    hit = F.col("_sha").startswith(needle)
    judged = answers.join(shown, "anomaly_id", "left").groupBy("anomaly_id").agg(
        F.count("_sha").alias("candidate_count"),
        F.count_if(hit).alias("_hits"),
        F.max(F.when(hit, F.struct("_sha", F.transform("_files", lambda f: f["path"]).alias("paths")))).alias("_hit"),
    )
    one = F.col("_hits") == 1
    return (
        answers.join(judged, "anomaly_id")
        .withColumn("sha", F.when(one, F.col("_hit._sha")))
        .withColumn("_paths", F.when(one, F.col("_hit.paths")))
        .withColumn("grounded", F.col("suspected_commit_sha").isNull() | one)
        .drop("_hits", "_hit")
    )


def split_files(named: Column, paths: Column) -> tuple[Column, Column]:
    """Named files that the commit changed, and those it did not; order is kept."""
    known = F.coalesce(paths, F.array().cast("array<string>"))
    return (
        F.filter(named, lambda path: F.array_contains(known, path)),
        F.filter(named, lambda path: ~F.array_contains(known, path)),
    )


def ground_correlations(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Answers with resolved sha, kept and dropped files, and the reason of a failure."""
    resolved = resolve_sha(answers, candidates)
    kept, dropped = split_files(F.col("implicated_files"), F.col("_paths"))
    reason = F.concat(
        F.lit('the answer names "'), F.col("suspected_commit_sha"),
        F.lit('", not one of the '), F.col("candidate_count").cast("string"),
        F.lit(" candidates listed"),
    )
    return resolved.select(
        *answers.columns, "sha", "candidate_count", "grounded",
        kept.alias("kept_files"), dropped.alias("dropped_files"),
        F.when(~F.col("grounded"), reason).alias("error"),
    )


def diff_allowance(candidates: DataFrame, budget: CommitBudget = CommitBudget()) -> DataFrame:
    """Add ``diff_budget``: patch lines a commit may show, newest commits first.

    Each commit costs at most its own limit, and none is left once the total is spent.
    """
    lines = F.when(F.coalesce(F.length("diff"), F.lit(0)) > 0, F.size(F.split("diff", "\n"))).otherwise(0)
    cost = F.least(lines, F.lit(budget.diff_lines_per_commit))
    before = Window.partitionBy("anomaly_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(cost).over(before), F.lit(0))
    return candidates.withColumn("diff_lines", lines).withColumn(
        "diff_budget", F.greatest(F.lit(budget.diff_lines_total) - spent, F.lit(0)).cast("long")
    )


def blamed_commits(pending: DataFrame, commits: DataFrame) -> DataFrame:
    """Attach the commit of an exact sha; a missing one leaves an ``error``."""
    joined = pending.join(commits, "sha", "left")
    gone = F.concat(F.lit("commit "), F.substring("sha", 1, 10), F.lit(" is missing from the commit table"))
    return joined.withColumn("error", F.when(F.col("committed_at").isNull(), gone))

