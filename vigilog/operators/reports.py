"""Filters, funnels, usage and cost: the reports over the result tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog import fixed_values as V
from vigilog.functions import times
from vigilog.functions.answers import requests_for_call
from vigilog.functions.triggers import has_trigger
from vigilog.operators.evidence import lines_in_windows, window_sample
from vigilog.operators.rollup import bucket_grid
from vigilog.operators.verdicts import latest_correlation, latest_hypothesis


@dataclass(frozen=True)
class AnomalyFilters:
    """What a viewer may ask for. Unknown values ask for nothing."""

    service: str | None = None
    severity: str | None = None
    verdict: str | None = None
    status: str | None = None
    since: str = "all"
    q: str | None = None

    @classmethod
    def parse(cls, params: dict[str, str | list[str] | None]) -> AnomalyFilters:
        def first(name: str) -> str | None:
            value = params.get(name)
            if isinstance(value, list):
                value = value[0] if value else None
            return value.strip() or None if value else None

        def known(name: str, allowed: list[str]) -> str | None:
            value = first(name)
            return value if value in allowed else None

        service, text, since = first("service"), first("q"), first("since")
        return cls(
            service=service or None,
            severity=known("severity", V.SEVERITIES),
            verdict=known("verdict", V.VERDICT_FILTERS),
            status=known("status", V.STATUSES),
            since=since if since in V.SINCE_MINUTES else "all",
            q=text or None,
        )

    @property
    def active(self) -> bool:
        return self != AnomalyFilters()


def _fold_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def search(q: str) -> Column:
    """Case-insensitive (ASCII) substring of summary or service, or prefix of the id.

    The text is taken literally, so no character of it acts as a wildcard.
    """
    needle = _fold_ascii(F.lit(q))
    hit = F.contains(_fold_ascii(F.col("summary")), needle)
    return (
        F.coalesce(hit, F.lit(False))
        | F.contains(_fold_ascii(F.col("service")), needle)
        | F.startswith(_fold_ascii(F.col("anomaly_id")), needle)
    )


def filter_anomalies(anomalies: DataFrame, filters: AnomalyFilters, now: Column) -> DataFrame:
    """All given conditions together."""
    conditions: list[Column] = []
    for name in ("service", "severity", "status"):
        value = getattr(filters, name)
        if value is not None:
            conditions.append(F.col(name) == value)
    verdicts = {
        "real": F.col("is_real_incident"),
        "dismissed": ~F.col("is_real_incident"),
        "unclassified": F.col("severity").isNull(),
        "silent": has_trigger(F.col("triggers"), V.SERVICE_SILENT),
        "injection": F.col("injection_suspected"),
    }
    if filters.verdict in verdicts:
        conditions.append(verdicts[filters.verdict])
    minutes = V.SINCE_MINUTES.get(filters.since)
    if minutes is not None:
        conditions.append(F.col("detected_at") >= times.shift(now, -minutes * 60))
    if filters.q:
        conditions.append(search(filters.q))
    out = anomalies
    for condition in conditions:
        out = out.where(condition)
    return out


def newest_anomalies(anomalies: DataFrame, limit: int = 100, after: tuple[datetime, str] | None = None) -> DataFrame:
    """A page of anomalies, newest first; ``after`` is the (detected_at, anomaly_id) that the page before ended with.

    Pages stay apart and complete while new anomalies come in, as a place is named and not counted.
    """
    if after is not None:
        moment, anomaly_id = times.instant(after[0]), after[1]
        later = (F.col("detected_at") == moment) & (F.col("anomaly_id") > anomaly_id)
        anomalies = anomalies.where((F.col("detected_at") < moment) | later)
    return anomalies.orderBy(F.col("detected_at").desc(), F.col("anomaly_id")).limit(limit)


def services(anomalies: DataFrame) -> DataFrame:
    return anomalies.select("service").distinct().orderBy("service")


# --- funnels ------------------------------------------------------------------------


def classification_funnel(anomalies: DataFrame) -> DataFrame:
    return anomalies.agg(
        F.count(F.lit(1)).alias("anomalies"),
        F.count_if(F.col("severity").isNotNull()).alias("classified"),
        F.count_if(F.col("is_real_incident")).alias("real_incidents"),
        F.count_if(~F.col("is_real_incident")).alias("dismissed"),
    )


def correlation_funnel(anomalies: DataFrame, correlations: DataFrame) -> DataFrame:
    real = anomalies.agg(F.count_if(F.col("is_real_incident")).alias("real_incidents"))
    rows = correlations.agg(
        F.count(F.lit(1)).alias("correlated"),
        F.count("suspected_commit_sha").alias("attributed"),
        F.count_if(F.col("suspected_commit_sha").isNull()).alias("declined"),
    )
    return real.crossJoin(rows)  # one row each


def diagnosis_funnel(correlations: DataFrame, hypotheses: DataFrame) -> DataFrame:
    named = correlations.agg(F.count("suspected_commit_sha").alias("attributed"))
    rows = hypotheses.agg(
        F.count(F.lit(1)).alias("diagnosed"),
        F.count_if(F.col("explains_the_failure")).alias("explained"),
        F.count_if(~F.col("explains_the_failure")).alias("unexplained"),
        F.count_if(F.col("applied")).alias("applied"),
    )
    return named.crossJoin(rows)  # one row each


def funnel(anomalies: DataFrame, correlations: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """The seven counts of the overview."""
    rows = correlations.agg(
        F.count(F.lit(1)).alias("correlated"), F.count("suspected_commit_sha").alias("attributed")
    )
    diagnosed = hypotheses.agg(F.count(F.lit(1)).alias("diagnosed"))
    return classification_funnel(anomalies).crossJoin(rows).crossJoin(diagnosed)  # one row each


def stage_counts(anomalies: DataFrame, correlations: DataFrame) -> DataFrame:
    """Anomalies, real incidents and attributed incidents."""
    first = anomalies.agg(
        F.count(F.lit(1)).alias("anomaly_count"), F.count_if(F.col("is_real_incident")).alias("real_incident_count")
    )
    return first.crossJoin(correlations.agg(F.count("suspected_commit_sha").alias("attributed_count")))


# --- usage and cost -----------------------------------------------------------------


def _usage_columns() -> list[Column]:
    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("long")

    return [
        F.count(F.lit(1)).alias("calls"),
        total(1 + F.col("repair_attempts")).alias("requests"),
        F.count_if(~F.col("succeeded")).alias("failed"),
        total(F.col("repair_attempts")).alias("repairs"),
        total(F.col("input_tokens")).alias("input_tokens"),
        total(F.col("output_tokens")).alias("output_tokens"),
        F.coalesce(F.sum("latency_ms").cast("double") / F.count("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
    ]


def usage(calls: DataFrame) -> DataFrame:
    """Per agent, provider and model; token sums stay NULL if no call reported any."""
    return calls.groupBy("agent", "provider", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.col("succeeded")).alias("failed"),
        F.sum("repair_attempts").alias("repair_attempts"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        (F.sum("latency_ms").cast("double") / F.count("latency_ms")).alias("avg_latency_ms"),
    )


def usage_groups(calls: DataFrame) -> DataFrame:
    """The cost table in one pass: all calls, per agent, and per provider and model."""
    grouped = calls.groupingSets(
        [[], [F.col("agent")], [F.col("provider"), F.col("model")]], F.col("agent"), F.col("provider"), F.col("model")
    ).agg(
        F.grouping("agent").alias("_no_agent"), F.grouping("model").alias("_no_model"), *_usage_columns()
    )
    by_agent, by_model = F.col("_no_agent") == 0, F.col("_no_model") == 0
    return grouped.select(
        F.when(by_agent, "agent").when(by_model, "model").otherwise("total").alias("grouping"),
        F.when(by_agent, F.col("agent"))
        .when(by_model, F.concat_ws(" · ", "provider", "model"))
        .otherwise("all")
        .alias("key"),
        "calls", "requests", "failed", "repairs", "input_tokens", "output_tokens", "avg_latency_ms",
    )


def usage_by_day(calls: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Requests and failures of each of the last days, days without calls included."""
    today = times.utc_day_start(now)
    since = times.shift(today, -(days - 1) * 86_400)
    spine = calls.sparkSession.range(days).select(
        F.to_date(times.shift(since, F.col("id") * 86_400)).alias("day")
    )
    made = (
        calls.where(F.col("created_at") >= since)
        .groupBy(F.to_date("created_at").alias("day"))
        .agg(F.sum(1 + F.col("repair_attempts")).alias("requests"), F.count_if(~F.col("succeeded")).alias("failed"))
    )
    return spine.join(made, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        F.coalesce("requests", F.lit(0)).cast("long").alias("requests"),
        F.coalesce("failed", F.lit(0)).cast("long").alias("failed"),
    )


def used_today(calls: DataFrame, now: Column) -> DataFrame:
    """Requests per provider and model since midnight UTC."""
    return (
        calls.where(F.col("created_at") >= times.utc_day_start(now))
        .groupBy("provider", "model")
        .agg(F.sum(requests_for_call(F.col("repair_attempts"))).cast("long").alias("requests"))
    )


def remaining_requests(today: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Add the daily cap and what is left of it; NULL where there is no cap.

    ``caps`` is a small setting per provider. Local providers are free.
    """
    provider = F.col("provider")
    cap = F.coalesce(*[F.when(provider == name, F.lit(value)) for name, value in caps.items()], F.lit(None)).cast("long")
    cap = F.when(~provider.isin(V.LOCAL_PROVIDERS), cap)
    left = F.greatest(F.lit(0).cast("long"), cap - F.col("requests"))
    return today.withColumn("cap", cap).withColumn("remaining", F.when(cap.isNotNull(), left)).withColumn(
        "is_local", provider.isin(V.LOCAL_PROVIDERS)
    )


def cost_totals(calls: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Failure rate, and how many anomalies ever cost a call."""
    spent = calls.agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.col("succeeded")).alias("failed"),
        F.count_distinct("anomaly_id").alias("anomalies_with_calls"),
    )
    known = anomalies.agg(F.count(F.lit(1)).alias("anomalies_total"))
    rate = F.when(F.col("calls") > 0, F.col("failed") / F.col("calls")).otherwise(F.lit(0.0))
    return spent.crossJoin(known).select("*", rate.alias("failure_rate"))  # one row each


def call_tokens(attempts: DataFrame) -> DataFrame:
    """Calls from their attempts: reported tokens add up, failed attempts count as repairs."""
    return attempts.groupBy("call_id").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count_if(~F.col("succeeded")).alias("repair_attempts"),
        F.max("succeeded").alias("succeeded"),
    )


# --- views of single anomalies ------------------------------------------------------


def timeline_ranges(anomalies: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    start, end = times.chart_range(F.col("window_start"), F.col("window_end"), bucket_seconds=bucket_seconds)
    return anomalies.select("anomaly_id", "service", start.alias("range_start"), end.alias("range_end"))


def timeline_page(
    anomalies: DataFrame, rollup_rows: DataFrame, filters: AnomalyFilters, now: Column,
    limit: int = 100, bucket_seconds: int = 60, after: tuple[datetime, str] | None = None,
) -> DataFrame:
    """A page of matching anomalies (see :func:`newest_anomalies`), each with the sparkline around its window.

    A sparkline has a fixed greatest length, so the collected lists are small.
    """
    rows = newest_anomalies(filter_anomalies(anomalies, filters, now), limit, after)
    grid = bucket_grid(timeline_ranges(rows, bucket_seconds), rollup_rows, bucket_seconds)
    lines = grid.groupBy("anomaly_id").agg(
        F.array_sort(F.collect_list(F.struct("bucket_start", "requests", "errors", "p95"))).alias("sparkline")
    )
    return rows.join(lines, "anomaly_id", "left")


def call_log(calls: DataFrame, anomaly_id: str) -> DataFrame:
    return calls.where(F.col("anomaly_id") == anomaly_id).orderBy("created_at", "call_id")


def alert_log(alerts: DataFrame, anomaly_id: str) -> DataFrame:
    return alerts.where(F.col("anomaly_id") == anomaly_id).orderBy("created_at", "reason", "channel")


def anomaly_trace(
    anomaly_id: str, anomalies: DataFrame, correlations: DataFrame, hypotheses: DataFrame, calls: DataFrame,
    alerts: DataFrame, lines: DataFrame, rollup_rows: DataFrame, packets: DataFrame, bucket_seconds: int = 60,
) -> dict[str, DataFrame]:
    """Everything recorded about one anomaly, as one small frame per part."""
    one = anomalies.where(F.col("anomaly_id") == anomaly_id)
    same = F.col("anomaly_id") == anomaly_id
    return {
        "anomaly": one,
        "correlation": latest_correlation(correlations.where(same)),
        "hypothesis": latest_hypothesis(hypotheses.where(same)),
        "calls": call_log(calls, anomaly_id),
        "alerts": alert_log(alerts, anomaly_id),
        "sample": window_sample(lines_in_windows(one, lines, bucket_seconds)),
        "series": bucket_grid(timeline_ranges(one, bucket_seconds), rollup_rows, bucket_seconds).orderBy("bucket_start"),
        "packet": packets.where(same),
    }
