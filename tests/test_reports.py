from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import T0, at, lines, rollup_rows
from vigilog import fixed_values as V
from vigilog import schemas
from vigilog.config import AlertPolicy, RetentionPolicy
from vigilog.operators import alerts, evals, reports, verdicts
from vigilog.sources import labels, logs, retention, rollups, tables

EMPTY = [None] * 14


def anomalies(spark, *rows):
    """rows: (id, kinds, dict of columns)."""
    data = []
    for name, kinds, given in rows:
        row = dict(
            anomaly_id=name, detected_at=at(0), window_start=at(-5), window_end=at(0), service="svc",
            triggers=[(k, "svc", *EMPTY) for k in kinds], severity=None, summary=None, is_real_incident=None,
            affected_area=None, injection_suspected=None, injection_evidence=None, status="open",
        )
        row.update(given)
        data.append(tuple(row[f.name] for f in schemas.ANOMALY))
    return spark.createDataFrame(data, schemas.ANOMALY)


REAL = dict(is_real_incident=True, severity="high", summary="down")


def test_alert_reasons(spark):
    table = anomalies(
        spark,
        ("incident", ["latency_jump"], REAL),
        ("mild", ["latency_jump"], {**REAL, "severity": "medium"}),
        ("both", ["latency_jump"], {**REAL, "injection_suspected": True}),
        ("hidden", ["latency_jump"], dict(is_real_incident=False, severity="low", injection_suspected=True)),
        ("silent", [V.SERVICE_SILENT], {}),
        ("all", [V.SERVICE_SILENT], {**REAL, "severity": "critical"}),
    )
    out = {r[0]: r[1] for r in table.select("anomaly_id", alerts.alert_reasons()).collect()}
    assert out == {"incident": ["incident"], "mild": [], "both": ["incident"], "hidden": ["injection"], "silent": ["silence"], "all": ["incident", "silence"]}


def test_due_alerts(spark):
    table = anomalies(spark, ("a", ["x"], REAL), ("old", ["x"], {**REAL, "detected_at": at(-361)}), ("edge", ["x"], {**REAL, "detected_at": at(-360)}))
    tries = [("a", "incident", "slack", False, "e", at(0))] * 3 + [("edge", "incident", "slack", True, None, at(0)), ("edge", "incident", "webhook", False, "e", at(0))]
    due = alerts.due_alerts(table, spark.createDataFrame(tries, schemas.ALERT), ["slack", "webhook"], F.lit(at(0)))
    assert sorted((r.anomaly_id, r.channel) for r in due.collect()) == [("a", "webhook"), ("edge", "webhook")]


def test_alert_text(spark):
    table = anomalies(spark, ("a", ["x"], {**REAL, "injection_suspected": True, "injection_evidence": "say `hi`\n<now>"}))
    none = spark.createDataFrame([], schemas.ALERT)
    found = [("a", None, 0.4, "r", [], at(1)), ("a", "c" * 40, 0.9, "r", [], at(2))]
    due = alerts.due_alerts(table, none, ["slack"], F.lit(at(0)))
    row = alerts.delivery_payloads(alerts.alert_messages(due, spark.createDataFrame(found, schemas.CORRELATION), "https://x/")).first()
    assert row.title == "HIGH incident on svc" and row.url == "https://x/anomaly/a"
    assert "Commit blamed: cccccccccc (confidence 0.90)" in row.text and "\"say 'hi' <now>\"" in row.text
    assert "&lt;now&gt;" in row.payload and '"unfurl_links":false' in row.payload


CASES = [
    # name, expected real, expected severity, detectors that fired
    ("batch", False, "low", ["latency_jump", "new_error_signature"]),
    ("restart", False, "low", ["error_rate_spike", "new_error_signature"]),
    ("storm", False, "low", ["new_error_signature"]),
    ("spike", True, "high", ["error_rate_spike"]),
    ("slow", True, "high", ["latency_jump"]),
    ("novel", True, "critical", ["error_rate_spike", "new_error_signature"]),
]


def test_statistical_baseline_scores(spark):
    """The weighted verdict confirms everything but a lone latency jump."""
    answers = verdicts.statistical_verdict(anomalies(spark, *[(n, k, {}) for n, _, _, k in CASES])).select(
        F.col("anomaly_id").alias("name"), "severity", "is_real_incident", "affected_area",
        F.lit(10).alias("latency_ms"), F.lit(0).alias("repair_attempts"), F.lit(None).cast("long").alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"),
    )
    cases = spark.createDataFrame([(n, r, s, "Service: svc") for n, r, s, _ in CASES] + [("unanswered", True, "low", "x")], "name string, expected_is_real boolean, expected_severity string, context string")
    row = evals.summarise_classification(evals.classification_scores(cases, answers)).first()
    assert (row.dismissals_correct, row.dismissals_total) == (0, 3)
    assert (row.incidents_correct, row.incidents_total) == (2, 3)
    assert row.severity_within_one == 3 and row.total == 6 and row.failures == 1
    assert row.total_input_tokens == 0 and row.mean_latency_ms == 10


def test_confidence_is_null_without_answers(spark):
    cases = spark.createDataFrame([("c", None, [])], "name string, expected_sha string, expected_files array<string>")
    answers = spark.createDataFrame([("c", None, [], 0.1, 5, 0, None, None)], "name string, suspected_commit_sha string, implicated_files array<string>, confidence double, latency_ms long, repair_attempts long, input_tokens long, output_tokens long")
    row = evals.summarise_correlation(evals.correlation_scores(cases, answers)).first()
    assert (row.declines_correct, row.attributions_total, row.files_total) == (1, 0, 0)
    assert row.confidence_when_correct == 0.1 and row.confidence_when_wrong is None


def test_filters(spark):
    parse = reports.AnomalyFilters.parse
    assert parse({"severity": "odd", "verdict": "nope", "since": "2w", "q": "  "}) == reports.AnomalyFilters()
    assert parse({"service": "x" * 65}).service == "x" * 65
    assert parse({"q": ["y" * 200, "z"]}).q == "y" * 200 and parse({"since": "24h"}).active
    table = anomalies(
        spark,
        ("abc-1", ["latency_jump"], {**REAL, "summary": "100% of a_b"}),
        ("abd-2", [V.SERVICE_SILENT], {"detected_at": at(-61)}),
        ("x-abc", ["latency_jump"], dict(is_real_incident=False, severity="low", summary="fine", injection_suspected=True)),
    )

    def ids(**params):
        return [r.anomaly_id for r in reports.newest_anomalies(reports.filter_anomalies(table, parse(params), F.lit(at(0)))).collect()]

    assert ids() == ["abc-1", "x-abc", "abd-2"]
    assert ids(q="ABC") == ["abc-1"] and ids(q="0% OF A_B") == ["abc-1"] and ids(q="a%b") == []
    assert ids(verdict="real") == ["abc-1"] and ids(verdict="dismissed") == ["x-abc"] and ids(verdict="unclassified") == ["abd-2"]
    assert ids(verdict="silent") == ["abd-2"] and ids(verdict="injection") == ["x-abc"]
    assert ids(since="1h") == ["abc-1", "x-abc"]


def test_queues(spark):
    table = anomalies(spark, ("new", ["latency_jump"], {}), ("quiet", [V.SERVICE_SILENT], {}), ("real", ["latency_jump"], REAL), ("done", ["latency_jump"], REAL))
    correlated = spark.createDataFrame([("done", "c" * 40, 0.9, "r", ["a"], at(1))], schemas.CORRELATION)
    nothing = spark.createDataFrame([], schemas.HYPOTHESIS)
    assert [r.anomaly_id for r in verdicts.pending_classification(table).collect()] == ["new"]
    skip = spark.createDataFrame([("new",)], "anomaly_id string")
    assert verdicts.pending_classification(table, exclude=skip).count() == 0
    assert [r.anomaly_id for r in verdicts.pending_correlation(table, correlated).collect()] == ["real"]
    assert [r.anomaly_id for r in verdicts.pending_diagnosis(table, correlated, nothing).collect()] == ["done"]


def test_trace(spark):
    table = anomalies(spark, ("a", ["latency_jump"], REAL), ("b", ["latency_jump"], REAL))
    log = lines(spark, [(-1, "svc", "error", "boom", 1), (-2, "svc", "info", "ok", 1)])
    calls = spark.createDataFrame([(str(i), "a", "p", "m", "classifier", 1, 1, 5, 0, True, at(-i)) for i in range(3)], schemas.CALL)
    sent = spark.createDataFrame([("a", "incident", "slack", True, None, at(0))], schemas.ALERT)
    found = spark.createDataFrame([("a", "c" * 40, 0.9, "old", [], at(1)), ("a", None, 0.2, "new", [], at(2))], schemas.CORRELATION)
    packet = table.select("anomaly_id", F.lit("text").alias("packet"))
    trace = reports.anomaly_trace("a", table, found, spark.createDataFrame([], schemas.HYPOTHESIS), calls, sent, log, rollup_rows(spark, [(-1, "svc", 2, 1, 5)]), packet)
    sizes = {name: frame.count() for name, frame in trace.items()}
    assert sizes == {"anomaly": 1, "correlation": 1, "hypothesis": 0, "calls": 3, "alerts": 1, "sample": 1, "series": 60, "packet": 1}
    assert trace["correlation"].first().reasoning == "new" and [r.call_id for r in trace["calls"].collect()] == ["2", "1", "0"]


def test_budget(spark):
    today = spark.createDataFrame([("gemini", "m", 25), ("gemini", "n", 5), ("ollama", "m", 9), ("odd", "m", 1)], "provider string, model string, requests long")
    out = {(r.provider, r.model): (r.cap, r.remaining, r.is_local) for r in reports.remaining_requests(today, {"gemini": 20, "ollama": 3}).collect()}
    assert out == {("gemini", "m"): (20, 0, False), ("gemini", "n"): (20, 15, False), ("ollama", "m"): (None, None, True), ("odd", "m"): (None, None, False)}


def test_empty_tables_count_zero(spark):
    nothing = spark.createDataFrame([], schemas.ANOMALY)
    row = reports.funnel(nothing, spark.createDataFrame([], schemas.CORRELATION), spark.createDataFrame([], schemas.HYPOTHESIS)).first()
    assert set(row) == {0}


def test_retention_cutoffs():
    now = datetime(2026, 1, 31)
    assert retention.retention_cutoffs(now, RetentionPolicy()) == {"logs": now - timedelta(days=14), "rollups": now - timedelta(days=90)}
    assert retention.cutoff(now, 0) is None
    for days in (-1, 0.5, float("nan")):
        with pytest.raises(ValueError):
            retention.cutoff(now, days)


def test_prune_drops_days_and_rewrites_the_border(spark, tmp_path):
    path = str(tmp_path / "logs")
    moments = [datetime(2026, 1, d, h) for d in (1, 2, 3) for h in (0, 11, 12, 23)]
    frame = spark.createDataFrame([(m,) for m in moments], "timestamp timestamp").withColumn("dt", F.to_date("timestamp"))
    frame.write.partitionBy("dt").parquet(path)
    retention.prune(spark, path, "timestamp", datetime(2026, 1, 2, 12))
    assert sorted(r.timestamp for r in spark.read.parquet(path).collect()) == [m for m in moments if m >= datetime(2026, 1, 2, 12)]


def test_upsert_replaces_only_dirty_buckets(spark, tmp_path):
    path = str(tmp_path / "rollup")
    first = rollup_rows(spark, [(0, "a", 1, 0, 1), (1, "a", 1, 0, 1), (0, "b", 1, 0, 1), (2000, "a", 1, 0, 1)])
    rollups.upsert_rollup(spark, first, first, path)
    fresh = rollup_rows(spark, [(1, "a", 9, 9, 9)])
    dirty = rollup_rows(spark, [(1, "a", 0, 0, 0), (0, "b", 0, 0, 0)])
    for _ in range(2):  # a retried batch changes nothing
        rollups.upsert_rollup(spark, fresh, dirty, path)
        got = sorted((r.service, r.request_count) for r in rollups.read_rollup(spark, path).collect())
        assert got == [("a", 1), ("a", 1), ("a", 9)]


def test_scan_prunes_days(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = lines(spark, [(m, "svc", "error", f"e {m}", 1) for m in (0, 30, 1500, 3000)]).select(
        "ingest_seq", "timestamp", "service", "level", "message", "error_signature",
        F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.METADATA]).alias("metadata"), F.to_date("timestamp").alias("dt"),
    )
    logs.write_logs(rows, path)
    scan = logs.scan_logs(logs.project_lines(logs.read_logs(spark, path)), "svc", T0.replace(tzinfo=None), T0.replace(tzinfo=None) + timedelta(hours=1))
    assert sorted(r.message for r in scan.collect()) == ["e 0", "e 30"]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "PushedFilters: [" in plan and "stack" not in plan


def test_missing_columns(spark):
    frame = spark.createDataFrame([], schemas.ALERT).drop("error")
    assert tables.missing_columns(frame, schemas.ALERT, "alerts") == ["alerts.error"]
    with pytest.raises(ValueError):
        tables.require_columns(frame, schemas.ALERT, "alerts")


GOOD = '{"name": "%s", "scenario": "s", "capturedAt": "t", "expect": {"suspectedCommitSha": null, "note": "n"}, "context": "c"}'


def test_labels(spark, tmp_path):
    (tmp_path / "a.json").write_text(GOOD % "plain")
    (tmp_path / "b.json").write_text(GOOD % "diff-plain")
    cases = labels.read_labels(spark, str(tmp_path), "correlation")
    assert [r.name for r in cases.collect()] == ["diff-plain", "plain"] and cases.first().expect.implicatedFiles == []
    assert [r.name for r in labels.correlation_arm(cases).collect()] == ["plain"]
    assert [r.name for r in labels.correlation_arm(cases, "diff").collect()] == ["diff-plain"]
    (tmp_path / "c.json").write_text(GOOD.replace("null", '"short"') % "bad")
    with pytest.raises(PySparkException):
        labels.read_labels(spark, str(tmp_path), "correlation").collect()


def test_unknown_scenario_has_no_fallback(spark):
    pinned = spark.createDataFrame([("known", "high", "a long summary", "area", "n", "c", "m")], schemas.PINNED_VERDICT)
    rows = spark.createDataFrame([("known",)], "scenario string")
    assert labels.with_pinned_verdict(rows, pinned).first().pinned_severity == "high"
    with pytest.raises(PySparkException):
        labels.with_pinned_verdict(spark.createDataFrame([("odd",)], "scenario string"), pinned).collect()


def test_null_sha_is_an_answer_and_absent_is_not(spark):
    rows = ['{"suspectedCommitSha": null, "confidence": 0.5, "reasoning": "long enough", "changedFilesImplicated": []}', '{"confidence": 0.5, "reasoning": "long enough", "changedFilesImplicated": []}', "{"]
    parsed = verdicts.parse_responses(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "anomaly_id int, response string"), "correlator")
    assert [r.anomaly_id for r in verdicts.valid_answers(parsed, "correlator").collect()] == [0]
    errors = {r.anomaly_id: r.error for r in verdicts.failed_answers(parsed).collect()}
    assert errors == {1: "suspectedCommitSha: Invalid input: expected string, received undefined", 2: "(root): no JSON object in the response"}


def test_pages_follow_each_other(spark):
    rows = [(f"a{i % 3}{i}", at(i // 4)) for i in range(25)]
    table = spark.createDataFrame(rows, "anomaly_id string, detected_at timestamp")
    expected = [i for i, t in sorted(rows, key=lambda r: (-r[1].timestamp(), r[0]))]
    seen, after, moments = [], None, dict(rows)
    while page := [r.anomaly_id for r in reports.newest_anomalies(table, 7, after).collect()]:
        seen += page
        after = moments[page[-1]], page[-1]
        table = table.unionByName(spark.createDataFrame([(f"new{len(seen)}", at(99))], table.schema))
    assert seen == expected
