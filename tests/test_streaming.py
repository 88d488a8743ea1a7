import json
import os
import random

from pyspark.sql import functions as F

from helpers import at, millis
from vigilog.config import DetectionConfig
from vigilog.operators import detect, rollup
from vigilog.sources import logs as log_source
from vigilog.sources.rollups import read_rollup, read_signatures
from vigilog.streaming import ingest, watch
from vigilog.streaming import rollup as stream_rollup

ONCE = {"availableNow": True}


def post(folder, name, minute, entries, key=None):
    """One file with one posted batch."""
    os.makedirs(folder, exist_ok=True)
    row = {"batch_id": name, "received_at": at(minute).isoformat(), "idempotency_key": key, "body": json.dumps({"entries": entries})}
    with open(f"{folder}/{name}.json", "w") as out:
        out.write(json.dumps(row) + "\n")


def entry(minute, level="info", message="ok 1", latency=50, service="svc"):
    return {"timestamp": millis(at(minute)), "service": service, "level": level, "message": message, "metadata": {"endpoint": "/x", "latencyMs": latency}}


def ingest_all(spark, base):
    batches = log_source.stream_log_batches(spark, f"{base}/in")
    ingest.start_log_writer(batches, f"{base}/logs", f"{base}/ck-logs", **ONCE).awaitTermination()


def roll_all(spark, base, then=None):
    logs = spark.readStream.schema(log_source.schemas.LOGS).parquet(f"{base}/logs")
    stream_rollup.start_rollup(logs, f"{base}/logs", f"{base}/rollup", f"{base}/ck-rollup", then=then, **ONCE).awaitTermination()


def batch_rollup(spark, base):
    return sorted(rollup.rollup(log_source.project_lines(log_source.read_logs(spark, f"{base}/logs")).drop("dt")).collect())


def streamed_rollup(spark, base):
    return sorted(read_rollup(spark, f"{base}/rollup").drop("dt").collect())


def test_late_lines_are_never_lost(spark, tmp_path):
    base, rng = str(tmp_path), random.Random(6)
    entries = [entry(rng.uniform(-3000, 0), rng.choice(["info", "error"]), f"m {i}", rng.randint(1, 500), rng.choice("ab")) for i in range(300)]
    for part in range(3):
        post(f"{base}/in", f"b{part}", part, entries[part::3])
        ingest_all(spark, base)
        roll_all(spark, base)
        assert streamed_rollup(spark, base) == batch_rollup(spark, base)
    assert sum(r.request_count for r in streamed_rollup(spark, base) if r.endpoint == "") == 300


def test_replayed_and_rejected_batches(spark, tmp_path):
    base, key = str(tmp_path), "k" * 16
    post(f"{base}/in", "b0", 0, [entry(-1)], key)
    post(f"{base}/in", "b1", 1, [entry(-1)], key)
    post(f"{base}/in", "b2", 1, [entry(-1), entry(-1, "odd")])
    post(f"{base}/in", "b3", 1, [entry(-1)])
    ingest_all(spark, base)
    assert log_source.read_logs(spark, f"{base}/logs").count() == 3
    batches = log_source.stream_log_batches(spark, f"{base}/in")
    ingest.start_reject_writer(batches, f"{base}/rejects", f"{base}/ck-rejects", **ONCE).awaitTermination()
    assert [(r.batch_id, r["index"]) for r in spark.read.parquet(f"{base}/rejects").collect()] == [("b2", 1)]


def test_append_mode_holds_open_buckets_back(spark, tmp_path):
    base = str(tmp_path)
    post(f"{base}/in", "b0", 30, [entry(m / 2, latency=m) for m in range(40)])
    ingest_all(spark, base)
    lines = log_source.project_lines(spark.readStream.schema(log_source.schemas.LOGS).parquet(f"{base}/logs"))
    query = (
        stream_rollup.closed_buckets(lines, lateness="5 minutes").writeStream.format("memory").queryName("closed")
        .outputMode("append").trigger(**ONCE).start()
    )
    query.awaitTermination()
    got = sorted(spark.table("closed").collect())
    full = batch_rollup(spark, base)
    last = max(r.bucket_start for r in got)
    assert got == [r for r in full if r.bucket_start <= last] and len(got) < len(full)


def test_watch_folds_runs_into_one_incident(spark, tmp_path):
    base = str(tmp_path)
    config = DetectionConfig(baseline_buckets=10, min_baseline_buckets=5, window_buckets=2)
    settings = watch.Watch(f"{base}/logs", f"{base}/rollup", f"{base}/anomalies", config)
    calm = [entry(m + i / 10) for m in range(14) for i in range(3)]
    post(f"{base}/in", "b0", 15, calm)
    ingest_all(spark, base)
    roll_all(spark, base, watch.detection_step(settings))
    assert watch.anomaly_events(spark, settings.anomalies_path).count() == 0
    for run, minute in enumerate((14, 15)):
        post(f"{base}/in", f"c{run}", 16 + run, [entry(minute + i / 50, "error", f"boom {i}") for i in range(20)])
        ingest_all(spark, base)
        roll_all(spark, base, watch.detection_step(settings))
    events = watch.anomaly_events(spark, settings.anomalies_path)
    assert [r.action for r in events.orderBy("epoch").collect()] == ["created", "extended"]
    now = watch.current_anomalies(events).collect()
    assert len(now) == 1 and {t.kind for t in now[0].triggers} == {"error_rate_spike", "new_error_signature"}
    # Repeating a run changes nothing.
    before = sorted(map(str, events.collect()))
    watch.run_detection(spark, settings, max(r.epoch for r in events.collect()))
    assert sorted(map(str, watch.anomaly_events(spark, settings.anomalies_path).collect())) == before


def test_silence_in_the_watch(spark, tmp_path):
    base = str(tmp_path)
    settings = watch.Watch(f"{base}/logs", f"{base}/rollup", f"{base}/anomalies", clock=lambda: at(20))
    post(f"{base}/in", "b0", 1, [entry(-i / 10) for i in range(600)])
    ingest_all(spark, base)
    roll_all(spark, base, watch.detection_step(settings))
    current = watch.current_anomalies(watch.anomaly_events(spark, settings.anomalies_path)).collect()
    assert [[t.kind for t in r.triggers] for r in current] == [["service_silent"]]
    sent = spark.createDataFrame([], log_source.schemas.ALERT)
    due = watch.pending_alerts(spark, settings, sent, ["slack"]).collect()
    assert [(r.reason, r.channel) for r in due] == [("silence", "slack")]


def test_dirty_buckets_scan_only_their_days(spark, tmp_path):
    base = str(tmp_path)
    post(f"{base}/in", "b0", 60 * 24 * 3, [entry(60 * 24 * day + m) for day in range(4) for m in range(3)])
    ingest_all(spark, base)
    lines = log_source.project_lines(log_source.read_logs(spark, f"{base}/logs"))
    dirty = rollup.dirty_buckets(lines.where(F.col("dt") == "2026-11-03"))
    plan = rollup.rollup_dirty(lines, dirty)._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line and "2026-11-03" in line]
    assert filters and not any("2026-11-04" in line for line in filters)
    assert {r.bucket_start.day for r in rollup.rollup_dirty(lines, dirty).collect()} == {3}


def test_dismissed_incident_is_extended_but_a_new_trigger_opens_one(spark, tmp_path):
    base = str(tmp_path)
    config = DetectionConfig(baseline_buckets=10, min_baseline_buckets=5, window_buckets=2)
    settings = watch.Watch(f"{base}/logs", f"{base}/rollup", f"{base}/anomalies", config)

    def run(name, arrival, entries):
        post(f"{base}/in", name, arrival, entries)
        ingest_all(spark, base)
        roll_all(spark, base, watch.detection_step(settings))
        return watch.current_anomalies(watch.anomaly_events(spark, settings.anomalies_path)).collect()

    run("b0", 15, [entry(m + i / 10) for m in range(14) for i in range(3)])
    spike = run("b1", 16, [entry(14 + i / 50, "error", f"boom {i}") for i in range(20)])
    assert len(spike) == 1 and spike[0].status == "open"
    epoch = watch.anomaly_events(spark, settings.anomalies_path).agg(F.max("epoch")).first()[0]
    dismissed = watch.current_anomalies(watch.anomaly_events(spark, settings.anomalies_path)).withColumns(
        {"status": F.lit("dismissed"), "is_real_incident": F.lit(False)}
    )
    watch.record(dismissed, settings, epoch, "classified")
    more = run("b2", 17, [entry(15 + i / 50, "error", f"boom {i}") for i in range(20)])
    assert len(more) == 1 and more[0].status == "dismissed" and more[0].window_end > spike[0].window_end
    slow = [entry(16 + i / 50, "error", f"boom {i}", latency=9_000) for i in range(20)]
    reopened = run("b3", 18, slow)
    assert {r.anomaly_id: r.status for r in reopened}[spike[0].anomaly_id] == "dismissed"
    assert sorted(r.status for r in reopened) == ["dismissed", "open"]


def test_stored_signatures_replace_the_scan_of_the_baseline(spark, tmp_path):
    base = str(tmp_path)
    config = DetectionConfig(baseline_buckets=10, min_baseline_buckets=5, window_buckets=2)
    scanning = watch.Watch(f"{base}/logs", f"{base}/rollup", f"{base}/anomalies", config)
    stored = watch.Watch(f"{base}/logs", f"{base}/rollup", f"{base}/anomalies-2", config, signatures_path=f"{base}/signatures")

    def both(batch, epoch):
        watch.run_detection(spark, scanning, epoch)
        watch.run_detection(spark, stored, epoch)

    logs = spark.readStream.schema(log_source.schemas.LOGS)
    parts = [
        [entry(m + i / 10, "error" if i == 0 else "info", f"known {m}") for m in range(14) for i in range(3)],
        [entry(14 + i / 50, "error", f"known {i}" if i % 3 else f"boom at row {i}") for i in range(20)],
        [entry(12.5 + i / 50, "error", f"boom at row {i}") for i in range(3)] + [entry(15.5, "error", "rare once")],  # late lines
    ]
    for n, entries in enumerate(parts):
        post(f"{base}/in", f"b{n}", 16 + n, entries)
        ingest_all(spark, base)
        stream_rollup.start_rollup(
            logs.parquet(f"{base}/logs"), f"{base}/logs", f"{base}/rollup", f"{base}/ck-rollup", then=both,
            signatures_path=f"{base}/signatures", **ONCE,
        ).awaitTermination()
    events = [sorted(map(str, watch.anomaly_events(spark, w.anomalies_path).collect())) for w in (scanning, stored)]
    assert events[0] == events[1] and "new_error_signature" in events[0][0]
    full = stream_rollup.stored_buckets(log_source.project_lines(log_source.read_logs(spark, f"{base}/logs")), 60)
    table = read_signatures(spark, f"{base}/signatures").drop("dt")
    assert sorted(map(str, table.collect())) == sorted(map(str, full.select(*table.columns).collect()))
    lines = log_source.project_lines(log_source.read_logs(spark, f"{base}/logs"))
    frame = detect.detect_latest(lines, read_rollup(spark, f"{base}/rollup"), config, None, read_signatures(spark, f"{base}/signatures"))
    assert not any("/logs/" in name for name in frame.inputFiles())
