import json
import os
import time
from datetime import datetime, timedelta, timezone

from vigilog.config import DetectionConfig
from vigilog.streaming import stateful

CONFIG = DetectionConfig(silence_min_minutes=0.05, silence_baseline_minutes=1, silence_min_lines_per_minute=5)


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as out:
        out.writelines(json.dumps(r) + "\n" for r in rows)
    os.rename(f"{folder}/.{name}", f"{folder}/{name}.json")


def micros(moment):
    return int(moment.timestamp() * 1_000_000)


def firing(service, start, *kinds):
    window = {"window_start": micros(start), "window_end": micros(start + timedelta(minutes=5))}
    return {"service": service, "at": window["window_end"], **window, "triggers": json.dumps([{"kind": k, "service": service} for k in kinds])}


def start(spark, base, seen):
    signals = spark.readStream.schema(stateful.SIGNALS).json(f"{base}/in")

    def keep(batch, epoch):
        seen.extend(batch.collect())

    changes = stateful.incident_changes(signals, CONFIG, tick_seconds=1)
    return changes.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/ck").outputMode("update").trigger(processingTime="1 second").start()


def wait(query, done, seconds=60):
    end = time.time() + seconds
    while not done() and time.time() < end and query.isActive:
        time.sleep(0.3)
    assert query.exception() is None
    assert done()


def test_state_survives_a_restart_and_a_timer_alone_raises_silence(spark, tmp_path):
    base, seen = str(tmp_path), []
    t0 = datetime(2026, 11, 2, 10, 0, tzinfo=timezone.utc)
    put(f"{base}/in", "a", [firing("svc", t0, "latency_jump"), firing("svc", t0 + timedelta(minutes=5), "latency_jump", "error_rate_spike")])
    query = start(spark, base, seen)
    try:
        wait(query, lambda: len(seen) == 2)
        assert [(r.action, r.added_kinds) for r in seen] == [("created", ["latency_jump"]), ("extended", ["error_rate_spike"])]
        assert len({r.anomaly_id for r in seen}) == 1
    finally:
        query.stop()
    first = seen[-1]
    assert [t.kind for t in first.triggers] == ["latency_jump", "error_rate_spike"] and first.window_start == seen[0].window_start
    # The incident is still open after a restart; a verdict changes how the next firing is taken.
    put(f"{base}/in", "b", [firing("svc", t0 + timedelta(minutes=15), "error_rate_spike")])
    query = start(spark, base, seen)
    try:
        wait(query, lambda: len(seen) == 3)
        assert (seen[2].action, seen[2].anomaly_id) == ("extended", first.anomaly_id)
        put(f"{base}/in", "c", [{"service": "svc", "at": micros(t0 + timedelta(minutes=21)), "anomaly_id": first.anomaly_id, "status": "dismissed"}])
        put(f"{base}/in", "d", [firing("svc", t0 + timedelta(minutes=22), "new_error_signature")])
        wait(query, lambda: len(seen) == 4)
        assert seen[3].action == "created" and seen[3].anomaly_id != first.anomaly_id
        # Ten lines now, then nothing: no input follows, only the clock goes on.
        now = datetime.now(timezone.utc)
        put(f"{base}/in", "e", [{"service": "quiet", "at": micros(now) - i * 100_000} for i in range(10)])
        put(f"{base}/in", "f", [{"service": "rare", "at": micros(now)}])
        wait(query, lambda: len(seen) >= 6)
        silent = seen[4:]
        assert {r.service for r in silent} == {"quiet"} and [t.kind for t in silent[0].triggers] == ["service_silent"]
        assert [r.action for r in silent[:2]] == ["created", "extended"] and silent[0].triggers[0].lines_per_minute == 10
    finally:
        query.stop()
