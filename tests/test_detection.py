import math
import random
from dataclasses import replace
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import at, lines, rollup_rows
from vigilog import fixed_values as V
from vigilog.config import DetectionConfig
from vigilog.functions import times
from vigilog.operators import detect, frames, incidents, rollup, signatures
from vigilog.schemas import ANOMALY, FIRING, TRIGGER

CONFIG = DetectionConfig()


def history(errors_in_window, p95_in_window, baseline_p95=60):
    """61 minutes whose errors cycle 1..6, then a five-minute window."""
    rows = [(m, "svc", 240, m % 6 + 1, baseline_p95) for m in range(61)]
    return rows + [(61 + i, "svc", 240, errors_in_window // 5, p95_in_window) for i in range(5)]


def test_hand_computed_statistics(spark):
    row = frames.latest_frames(rollup_rows(spark, history(50, 60)), CONFIG).first()
    assert row.baseline_buckets == 60 and row.window_buckets == 5
    assert row.baseline_mean == 3.5
    assert round(row.baseline_sd, 2) == 1.72
    assert round(row.baseline_mean + 3 * row.baseline_sd, 2) == 8.67
    assert row.error_rate == 10.0


@pytest.mark.parametrize("errors, fires", [(50, True), (15, False), (5, False)])
def test_error_rate(spark, errors, fires):
    found = detect.error_rate_spikes(frames.latest_frames(rollup_rows(spark, history(errors, 60)), CONFIG), CONFIG)
    assert (found.count() == 1) == fires


@pytest.mark.parametrize("p95, fires", [(500, True), (200, True), (199, False), (60, False)])
def test_latency(spark, p95, fires):
    found = detect.latency_jumps(frames.latest_frames(rollup_rows(spark, history(15, p95)), CONFIG), CONFIG).collect()
    assert bool(found) == fires
    if p95 == 500:
        assert round(found[0].ratio, 2) == 8.33


def test_quiet_baseline_does_not_divide_by_zero(spark):
    rows = [(m, "svc", 10, 0, 0) for m in range(61)] + [(61 + i, "svc", 10, 3, 900) for i in range(5)]
    base = frames.latest_frames(rollup_rows(spark, rows), CONFIG)
    assert detect.error_rate_spikes(base, CONFIG).first().z_score == 999.0
    assert detect.latency_jumps(base, CONFIG).count() == 0


def test_sliding_frames_agree_with_brute_force(spark):
    config = replace(CONFIG, baseline_buckets=7, window_buckets=3, gap_buckets=2)
    rng = random.Random(5)
    rows = [(m, s, 9, rng.randint(0, 9), rng.randint(1, 300)) for s in "ab" for m in range(400) if rng.random() < 0.8]
    got = {(r.service, r.window_end.timestamp()): r for r in frames.sliding_frames(rollup_rows(spark, rows), config).collect()}
    assert len(got) == len(rows)
    for minute, service, *_ in rows:
        end = minute + 1
        mine = [r for r in rows if r[1] == service]
        window = [r for r in mine if end - 3 <= r[0] < end]
        baseline = [r for r in mine if end - 12 <= r[0] < end - 5]
        row = got[service, at(end).timestamp()]
        assert row.window_buckets == len(window) and row.baseline_buckets == len(baseline)
        assert row.error_count == sum(r[3] for r in window)
        errors = [r[3] for r in baseline]
        mean = sum(errors) / len(errors) if errors else 0
        sd = math.sqrt(sum((e - mean) ** 2 for e in errors) / (len(errors) - 1)) if len(errors) > 1 else 0
        assert row.baseline_mean == pytest.approx(mean) and row.baseline_sd == pytest.approx(sd)
        assert row.baseline_p95 == (median(r[4] for r in baseline) if baseline else 0)


def test_latest_run_equals_backtest_at_its_end(spark):
    rows = history(50, 500)
    log = lines(spark, [(m, "svc", "error", "boom 1", 1) for m in (61, 62, 63)] + [(1, "svc", "error", "old 1", 1)])
    table = rollup_rows(spark, rows)
    columns = ["service", "window_start", "window_end", F.to_json("triggers").alias("t"), "status"]
    latest = detect.detect_latest(log, table, CONFIG).select(*columns).collect()
    back = detect.backtest(log, table, CONFIG)
    assert latest == back.where(F.col("window_end") == F.lit(at(66))).select(*columns).collect()
    kinds = [r.kind for r in back.where("status = 'firing'").orderBy(F.desc("window_end")).first().triggers]
    assert kinds == ["error_rate_spike", "latency_jump", "new_error_signature"]


def test_too_little_baseline_is_skipped(spark):
    status = detect.detect_latest(lines(spark, [(0, "svc", "info", "x", 1)]), rollup_rows(spark, history(50, 60)[35:]), CONFIG)
    row = status.first()
    assert row.status == "skipped" and row.skipped_reason == "only 25 of 30 baseline buckets of 60 s needed"


def test_new_signatures_agree_with_brute_force(spark):
    config = replace(CONFIG, baseline_buckets=6, window_buckets=3, gap_buckets=1, min_occurrences=2)
    rng = random.Random(9)
    rows = [(rng.randint(0, 150), rng.choice("ab"), "error", rng.choice(["alpha", "beta", "gamma delta", "eps"]), 1) for _ in range(260)]
    got = {
        (r.service, r.window_end.timestamp()): (r.signature, r.occurrences, r.sample_message)
        for r in signatures.new_signatures(lines(spark, rows), config).collect()
    }
    expected = {}
    for service in "ab":
        for end in range(1, 155):
            window = [(r[0], i, r[3]) for i, r in enumerate(rows) if r[1] == service and end - 3 <= r[0] < end]
            known = {r[3] for r in rows if r[1] == service and end - 10 <= r[0] < end - 4}
            counts = {}
            for minute, i, sig in sorted(window):
                if sig not in known:
                    counts.setdefault(sig, []).append((minute, i))
            best = sorted((-len(v), v[0], k) for k, v in counts.items() if len(v) >= 2)
            if best:
                expected[service, at(end).timestamp()] = (best[0][2], -best[0][0], best[0][2])
    assert got == expected


@pytest.mark.parametrize("minutes, fires", [(5, True), (4.9, False), (180, True), (181, False)])
def test_silence_bounds_are_inclusive(spark, minutes, fires):
    rows = [(-i / 6, "svc", "info", "tick", 1) for i in range(360)]
    found = detect.silent_services(lines(spark, rows), F.lit(at(minutes)), CONFIG).collect()
    assert bool(found) == fires
    if fires:
        assert found[0].silent_minutes == int(minutes) and found[0].lines_per_minute == 6.0


def test_silent_service_is_not_judged_by_its_window(spark):
    log = lines(spark, [(66 - i / 6, "svc", "info", "tick", 1) for i in range(360)])
    out = detect.detect_latest(log, rollup_rows(spark, history(50, 60)), CONFIG, F.lit(at(80))).collect()
    assert sorted((r.status, len(r.triggers)) for r in out) == [("silent", 1), ("skipped", 0)]


def sequential_merge(firings, gap):
    """The merge, one firing at a time."""
    done = []
    for start, end, kinds in firings:
        recent = [a for a in done if a["end"] >= start - gap]
        target = max(recent, key=lambda a: a["end"]) if recent else None
        if target is None:
            done.append({"start": start, "end": end, "kinds": list(kinds), "n": 1})
        else:
            target["end"] = max(target["end"], end)
            target["kinds"] += [k for k in kinds if k not in target["kinds"]]
            target["n"] += 1
    return done


def firing_frame(spark, rows):
    empty = [None] * 14
    data = [(s, at(a), at(b), [(k, s, *empty) for k in ks]) for s, a, b, ks in rows]
    return spark.createDataFrame(data, FIRING)


def test_islands_equal_the_sequential_merge(spark):
    rng = random.Random(3)
    rows, expected = [], []
    for n in range(40):
        service, ends = f"s{n}", sorted(rng.sample(range(5, 200), rng.randint(1, 12)))
        mine = [(e - 5, e, rng.sample(["a", "b", "c"], rng.randint(1, 3))) for e in ends]
        rows += [(service, *f) for f in mine]
        expected += [(service, at(a["start"]), at(a["end"]), tuple(a["kinds"]), a["n"]) for a in sequential_merge(mine, 10)]
    merged = incidents.merge_incidents(firing_frame(spark, rows), CONFIG).collect()
    got = [(r.service, r.window_start.astimezone(at(0).tzinfo), r.window_end.astimezone(at(0).tzinfo), tuple(t.kind for t in r.triggers), r.firing_count) for r in merged]
    assert sorted(got) == sorted(expected)


def test_actions_and_chunks_equal_one_firing_at_a_time(spark):
    rng = random.Random(5)
    names = list(V.TRIGGER_WEIGHTS)
    rows, expected = [], []
    for n in range(12):
        service, end = f"s{n}", 5
        known, last, number = set(), None, 0
        for _ in range(rng.randint(1, 60)):
            # Some steps are longer than a chunk, some incidents last for many chunks.
            end += rng.choice([1, 3, 9, 14, 15, 16, 17, 400] if n % 3 else [1, 14])
            kinds = rng.sample(names, rng.randint(1, 2))
            opens = last is None or last < end - 5 - 10
            known, number = (set() if opens else known), number + opens
            rows.append((service, end - 5, end, kinds))
            expected.append((service, number, end, "created" if opens else "extended", sorted(set(kinds) - known)))
            known |= set(kinds)
            last = end
    small = replace(CONFIG, baseline_buckets=4, window_buckets=1)
    assert frames.chunk_seconds(small) == 24 * 60
    for config in (small, CONFIG):
        out = incidents.firing_actions(firing_frame(spark, rows), config).collect()
        got = [(r.service, r.incident_no, (r.window_end.astimezone(at(0).tzinfo) - at(0)).total_seconds() / 60, r.action, r.added_kinds) for r in out]
        assert sorted(got) == sorted(expected)


def test_a_hot_service_is_spread_over_chunks(spark):
    n = 1_000_000
    minute = F.col("id") + 30 * F.floor(F.col("id") / 1000)  # a pause of half an hour after each thousand
    end = times.shift(F.lit(at(0)), minute * 60)
    kind = F.when(F.col("id") % 1000 == 500, V.ERROR_RATE_SPIKE).otherwise(V.LATENCY_JUMP)
    trigger = F.struct(*[(kind if f.name == "kind" else F.lit(None)).cast(f.dataType).alias(f.name) for f in TRIGGER])
    firings = spark.range(n).select(
        F.lit("hot").alias("service"), times.shift(end, -300).alias("window_start"), end.alias("window_end"), F.array(trigger).alias("triggers")
    )
    local = incidents._in_chunks(firings, CONFIG)
    assert local.groupBy("service", "_chunk").count().agg(F.max("count")).first()[0] <= frames.chunk_seconds(CONFIG) // 60
    # What is ordered by service alone is one row a chunk.
    assert incidents._scan_chunks(local, CONFIG).count() < n // 200
    merged = incidents.merge_incidents(firings, CONFIG)
    row = merged.agg(F.count("*"), F.min("firing_count"), F.max("firing_count"), F.min(F.size("triggers")), F.max(F.size("triggers"))).first()
    assert tuple(row) == (n // 1000, 1000, 1000, 2, 2)


def anomaly(service, start, end, kinds, status):
    empty = [None] * 14
    return (f"id-{service}", at(end), at(start), at(end), service, [(k, service, *empty) for k in kinds], None, None, None, None, None, None, status)


def test_persist_run(spark):
    table = spark.createDataFrame(
        [
            anomaly("near", 0, 5, ["a"], "open"),
            anomaly("far", 0, 5, ["a"], "open"),
            anomaly("closed", 0, 5, ["a"], "resolved"),
            anomaly("benign_same", 0, 5, ["a"], "dismissed"),
            anomaly("benign_new", 0, 5, ["a"], "dismissed"),
        ],
        ANOMALY,
    )
    rows = [("near", 12, 17, ["b"]), ("far", 16, 21, ["a"]), ("closed", 6, 11, ["a"]), ("benign_same", 6, 11, ["a"]), ("benign_new", 6, 11, ["a", "b"]), ("fresh", 6, 11, ["a"])]
    out = {r.service: r for r in incidents.persist_run(table, firing_frame(spark, rows), F.lit(at(30)), CONFIG).collect()}
    assert {s: r.action for s, r in out.items()} == {
        "near": "extended", "far": "created", "closed": "created", "benign_same": "extended", "benign_new": "created", "fresh": "created",
    }
    assert out["near"].added_kinds == ["b"] and [t.kind for t in out["near"].triggers] == ["a", "b"]
    assert out["near"].window_start.astimezone(at(0).tzinfo) == at(0) and out["near"].window_end.astimezone(at(0).tzinfo) == at(17)
    assert out["benign_new"].anomaly_id != "id-benign_new" and out["benign_new"].status == "open"
    assert out["benign_same"].status == "dismissed"


def test_rollup_percentiles(spark):
    data = [(0.1, "svc", "info", "m", v) for v in (1, 2, 3, 10)] + [(0.2, "svc", "error", "m", 4, None), (0.3, "svc", "fatal", "m", 5, "/y")]
    rows = {r.endpoint: r for r in rollup.rollup(lines(spark, data)).collect()}
    assert set(rows) == {"", "/x", "/y"}
    assert (rows[""].request_count, rows[""].error_count) == (6, 2)
    assert (rows["/x"].request_count, rows["/x"].p50_ms, rows["/x"].p95_ms) == (4, 3, 9)
    exact = rollup.grouped_percentiles(lines(spark, data).where("endpoint = '/x'"), ["service"], "latency_ms", {"p": 0.95}).first()
    assert exact.p == pytest.approx(8.95)


PS = {"low": 0.0, "m": 0.5, "p95": 0.95, "p99": 0.99, "top": 1.0}


def test_a_hot_key_is_searched_by_cells(spark):
    n = 1_000_000
    mixed = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(1e6)
    values = spark.range(n).select(F.lit("hot").alias("k"), F.when(F.col("id") % 3 > 0, mixed).otherwise(mixed / 1e9 - 3).alias("v"))
    exact = np.sort([r.v for r in values.collect()])
    assert len(np.unique(exact)) > 0.99 * n
    found = rollup.grouped_percentiles(values, ["k"], "v", PS, most_values=1000).collect()
    assert len(found) == 1
    for name, p in PS.items():
        assert getattr(found[0], name) == pytest.approx(np.percentile(exact, 100 * p), rel=1e-12)
    plan = rollup.order_statistics(values, ["k"], "v", {"m": F.lit(n // 2)})._jdf.queryExecution().toString()
    assert "Sort [_value" not in plan and "collect_list" not in plan
    assert rollup.order_statistics(values, ["k"], "v", {"m": F.lit(n // 2)}).first().m == exact[n // 2]


def test_searched_and_sorted_percentiles_are_equal(spark):
    rng = random.Random(9)
    inf, nan = float("inf"), float("nan")
    pools = [[1.0], [1, 2, 3, 10], [-5.0, -1e-300, 0.0, 1e-300, 7], [inf, 1.0, -inf, 2], [nan, 1.0, inf], [1e300, 1.0, 2.0, 3.0], [100 + i / 1e9 for i in range(50)]]
    rows = [(f"k{i}", float(v)) for i, pool in enumerate(pools) for v in pool for _ in range(rng.randint(1, 4))]
    rows += [("k0", None), ("none", None), (None, 4.0), (None, 6.0)]
    frame = spark.createDataFrame(rows, "k string, v double")
    plain, searched = (
        sorted(str(tuple(r)) for r in rollup.grouped_percentiles(frame, ["k"], "v", PS, most_values=most).collect())
        for most in (1 << 18, 0)
    )
    assert plain == searched and len(plain) == len(pools) + 2
    mixed = sorted(str(tuple(r)) for r in rollup.grouped_percentiles(frame, ["k"], "v", PS, most_values=8).collect())
    assert mixed == plain


def test_rollup_of_a_hot_bucket_equals_the_plain_one(spark):
    rng = random.Random(2)
    data = [(rng.choice([0.1, 0.2, 1.5, 3.5]), rng.choice(["a", "b"]), rng.choice(["info", "error"]), "m", rng.uniform(1, 900)) for _ in range(400)]
    frame = lines(spark, data)
    plain, searched = (sorted(map(tuple, rollup.rollup(frame, most_values=most).collect())) for most in (1 << 18, 60))
    assert plain == searched


def test_rollup_does_not_depend_on_partitioning(spark):
    rng = random.Random(1)
    log = lines(spark, [(rng.random() * 30, rng.choice("ab"), rng.choice(["info", "error"]), "m", rng.randint(1, 999)) for _ in range(2000)])
    one = sorted(rollup.rollup(log.coalesce(1)).collect())
    assert one == sorted(rollup.rollup(log.repartition(7)).collect())
    # Recomputing the dirty buckets of any part of the lines reproduces their rows.
    part = log.where("ingest_seq % 5 = 0")
    redone = rollup.rollup_dirty(log, rollup.dirty_buckets(part)).collect()
    assert set(redone) <= set(one) and redone


def test_coalesce_runs(spark):
    dirty = spark.createDataFrame([("a", at(m)) for m in (1, 2, 2, 3, 7)] + [("a", at(50))], "service string, bucket_start timestamp")
    runs = rollup.coalesce_runs(dirty, F.lit(at(40))).orderBy("run_start").collect()
    zone = at(0).tzinfo
    assert [(r.run_start.astimezone(zone), r.run_end.astimezone(zone)) for r in runs] == [(at(1), at(4)), (at(7), at(8))]


def test_grid_has_no_latency_without_requests(spark):
    ranges = spark.createDataFrame([("svc", at(0), at(3))], "service string, range_start timestamp, range_end timestamp")
    grid = rollup.bucket_grid(ranges, rollup_rows(spark, [(1, "svc", 4, 2, 80)])).orderBy("bucket_start").collect()
    assert [(r.requests, r.errors, r.p95) for r in grid] == [(0, 0, None), (4, 2, 80), (0, 0, None)]
