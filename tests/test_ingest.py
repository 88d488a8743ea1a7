import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import T0, at, millis
from vigilog.operators import ingest
from vigilog.sources import logs as log_source

BASE = {"timestamp": "2026-11-02T10:00:00.000Z", "service": "orders-api", "level": "error", "message": "TypeError: x is null"}


def batches(spark, *bodies, key=None):
    rows = [(f"b{i}", at(0), key, body if isinstance(body, str) else json.dumps(body)) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, log_source.batch_schema())


def validate(spark, *entries):
    """Validated entries in order, each in a batch of its own place."""
    envelopes = ingest.check_envelopes(batches(spark, {"entries": list(entries)}))
    return ingest.validate_entries(ingest.explode_entries(envelopes), F.lit(T0)).orderBy("index")


def reasons(spark, *entries):
    return [r.reason for r in validate(spark, *entries).select("reason").collect()]


def test_accepts_iso_and_epoch_milliseconds(spark):
    rows = [BASE, {**BASE, "timestamp": millis(T0)}, {**BASE, "timestamp": "2026-11-02T12:00:00+02:00"}]
    assert reasons(spark, *rows) == [None] * 3
    stamps = [r.timestamp for r in validate(spark, *rows).select("timestamp").collect()]
    assert len(set(stamps)) == 1


def test_names_the_mistake(spark):
    assert "seconds sent instead" in reasons(spark, {**BASE, "timestamp": 1_793_619_673})[0]
    assert reasons(spark, {**BASE, "timestamp": "yesterday-ish"}, {**BASE, "timestamp": 1e300}) == [
        "timestamp: neither an ISO-8601 date nor a number of milliseconds"
    ] * 2
    assert reasons(spark, {k: v for k, v in BASE.items() if k != "timestamp"})[0].startswith("timestamp: neither")
    assert reasons(spark, {**BASE, "timestamp": millis(at(6))})[0].startswith("timestamp: over 5 minutes")
    assert reasons(spark, {**BASE, "timestamp": millis(at(5))}) == [None]


def test_service_names(spark):
    good = ["orders-api", "payments_v2", "svc.eu-west-1", "A1", "x" * 64]
    bad = ["", "-leading-dash", "has space", "new\nline", "trailing\n", "../../etc", "a/b", "<script>", "x" * 65]
    out = reasons(spark, *[{**BASE, "service": s} for s in good + bad])
    assert out[: len(good)] == [None] * len(good)
    assert all(r and r.startswith("service: ") for r in out[len(good) :])


def test_bounds(spark):
    rows = [
        {**BASE, "message": "x" * 4096},
        {**BASE, "message": "x" * 4097},
        {**BASE, "message": ""},
        {**BASE, "message": "​\u0007"},
        {**BASE, "metadata": {"note": "x" * 1000}},
        {**BASE, "metadata": {"blob": "x" * 16_384}},
        {**BASE, "metadata": None},
        {**BASE, "metadata": {"statusCode": 99}},
        {**BASE, "metadata": {"latencyMs": "5"}},
        {**BASE, "level": "critical"},
        "not an object",
    ]
    out = reasons(spark, *rows)
    assert out[0] is None and out[4] is None
    assert out[1].startswith("message: Too big") and out[2].startswith("message: Too small")
    assert out[3].startswith("message: has no visible")
    assert out[5] == "metadata: over 16384 characters as JSON"
    assert out[6] == "metadata: Invalid input: expected object, received null"
    assert out[7] == "metadata.statusCode: Too small: expected number to be >=100"
    assert out[8] == "metadata.latencyMs: Invalid input: expected number, received string"
    assert out[9].startswith("level: Invalid option") and out[10] == "Invalid input: expected object"


def test_envelope(spark):
    bodies = [{"entries": []}, {"entries": [1] * 1001}, {"entries": "x"}, "nonsense", {}, {"entries": [BASE]}]
    out = [r.batch_error for r in ingest.check_envelopes(batches(spark, *bodies)).orderBy("batch_id").collect()]
    assert out[0].startswith("entries: Too small") and out[1].startswith("entries: Too big")
    assert out[2].endswith("received string") and out[3] == "Invalid input: expected object"
    assert out[4].endswith("received undefined") and out[5] is None
    bad_key = ingest.check_envelopes(batches(spark, {"entries": [BASE]}, key="short")).first()
    assert bad_key.batch_error == "invalid_idempotency_key"


def test_rows_are_sanitised(spark):
    entry = {**BASE, "message": "ign​ore 5", "metadata": {"endpoint": "/a​", "region": "e​u", "deep": {"k": "x​"}, "n": 1}}
    row = ingest.accepted_logs(validate(spark, entry)).first()
    assert row.message == "ignore 5" and row.error_signature == "ignore <num>"
    assert row.metadata.endpoint == "/a"
    # Only top-level strings are cleaned.
    assert json.loads(row.metadata.extra) == {"region": "eu", "deep": {"k": "x​"}, "n": 1}


def test_report_keeps_the_first_twenty(spark):
    bad = [{**BASE, "level": "x"}] * 25
    envelopes = ingest.check_envelopes(batches(spark, {"entries": [BASE, *bad]}, {"entries": [BASE]}))
    report = ingest.ingest_report(ingest.validate_entries(ingest.explode_entries(envelopes), F.lit(T0)))
    first, second = report.orderBy("batch_id").collect()
    assert (first.accepted, first.rejected, first.status, len(first.errors)) == (1, 25, 207, 20)
    assert [e["index"] for e in first.errors] == list(range(1, 21))
    assert (second.accepted, second.rejected, second.status) == (1, 0, 202)


def test_replays_within_the_lifetime_are_dropped(spark):
    key = "k" * 16
    body = json.dumps({"entries": [BASE]})
    arrivals = [(0, key), (9, key), (10, key), (15, key), (20, key), (1, None), (2, None), (3, "j" * 16)]
    rows = [(f"b{i}", at(m), k, body) for i, (m, k) in enumerate(arrivals)]
    rows.append(("refused", at(-5), key, '{"entries": []}'))
    frame = spark.createDataFrame(rows, log_source.batch_schema())
    kept = ingest.deduplicate_batches(ingest.check_envelopes(frame))
    assert sorted(r.batch_id for r in kept.collect()) == ["b0", "b2", "b4", "b5", "b6", "b7"]


def kept_one_by_one(arrivals):
    kept = []
    for key, second in sorted(arrivals):
        if not kept or kept[-1][0] != key or second - kept[-1][1] >= 600:
            kept.append((key, second))
    return kept


def delivered(spark, arrivals):
    made = spark.createDataFrame([(k, float(s)) for k, s in arrivals], "idempotency_key string, second double")
    return made.withColumn("received_at", F.timestamp_micros((F.col("second") * 1e6).cast("long"))).withColumn("batch_error", F.lit(None).cast("string"))


@pytest.mark.parametrize("most", [0, 20, 1000])
def test_chains_over_blocks_equal_one_delivery_at_a_time(spark, most):
    rng = random.Random(4)
    arrivals = []
    for k in range(6):
        second = rng.uniform(-50_000, 50_000)
        for _ in range(rng.choice([1, 15, 400])):
            second += rng.choice([0.5, 37, 299, 300, 599.5, 600, 601, 5000, 40_000] if k % 2 else [1, 250])
            arrivals += [(f"key-{k}", second)] * rng.choice([1, 1, 2])
    kept = ingest.deduplicate_batches(delivered(spark, arrivals), most).collect()
    assert sorted((r.idempotency_key, r.second) for r in kept) == kept_one_by_one(arrivals)


def test_a_key_that_posts_every_second_for_a_week(spark):
    seconds = 7 * 86_400
    posted = spark.range(seconds).select(
        F.lit("steady").alias("idempotency_key"), F.timestamp_seconds(F.col("id")).alias("received_at"),
        F.lit(None).cast("string").alias("batch_error"), "id",
    )
    kept = sorted(r.id for r in ingest.deduplicate_batches(posted).collect())
    assert kept == list(range(0, seconds, 600))
    times = posted.select(F.col("idempotency_key").alias("key"), F.unix_micros("received_at").alias("at"))
    block = F.floor(F.col("at") / (ingest.BLOCK_LIFETIMES * 600_000_000))
    assert times.groupBy("key", block).count().agg(F.max("count")).first()[0] <= ingest.BLOCK_LIFETIMES * 600


def test_ingest_order_is_unique_for_batches_that_arrive_together(spark):
    rows = [(f"b{b}", i, at(0)) for b in range(5) for i in range(50)] + [("c", i, at(1)) for i in range(50)]
    entry_ = json.dumps(BASE)
    frame = spark.createDataFrame(rows, "batch_id string, index int, received_at timestamp")
    entries = frame.withColumn("_json", F.lit(entry_)).withColumn("entry", F.parse_json("_json")).drop("_json")
    stored = ingest.accepted_logs(ingest.validate_entries(entries, F.col("received_at")))
    orders = [r.ingest_seq for r in stored.collect()]
    assert len(set(orders)) == len(rows)


def test_more_lines_of_one_arrival_than_the_order_has_room_for(spark):
    entries = spark.range(20_000).select(
        F.concat(F.lit("b"), F.floor(F.col("id") / 1000).cast("string")).alias("batch_id"), (F.col("id") % 1000).cast("int").alias("index"),
        F.lit(at(0)).alias("received_at"), F.parse_json(F.lit(json.dumps(BASE))).alias("entry"),
    )
    validated = ingest.validate_entries(entries, F.col("received_at"))
    with pytest.raises(Exception, match="over 16384 lines arrived"):
        ingest.accepted_logs(validated).select("ingest_seq").collect()
    fits = validated.where("index < 800")
    assert ingest.accepted_logs(fits).select("ingest_seq").distinct().count() == 16_000
