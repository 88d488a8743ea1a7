import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import at
from test_streaming import ONCE, batch_rollup, entry, ingest_all, post, streamed_rollup
from vigilog import schemas
from vigilog.operators import rollup, signatures
from vigilog.operators.latency_counts import count_latencies, latency_table, rollup_of_counts
from vigilog.sources import files, versions
from vigilog.sources import logs as log_source
from vigilog.sources.rollups import read_rollup, read_signatures
from vigilog.streaming import rollup as stream_rollup

DAY = 24 * 60


def some_lines(spark, n, seed=1, days=3):
    rng = random.Random(seed)
    latency = [None, 0.0, -1.5, float("inf"), float("nan"), 7.0, 7.0, 1e12]
    rows = [
        (i, at(rng.randrange(days * DAY)), rng.choice("ab"), rng.choice(["info", "error"]), f"m {rng.randrange(4)}", None,
         rng.choice([None, "", "/x", "/y"]), 200, rng.choice(latency) if rng.random() < 0.3 else float(rng.randrange(900)))
        for i in range(n)
    ]
    frame = spark.createDataFrame(rows, schemas.LINES)
    return frame.withColumn("error_signature", F.when(F.col("level") == "error", F.col("message")))


def text_rows(frame):
    return sorted(str(row) for row in frame.collect())


@pytest.mark.parametrize("bucket_seconds", [3600, 7 * 86_400])
@pytest.mark.parametrize("most_values", [1 << 18, 5])
def test_counts_give_the_rollup_of_the_lines(spark, bucket_seconds, most_values):
    """Also where keys have more different latencies than one task orders."""
    lines = some_lines(spark, 400).where(~F.isnan("latency_ms") & (F.abs("latency_ms") < 1e9) | F.col("latency_ms").isNull())
    found = rollup_of_counts(count_latencies(lines, bucket_seconds), most_values)
    expected = rollup.rollup(lines, bucket_seconds)
    assert found.columns == expected.columns and text_rows(found) == text_rows(expected)
    assert rollup_of_counts(count_latencies(lines.limit(0), bucket_seconds)).count() == 0


def test_merging_counts_of_parts_loses_nothing(spark):
    lines = some_lines(spark, 300)
    parts = [count_latencies(lines.where(F.col("ingest_seq") % 4 == k), 3600) for k in range(4)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    assert text_rows(rollup_of_counts(both)) == text_rows(rollup_of_counts(count_latencies(lines, 3600)))


def test_twenty_shuffled_late_batches(spark, tmp_path):
    """Some epochs are tried again with other rows first; the table is folded on the way."""
    lines = some_lines(spark, 600).cache()
    order = list(range(20))
    random.Random(3).shuffle(order)
    table = latency_table(str(tmp_path / "counts"), every=6)
    for epoch, part in enumerate(order):
        new = lines.where(F.col("ingest_seq") % 20 == part)
        if epoch % 5 == 0:
            table.add(spark, count_latencies(lines.where("ingest_seq < 50"), 3600), epoch)
        table.add(spark, count_latencies(new, 3600), epoch)
        assert len(table._epochs(spark)) <= 2 * table.every + 2
    assert text_rows(rollup_of_counts(table.read(spark))) == text_rows(rollup_of_counts(count_latencies(lines, 3600)))
    # What one epoch's buckets need comes from their days alone.
    late = lines.where(F.to_date("timestamp") == F.lit(at(DAY).date())).limit(3)
    dirty = rollup.dirty_buckets(late, 3600).cache()
    read = table.rows_of(spark, dirty)
    expected = rollup.rollup_dirty(lines, dirty, 3600)
    assert text_rows(rollup_of_counts(read)) == text_rows(rollup_of_counts(count_latencies(rollup.lines_of_dirty(lines, dirty, 3600), 3600)))
    assert rollup_of_counts(read).count() == expected.count()
    plan = read._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert scans and all(re.search(r"dt#\d+ (=|IN)", scan) for scan in scans)
    lines.unpersist()
    dirty.unpersist()


def test_a_writer_that_dies_while_folding_changes_nothing(spark, tmp_path, monkeypatch):
    lines = some_lines(spark, 200)
    parts = [count_latencies(lines.where(F.col("ingest_seq") % 5 == k), 3600) for k in range(5)]
    table = latency_table(str(tmp_path), every=2)
    for epoch in range(3):
        table.add(spark, parts[epoch], epoch)
    before, publish = text_rows(table.read(spark)), versions._publish
    began = table.read(spark)

    def dies(*args):
        raise RuntimeError("killed")

    monkeypatch.setattr(versions, "_publish", dies)
    with pytest.raises(RuntimeError):
        table.fold(spark, 2)
    assert text_rows(table.read(spark)) == before
    monkeypatch.setattr(versions, "_publish", publish)
    table.fold(spark, 2)
    assert text_rows(table.read(spark)) == before == text_rows(began)
    table.fold(spark, 2)  # nothing to do
    for epoch in (3, 4):
        table.add(spark, parts[epoch], epoch)
    assert text_rows(table.read(spark)) == text_rows(table.merge(count_latencies(lines, 3600)))
    assert text_rows(table.read(spark, 2)) == before
    # Days may be dropped; an epoch without lines is one too.
    table.add(spark, parts[0].limit(0), 5)
    table.fold(spark, 5, at(DAY).date())
    left = count_latencies(lines.where(F.to_date("timestamp") >= F.lit(at(DAY).date())), 3600)
    assert text_rows(table.read(spark)) == text_rows(table.merge(left))
    table.fold(spark, 5, at(30 * DAY).date())
    assert table.read(spark).count() == 0


def test_stream_reads_no_earlier_line(spark, tmp_path, monkeypatch):
    base, rng = str(tmp_path), random.Random(6)
    entries = [entry(rng.uniform(-3000, 0), rng.choice(["info", "error"]), f"m {i % 7}", rng.randint(1, 500), rng.choice("ab")) for i in range(300)]

    def forbidden(*args):
        raise AssertionError("read the log table")

    monkeypatch.setattr(stream_rollup, "read_logs", forbidden)
    for part in range(3):
        post(f"{base}/in", f"b{part}", part, entries[part::3])
        ingest_all(spark, base)
        logs = spark.readStream.schema(log_source.schemas.LOGS).parquet(f"{base}/logs")
        stream_rollup.start_rollup(
            logs, f"{base}/logs", f"{base}/rollup", f"{base}/ck-rollup", signatures_path=f"{base}/signatures",
            counts_path=f"{base}/counts", **ONCE,
        ).awaitTermination()
        assert streamed_rollup(spark, base) == batch_rollup(spark, base)
    lines = log_source.project_lines(log_source.read_logs(spark, f"{base}/logs"))
    stored = read_signatures(spark, f"{base}/signatures").drop("dt")
    assert text_rows(stored) == text_rows(signatures.stored_buckets(lines, 60).select(*stored.columns))
    stream_rollup.prune_counts(spark, f"{base}/counts", at(30 * DAY), 9)
    assert latency_table(f"{base}/counts/latencies").read(spark).count() == 0
    assert read_rollup(spark, f"{base}/rollup").count() > 0 and files.names(spark, f"{base}/counts/latencies/days")
