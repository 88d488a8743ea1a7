import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from helpers import at, rollup_rows
from vigilog.sources import files, versions
from vigilog.sources.retention import prune
from vigilog.sources.rollups import read_rollup, upsert_rollup

DAY = 24 * 60


def table(spark, days, requests=10, services=("a", "b")):
    return rollup_rows(spark, [(d * DAY + m, s, requests, 1, 50) for d in days for m in range(3) for s in services])


def dirty_of(rows):
    return rows.select("service", "bucket_start").distinct()


def rows_of(spark, path):
    return sorted((r.bucket_start, r.service, r.request_count) for r in read_rollup(spark, path).collect())


def test_a_change_is_seen_when_it_is_published(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rollup")
    assert rows_of(spark, path) == []
    first = table(spark, [0, 1])
    upsert_rollup(spark, first, dirty_of(first), path)
    before = rows_of(spark, path)
    assert len(before) == 12
    more = table(spark, [1, 2], 20, ("b",))
    began = read_rollup(spark, path)  # a reader that knows its files already
    publish, seen = versions._publish, []

    def watched(*args):
        seen.append(rows_of(spark, path))
        publish(*args)
        seen.append(rows_of(spark, path))

    monkeypatch.setattr(versions, "_publish", watched)
    upsert_rollup(spark, more, dirty_of(more), path)
    after = rows_of(spark, path)
    assert seen == [before, after] and len(after) == 15 and [r[2] for r in after].count(20) == 6
    assert began.count() == 12
    # A writer that dies before it publishes changes nothing; the next try goes on as if it had not been.
    def dies(*args):
        raise RuntimeError("killed")

    monkeypatch.setattr(versions, "_publish", dies)
    third = table(spark, [0], 30)
    with pytest.raises(RuntimeError):
        upsert_rollup(spark, third, dirty_of(third), path)
    assert rows_of(spark, path) == after
    monkeypatch.setattr(versions, "_publish", publish)
    upsert_rollup(spark, third, dirty_of(third), path)
    assert [r[2] for r in rows_of(spark, path)].count(30) == 6 and len(rows_of(spark, path)) == 15
    # Empty dirty buckets lose their rows; old versions do not pile up.
    upsert_rollup(spark, third.limit(0), dirty_of(third), path)
    assert len(rows_of(spark, path)) == 9
    upsert_rollup(spark, more, dirty_of(more), path)
    assert len(files.names(spark, f"{path}/_manifests")) <= 4  # two, and their checksums
    assert all(len([v for v in files.names(spark, f"{path}/{d}") if v.startswith("v=")]) <= 2 for d in files.names(spark, path) if d.startswith("dt="))


def test_pruning_in_one_step(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rollup")
    rows = table(spark, [0, 1, 2, 3])
    upsert_rollup(spark, rows, dirty_of(rows), path)
    before, seen = rows_of(spark, path), []
    publish = versions._publish

    def watched(*args):
        seen.append(rows_of(spark, path))
        publish(*args)

    monkeypatch.setattr(versions, "_publish", watched)
    limit = at(2 * DAY + 1)
    prune(spark, path, "bucket_start", limit)
    after = rows_of(spark, path)
    assert seen == [before] and len(after) == 2 * 2 + 6
    prune(spark, path, "bucket_start", datetime(2020, 1, 1, tzinfo=timezone.utc))
    assert rows_of(spark, path) == after
    prune(spark, path, "bucket_start", limit + timedelta(days=30))
    assert rows_of(spark, path) == []


def test_a_reader_beside_a_writer_never_sees_fewer_rows(spark, tmp_path):
    path = str(tmp_path / "rollup")
    rows = table(spark, range(6))
    upsert_rollup(spark, rows, dirty_of(rows), path)
    counts, done = [], threading.Event()

    def reader():
        while not done.is_set():
            counts.append(read_rollup(spark, path).agg(F.count("*"), F.countDistinct("request_count")).first())

    thread = threading.Thread(target=reader)
    thread.start()
    for n in range(3):
        fresh = table(spark, range(6), 100 + n)
        upsert_rollup(spark, fresh, dirty_of(fresh), path)
    done.set()
    thread.join()
    assert counts and {tuple(c) for c in counts} == {(36, 1)}
