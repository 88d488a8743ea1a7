import random

from pyspark.sql import functions as F

from vigilog.sources.events import EventLog

SCHEMA = "key string, value int, epoch long, step int"


def log(spark, path, epochs=8):
    return EventLog(path, spark.createDataFrame([], SCHEMA).schema, "key", epochs)


def newest(rows, before):
    out = {}
    for key, value, epoch, step in sorted(rows, key=lambda r: r[2:]):
        if epoch < before:
            out[key] = value
    return out


def state(frame):
    return {r.key: r.value for r in frame.collect()}


def test_five_hundred_epochs_read_a_constant_number_of_files(spark, tmp_path):
    rng, table = random.Random(1), log(spark, str(tmp_path / "events"), 16)
    rows = [(f"k{rng.randrange(60)}", rng.randrange(1000), e, s) for e in range(500) for s in (0, 2)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("gen", F.floor(F.col("epoch") / 16))
    frame.coalesce(1).write.partitionBy("gen", "epoch", "step").parquet(table.path)
    for epoch in (0, 1, 16, 17, 250, 250, 499, 500):
        found = table.state_before(spark, epoch)
        assert state(found) == newest(rows, epoch)
        # At most a generation's events, two a epoch, and a snapshot.
        assert len(found.inputFiles()) <= 2 * 16 + 4
    assert state(table.state(spark)) == newest(rows, 500)
    assert table.history(spark).count() == len(rows)


def test_repeated_and_late_epochs(spark, tmp_path):
    table = log(spark, str(tmp_path / "events"), 2)
    assert state(table.state(spark)) == {}

    def write(epoch, step, *pairs):
        table.append(spark.createDataFrame(list(pairs), "key string, value int"), epoch, step)

    write(0, 0, ("a", 1), ("b", 1))
    write(1, 0, ("b", 2))
    write(2, 0, ("c", 3))
    assert state(table.state_before(spark, 2)) == {"a": 1, "b": 2}
    before = sorted(map(str, table.history(spark).collect()))
    write(2, 0, ("c", 3))  # repeated
    assert sorted(map(str, table.history(spark).collect())) == before
    assert state(table.state_before(spark, 2)) == {"a": 1, "b": 2}
    assert state(table.state(spark)) == {"a": 1, "b": 2, "c": 3}
    write(1, 4, ("a", 9))  # comes after the snapshot that should have it
    assert state(table.state_before(spark, 2)) == {"a": 9, "b": 2}
    assert state(table.state_before(spark, 1)) == {"a": 1, "b": 1}
    write(6, 0, ("a", 10))  # generations without events in between
    assert state(table.state_before(spark, 6)) == {"a": 9, "b": 2, "c": 3}
    assert state(table.state(spark)) == {"a": 10, "b": 2, "c": 3}
