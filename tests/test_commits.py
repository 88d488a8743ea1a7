import os

import pytest
from pyspark.sql import functions as F

from vigilog.sources import commits

RECORD, UNIT = "\x1e", "\x1f"


def export(n, diff_lines=3):
    out = []
    for i in range(n):
        header = UNIT.join((f"{i:040x}", "2026-11-02T10:00:00+00:00", "Ann", f"Change {i}", f"body {i}\nof two lines"))
        files = f"{i % 50}\t{i % 7}\tsrc/file{i % 9}.js\n-\t-\tlogo.png\n"
        diff = "\n".join([f"diff --git a/x b/x {i}"] + [f"+line {j} of {i}" for j in range(diff_lines * (i % 3))])
        out.append(f"{RECORD}{header}{RECORD}\n\n{files}" + (f"\n{diff}\n" if i % 4 else ""))
    return "".join(out)


def written(tmp_path, **texts):
    for name, text in texts.items():
        with open(tmp_path / f"{name}.txt", "w", newline="") as out:
            out.write(text)
    return str(tmp_path)


@pytest.fixture
def split_bytes(spark):
    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def digest(frame):
    row = frame.agg(F.count("*"), F.sum(F.xxhash64(*frame.columns).cast("decimal(20,0)"))).first()
    return tuple(row)


def test_a_large_export_is_read_by_several_tasks(spark, tmp_path, split_bytes):
    path = written(tmp_path, a=export(100_000), b=export(7))
    whole = digest(commits.parse_git_log(spark.read.text(path, wholetext=True)))
    assert whole[0] == 100_007
    split_bytes(1 << 20)
    assert spark.read.option("lineSep", RECORD).text(path).rdd.getNumPartitions() > os.path.getsize(tmp_path / "a.txt") // (1 << 21)
    assert digest(commits.read_commits(spark, path)) == whole


@pytest.mark.parametrize("size", [64, 97, 150, 1000])
def test_splits_anywhere_give_the_same_commits(spark, tmp_path, split_bytes, size):
    path = written(tmp_path, a=export(12, 1), b="before the first mark" + export(3), c="", d=export(1).rstrip("\n"))
    whole = digest(commits.parse_git_log(spark.read.text(path, wholetext=True)))
    split_bytes(size)
    assert digest(commits.read_commits(spark, path)) == whole


@pytest.mark.parametrize("size", [80, 1 << 20])
@pytest.mark.parametrize("text", ["x" * 300, UNIT.join(("a" * 39, "x", "y", "z", "w"))])
def test_bad_framing_fails_however_it_is_split(spark, tmp_path, split_bytes, size, text):
    path = written(tmp_path, a=export(4) + RECORD + text + export(4))
    split_bytes(size)
    with pytest.raises(Exception, match="bad record header"):
        commits.read_commits(spark, path).collect()


def test_a_path_over_the_limit_is_a_reject(spark):
    header = UNIT.join(("b" * 40, "2026-11-02T10:00:00+00:00", "Ann", "s", "b"))
    frame = spark.createDataFrame([(f"{RECORD}{header}{RECORD}\n1\t2\t{'p' * 401}\n" + export(1),)], "value string")
    assert [r.sha for r in commits.parse_git_log(frame).collect()] == ["0" * 40]
    assert [r.reason for r in commits.oversized_commits(frame).collect()] == ["files: a path over 400 characters"]


def test_every_record_is_parsed_once(spark):
    frame = spark.createDataFrame([(export(3),)], "value string")
    plan = commits.parse_git_log(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_instr(") == 1 and plan.count("bad file line") == 1
