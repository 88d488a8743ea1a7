"""Intermediate results that several later steps read, written once to shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_folder: str | None = None
_open: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one on a single machine."""
    global _local_folder
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError(f"{_SETTING} must name a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="vigilog-")
    return _local_folder


def staged(frame: DataFrame) -> DataFrame:
    """Write a frame and read it back.

    Cuts the lineage, so that a lost executor repeats only the steps after it, and gives the
    planner true sizes, so that it broadcasts what is small and nothing else.
    """
    path = f"{shared_folder(frame.sparkSession)}/stage-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside when the block ends, for steps that repeat for ever.

    Results that read the stages must have been written by then.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
