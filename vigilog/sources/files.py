"""Folders of tables, through the file system that Spark uses for the path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _at(spark, path)
    return files.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, one level deep; nothing if it does not exist."""
    target, files = _at(spark, path)
    return [entry.getPath().getName() for entry in files.listStatus(target)] if files.exists(target) else []


def mark(spark: SparkSession, path: str) -> None:
    """An empty file."""
    target, files = _at(spark, path)
    files.create(target, True).close()


def delete(spark: SparkSession, path: str) -> None:
    target, files = _at(spark, path)
    files.delete(target, True)


def write_lines(spark: SparkSession, path: str, lines: list[str]) -> None:
    """A small text file that appears whole: it is written aside and renamed."""
    target, files = _at(spark, path)
    aside, _ = _at(spark, f"{path}.aside")
    out = files.create(aside, True)
    out.write(bytearray("".join(f"{line}\n" for line in lines).encode()))
    out.close()
    files.delete(target, False)
    if not files.rename(aside, target):
        raise OSError(f"could not write {path}")


def read_lines(spark: SparkSession, path: str) -> list[str]:
    target, files = _at(spark, path)
    stream = files.open(target)
    try:
        return bytes(stream.readAllBytes()).decode().splitlines()
    finally:
        stream.close()
