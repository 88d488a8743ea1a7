"""Append-only result tables and checks on what they hold.

Verdicts, correlations, hypotheses, calls and alerts are appended as events. The current
row of an id is a view over them, so that no stored row is ever updated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigilog import schemas


def append(frame: DataFrame, schema: StructType, path: str) -> None:
    """Append rows in exactly the table's shape."""
    schemas.same_shape(frame, schema).write.mode("append").parquet(path)


def read(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def latest_per(frame: DataFrame, keys: list[str], *newest_first: Column) -> DataFrame:
    """The newest row per key. Give a total order if ties matter."""
    ranked = Window.partitionBy(*keys).orderBy(*newest_first)
    return frame.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def missing_columns(frame: DataFrame, expected: StructType, table: str) -> list[str]:
    """Columns the code expects and the table lacks."""
    present = set(frame.columns)
    return [f"{table}.{field.name}" for field in expected if field.name not in present]


def require_columns(frame: DataFrame, expected: StructType, table: str) -> DataFrame:
    missing = missing_columns(frame, expected, table)
    if missing:
        raise ValueError(f"table is older than the code, missing: {', '.join(missing)}")
    return frame
