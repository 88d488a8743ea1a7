"""Tables by day whose readers see a change whole or not at all.

Every change writes the days it touches into folders of a new version and then publishes a manifest
that names the version of each day. Readers go by the newest manifest, so while files are written,
or if the writer dies, they see the table as it was. What a manifest no longer names is kept until
the next change but one has been published, for readers that began before.

    path/dt=2024-01-05/v=7/       rows of a day as of change 7
    path/_manifests/7             lines "2024-01-05 7", one for each day
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from vigilog.sources import files


def _folder(path: str) -> str:
    return f"{path}/_manifests"


def newest(spark: SparkSession, path: str) -> tuple[int, dict[str, int]]:
    """Number of the last change, 0 if there was none, and the version of each day."""
    numbers = [int(n) for n in files.names(spark, _folder(path)) if n.isdigit()]
    if not numbers:
        return 0, {}
    lines = files.read_lines(spark, f"{_folder(path)}/{max(numbers)}")
    return max(numbers), {day: int(version) for day, version in (line.split() for line in lines)}


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of the last published change, with ``dt``."""
    whole = StructType([*schema.fields, StructField("dt", DateType())])
    _, days = newest(spark, path)
    if not days:
        return spark.createDataFrame([], whole)
    paths = [f"{path}/dt={day}/v={version}" for day, version in sorted(days.items())]
    return spark.read.schema(whole).option("basePath", path).parquet(*paths).select(*whole.names)


def replace_days(
    spark: SparkSession, path: str, rows: DataFrame | None, days: list[date], dropped: list[str] | None = None
) -> None:
    """Publish ``rows`` (with ``dt``) as all rows of these days; a day without rows is gone.

    ``dropped`` are days that go in the same change. Trying a change again that was not published
    replaces its files.
    """
    number, before = newest(spark, path)
    number += 1
    if rows is not None:
        rows.withColumn("v", F.lit(number)).write.partitionBy("dt", "v").mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(path)
    after = {day: version for day, version in before.items() if day not in set(dropped or [])}
    for day in (d.isoformat() for d in days):
        if f"v={number}" in files.names(spark, f"{path}/dt={day}"):
            after[day] = number
        else:
            after.pop(day, None)
    _publish(spark, path, number, after)
    _forget(spark, path, number, [d.isoformat() for d in days] + list(dropped or []))


def _publish(spark: SparkSession, path: str, number: int, days: dict[str, int]) -> None:
    files.write_lines(spark, f"{_folder(path)}/{number}", [f"{day} {version}" for day, version in sorted(days.items())])


def _forget(spark: SparkSession, path: str, number: int, touched: list[str]) -> None:
    """Delete what neither of the last two manifests names, of the days this change and the one before touched."""
    last = [newest(spark, path)[1]]
    earlier = f"{_folder(path)}/{number - 1}"
    if files.exists(spark, earlier):
        last.append({day: int(v) for day, v in (line.split() for line in files.read_lines(spark, earlier))})
    gone = set(touched) | {day for old in last for day in old}
    for day in gone:
        named = {f"v={days[day]}" for days in last if day in days}
        there = files.names(spark, f"{path}/dt={day}")
        for name in there:
            if name.startswith("v=") and name not in named:
                files.delete(spark, f"{path}/dt={day}/{name}")
    for old in files.names(spark, _folder(path)):
        if old.isdigit() and int(old) < number - 1:
            files.delete(spark, f"{_folder(path)}/{old}")
