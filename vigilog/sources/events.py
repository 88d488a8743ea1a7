"""A table of events by epoch and step, with snapshots of the newest row of each key.

Events are only ever added, or replaced by those of the same epoch and step when it is repeated.
Epochs are dealt to generations of a fixed number of epochs. A snapshot before a generation holds
the newest row of every key from all earlier epochs, so the state at an epoch needs one snapshot
and the events of at most one generation, however long the table has been written.

    path/gen=G/epoch=N/step=K/      events
    path/_snapshots/before=G/v=V/   snapshots; the highest complete version counts
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigilog.sources import files
from vigilog.sources.tables import latest_per

_DONE = "_SUCCESS"


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    return sorted(int(n[len(prefix):]) for n in files.names(spark, path) if n.startswith(prefix))


@dataclass(frozen=True)
class EventLog:
    """``schema`` has the columns ``epoch`` (long) and ``step`` (int) besides those of the rows."""

    path: str
    schema: StructType
    key: str
    epochs: int = 32

    def append(self, rows: DataFrame, epoch: int, step: int) -> None:
        """Write the events of an epoch and step; writing them again replaces them.

        Snapshots that should have had them, as they come late, are made anew.
        """
        spark = rows.sparkSession
        places = {"gen": F.lit(self._generation(epoch)), "epoch": F.lit(epoch).cast("long"), "step": F.lit(step)}
        rows.withColumns(places).write.partitionBy("gen", "epoch", "step").mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(self.path)
        for generation in _numbers(spark, self._snapshots(), "before="):
            if generation > self._generation(epoch) and self._complete(spark, generation) is not None:
                self._build(spark, generation, self._generation(epoch))

    def history(self, spark: SparkSession) -> DataFrame:
        """All events ever written."""
        return self._select(spark.read.schema(self.schema).parquet(self.path))

    def events_of(self, spark: SparkSession, epoch: int) -> DataFrame:
        generation = self._generation(epoch)
        return self._events(spark, generation, generation + 1).where(F.col("epoch") == epoch)

    def state_before(self, spark: SparkSession, epoch: int) -> DataFrame:
        """The newest row of each key from the epochs before this one."""
        generation = self._generation(epoch)
        if generation and self._complete(spark, generation) is None:
            self._build(spark, generation, generation)
        rows = self._events(spark, generation, generation + 1).where(F.col("epoch") < epoch)
        return self._newest(self._with_snapshot(spark, generation, rows))

    def state(self, spark: SparkSession) -> DataFrame:
        """The newest row of each key from all epochs."""
        generations = _numbers(spark, self.path, "gen=")
        return self.state_before(spark, (generations[-1] + 1) * self.epochs if generations else 0)

    def _generation(self, epoch: int) -> int:
        return epoch // self.epochs

    def _snapshots(self) -> str:
        return f"{self.path}/_snapshots"

    def _select(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.names).withColumns({"epoch": F.col("epoch").cast("long"), "step": F.col("step").cast("int")})

    def _newest(self, rows: DataFrame) -> DataFrame:
        return latest_per(rows, [self.key], F.struct("epoch", "step").desc())

    def _events(self, spark: SparkSession, first: int, end: int) -> DataFrame:
        there = [f"{self.path}/gen={g}" for g in range(first, end) if files.exists(spark, f"{self.path}/gen={g}")]
        if not there:
            return spark.createDataFrame([], self.schema)
        return self._select(spark.read.schema(self.schema).option("basePath", self.path).parquet(*there))

    def _complete(self, spark: SparkSession, generation: int) -> str | None:
        folder = f"{self._snapshots()}/before={generation}"
        done = [v for v in _numbers(spark, folder, "v=") if files.exists(spark, f"{folder}/v={v}/{_DONE}")]
        return f"{folder}/v={done[-1]}" if done else None

    def _with_snapshot(self, spark: SparkSession, generation: int, rows: DataFrame) -> DataFrame:
        stored = self._complete(spark, generation)
        return rows if stored is None else rows.unionByName(spark.read.schema(self.schema).parquet(stored))

    def _build(self, spark: SparkSession, generation: int, changed: int) -> None:
        """Write a snapshot from the newest one that is not after ``changed``, and the events since."""
        before = [g for g in _numbers(spark, self._snapshots(), "before=") if g <= changed and g < generation]
        base = max((g for g in before if self._complete(spark, g) is not None), default=0)
        first = base if base else min(_numbers(spark, self.path, "gen="), default=0)
        rows = self._newest(self._with_snapshot(spark, base, self._events(spark, first, generation)))
        folder = f"{self._snapshots()}/before={generation}"
        versions = _numbers(spark, folder, "v=")
        rows.write.mode("overwrite").parquet(f"{folder}/v={max(versions, default=-1) + 1}")
        # A reader may still be at the version before this one.
        for version in versions[:-1]:
            files.delete(spark, f"{folder}/v={version}")
        for old in _numbers(spark, self._snapshots(), "before=")[:-2]:
            files.delete(spark, f"{self._snapshots()}/before={old}")
