"""Tables by bucket that new lines are added to, without reading the lines before them.

A table holds mergeable rows: merging the rows of any parts of the lines gives the rows of all. Each
micro-batch writes the rows of its lines under its epoch, and replaces them if it is tried again.
Every so many epochs what came before is merged into the days, published in one step by
:mod:`vigilog.sources.versions`; a note of the same version says up to which epoch. A reader merges
the days of that version with the epochs after it.

    path/changes/epoch=12/dt=2024-01-05/    rows of the lines of one micro-batch
    path/days/                              rows merged so far, by day
    path/folded/7                           the epoch up to which version 7 of the days is merged
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.operators.rollup import on_days
from vigilog.sources import files, versions


@dataclass(frozen=True)
class Increments:
    """A table at ``path``; ``merge`` gives one row for all rows of a key, in the columns of ``schema``.

    The schema has ``service`` and ``bucket_start``. Epochs come in order, and only the newest may be
    tried again.
    """

    path: str
    schema: T.StructType
    merge: Callable[[DataFrame], DataFrame]
    #: Epochs that a reader merges at most, besides the days.
    every: int = 32

    def add(self, spark: SparkSession, rows: DataFrame, epoch: int) -> None:
        """Enter the rows of an epoch's new lines, in place of an earlier try."""
        folded, _ = self._folded(spark)
        if epoch - folded > self.every:
            self.fold(spark, epoch - 1)
        laid_out = rows.select(*self.schema.names, F.to_date("bucket_start").alias("dt")).repartition("dt", "service")
        laid_out.sortWithinPartitions("dt", "service", "bucket_start").write.mode("overwrite").partitionBy("dt").parquet(
            f"{self.path}/changes/epoch={epoch}"
        )

    def fold(self, spark: SparkSession, upto: int, drop_before: date | None = None) -> None:
        """Merge the epochs up to ``upto`` into the days they touch, and drop the days before a date."""
        folded, number = self._folded(spark)
        if upto <= folded and drop_before is None:
            return
        upto = max(upto, folded)
        changes = self._changes(spark, folded, upto)
        kept = F.lit(True) if drop_before is None else F.col("dt") >= F.lit(drop_before)
        days = [row.dt for row in changes.where(kept).select("dt").distinct().collect()]
        _, present = versions.newest(spark, self._days)
        dropped = [day for day in present if drop_before is not None and day < drop_before.isoformat()]
        rows = None
        if days:
            both = self._merged_days(spark).unionByName(changes).where(F.col("dt").isin(days))
            rows = self.merge(both).withColumn("dt", F.to_date("bucket_start"))
            rows = rows.repartition("dt", "service").sortWithinPartitions("dt", "service", "bucket_start")
        # Read only once the version of this number is published.
        files.write_lines(spark, f"{self.path}/folded/{number + 1}", [str(upto)])
        versions.replace_days(spark, self._days, rows, days, dropped)
        self._forget(spark, folded, number)

    def rows_of(self, spark: SparkSession, dirty: DataFrame, upto: int | None = None) -> DataFrame:
        """The merged rows of (service, bucket) keys, as of an epoch.

        The days of the keys go into the scans as literals, and nothing else of the table is read.
        """
        keys = dirty.select("service", "bucket_start", F.to_date("bucket_start").alias("dt")).distinct()
        found = self._all(spark, upto, on_days(dirty)).join(keys, ["dt", "service", "bucket_start"], "left_semi")
        return self.merge(found)

    def read(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """All merged rows as of an epoch."""
        return self.merge(self._all(spark, upto, F.lit(True)))

    @property
    def _days(self) -> str:
        return f"{self.path}/days"

    def _merged_days(self, spark: SparkSession) -> DataFrame:
        return versions.read(spark, self._days, self.schema)

    def _all(self, spark: SparkSession, upto: int | None, where: Column) -> DataFrame:
        folded, _ = self._folded(spark)
        return self._merged_days(spark).where(where).unionByName(self._changes(spark, folded, upto).where(where))

    def _folded(self, spark: SparkSession) -> tuple[int, int]:
        """The epoch up to which the days are merged, -1 for none, and their version."""
        number, _ = versions.newest(spark, self._days)
        if number == 0:
            return -1, 0
        return int(files.read_lines(spark, f"{self.path}/folded/{number}")[0]), number

    def _epochs(self, spark: SparkSession) -> list[int]:
        return sorted(int(n[6:]) for n in files.names(spark, f"{self.path}/changes") if n.startswith("epoch="))

    def _changes(self, spark: SparkSession, after: int, upto: int | None) -> DataFrame:
        whole = T.StructType([*self.schema.fields, T.StructField("dt", T.DateType())])
        epochs = [e for e in self._epochs(spark) if e > after and (upto is None or e <= upto)]
        if not epochs:
            return spark.createDataFrame([], whole)
        paths = [f"{self.path}/changes/epoch={e}" for e in epochs]
        return spark.read.schema(whole).option("basePath", f"{self.path}/changes").parquet(*paths).select(*whole.names)

    def _forget(self, spark: SparkSession, folded: int, number: int) -> None:
        """Delete the epochs that the version before this one had merged already, and older notes."""
        for epoch in self._epochs(spark):
            if epoch <= folded:
                files.delete(spark, f"{self.path}/changes/epoch={epoch}")
        for name in files.names(spark, f"{self.path}/folded"):
            if name.isdigit() and int(name) < number:
                files.delete(spark, f"{self.path}/folded/{name}")
