"""The whole loop after each micro-batch: rollup, detection, packets, injection scan, alerts, pruning.

Each stage writes under the epoch of its batch and replaces what an earlier try of it wrote. When it
is through, it is entered in a ledger, so that a repeated epoch goes on after the last stage that
was completed. What a stage reads is fixed by the epoch: logs and rollup as of its batch, the
anomaly table before the epoch or with the steps entered for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilog import schemas
from vigilog.config import AlertPolicy, PacketBudget, RetentionPolicy
from vigilog.functions.triggers import has_readable_trigger
from vigilog.operators.alerts import due_alerts
from vigilog.operators.evidence import classification_evidence, flag_injection
from vigilog.plans.packets import render_classification_packet
from vigilog.sources import files
from vigilog.sources.logs import project_lines, read_logs, scan_logs
from vigilog.sources.retention import prune, retention_cutoffs
from vigilog.sources.rollups import read_rollup
from vigilog.sources.staging import stages
from vigilog.streaming.rollup import add_to_counts, prune_counts, recompute_dirty
from vigilog.streaming.watch import STEPS, Watch, record, run_detection


@dataclass(frozen=True)
class Ledger:
    """Which stages of an epoch are through: one empty file each, for the newest epoch only."""

    path: str

    def done(self, spark: SparkSession, epoch: int, stage: str) -> bool:
        return files.exists(spark, f"{self.path}/epoch={epoch}/{stage}")

    def enter(self, spark: SparkSession, epoch: int, stage: str) -> None:
        files.mark(spark, f"{self.path}/epoch={epoch}/{stage}")

    def forget_before(self, spark: SparkSession, epoch: int) -> None:
        for name in files.names(spark, self.path):
            if name.startswith("epoch=") and int(name[6:]) < epoch:
                files.delete(spark, f"{self.path}/{name}")


@dataclass(frozen=True)
class Loop:
    """Tables and settings of the stages besides those of the watch."""

    watch: Watch
    packets_path: str
    alerts_path: str
    ledger_path: str
    channels: list[str] = field(default_factory=list)
    #: The alerts tried so far, as rows of ``schemas.ALERT``; none if nothing delivers them yet.
    attempts: Callable[[SparkSession], DataFrame] | None = None
    policy: AlertPolicy = AlertPolicy()
    budget: PacketBudget = PacketBudget()
    retention: RetentionPolicy | None = None

    @property
    def ledger(self) -> Ledger:
        return Ledger(self.ledger_path)

    def packets(self, spark: SparkSession) -> DataFrame:
        """All packets written so far: anomaly_id, packet, epoch."""
        return spark.read.schema("anomaly_id string, packet string, epoch long").parquet(self.packets_path)

    def alerts(self, spark: SparkSession) -> DataFrame:
        """Alerts that were due after each of the last two epochs; those of the newest are due now."""
        return spark.read.schema("anomaly_id string, reason string, channel string, epoch long").parquet(self.alerts_path)


def _overwrite_epoch(rows: DataFrame, epoch: int, path: str) -> None:
    """Replace what the epoch had, also by nothing."""
    rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def _rollup(loop: Loop, batch: DataFrame, epoch: int) -> None:
    watch = loop.watch
    seconds = watch.config.bucket_seconds
    if watch.counts_path is not None:
        step = add_to_counts(seconds, watch.counts_path, watch.rollup_path, watch.signatures_path)
    else:
        step = recompute_dirty(seconds, watch.logs_path, watch.rollup_path, watch.signatures_path)
    step(batch, epoch)


def _detect(loop: Loop, batch: DataFrame, epoch: int) -> None:
    run_detection(batch.sparkSession, loop.watch, epoch)


def _changed(loop: Loop, spark: SparkSession, epoch: int) -> DataFrame:
    """Anomalies that the detection of this epoch created or extended and whose lines can be read."""
    rows = loop.watch.anomalies.events_of(spark, epoch).where(F.col("step") == STEPS["detected"])
    return rows.select(*[f.name for f in schemas.ANOMALY]).where(has_readable_trigger(F.col("triggers")))


def _packets(loop: Loop, batch: DataFrame, epoch: int) -> None:
    spark, watch = batch.sparkSession, loop.watch
    anomalies = _changed(loop, spark, epoch)
    span = anomalies.agg(F.unix_seconds(F.min("window_start")), F.unix_seconds(F.max("window_end"))).first()
    if span[0] is None:
        _overwrite_epoch(spark.createDataFrame([], "anomaly_id string, packet string"), epoch, loop.packets_path)
        return
    start, end = (datetime.fromtimestamp(s, timezone.utc) for s in span)
    lines = scan_logs(project_lines(read_logs(spark, watch.logs_path)), start=start, end=end)
    rows = read_rollup(spark, watch.rollup_path).where(F.col("dt").between(F.lit(start.date()), F.lit(end.date())))
    with stages(spark):
        found = classification_evidence(anomalies, lines, rows, watch.config.bucket_seconds, loop.budget)
        packets = render_classification_packet(found, loop.budget, watch.config.bucket_seconds).select("anomaly_id", "packet")
        _overwrite_epoch(packets, epoch, loop.packets_path)


def _scan(loop: Loop, batch: DataFrame, epoch: int) -> None:
    """Store what the scan of the packets found with the anomalies they are about."""
    spark = batch.sparkSession
    packets = loop.packets(spark).where(F.col("epoch") == epoch)
    anomalies = _changed(loop, spark, epoch).join(packets.select("anomaly_id"), "anomaly_id", "left_semi")
    record(flag_injection(anomalies, packets), loop.watch, epoch, "scanned")


def _alerts(loop: Loop, batch: DataFrame, epoch: int) -> None:
    spark = batch.sparkSession
    tried = loop.attempts(spark) if loop.attempts else spark.createDataFrame([], schemas.ALERT)
    current = loop.watch.anomalies.state_before(spark, epoch + 1)
    if not loop.channels:
        return
    due = due_alerts(current, tried, loop.channels, loop.watch.now(), loop.policy)
    _overwrite_epoch(due.select("anomaly_id", "reason", "channel"), epoch, loop.alerts_path)
    for name in files.names(spark, loop.alerts_path):
        if name.startswith("epoch=") and int(name[6:]) < epoch - 1:
            files.delete(spark, f"{loop.alerts_path}/{name}")


def _prune(loop: Loop, batch: DataFrame, epoch: int) -> None:
    """Retention, in the first step of each hour.

    A log table that the file sink writes has its own list of files, which deleting would break; it
    is left to whoever owns that sink.
    """
    spark, watch = batch.sparkSession, loop.watch
    if loop.retention is None:
        return
    now = watch.clock() if watch.clock else datetime.now(timezone.utc)
    hour, folder = f"hour={now:%Y%m%d%H}", f"{loop.ledger_path}/pruned"
    if files.exists(spark, f"{folder}/{hour}"):
        return
    limits = retention_cutoffs(now, loop.retention)
    if not files.exists(spark, f"{watch.logs_path}/_spark_metadata"):
        prune(spark, watch.logs_path, "timestamp", limits["logs"])
    prune(spark, watch.rollup_path, "bucket_start", limits["rollups"])
    if watch.counts_path is not None and None not in limits.values():
        prune_counts(spark, watch.counts_path, min(limits.values()), epoch)
    before = files.names(spark, folder)
    files.mark(spark, f"{folder}/{hour}")
    for name in before:
        files.delete(spark, f"{folder}/{name}")


#: In the order in which they run.
STAGES: dict[str, Callable[[Loop, DataFrame, int], None]] = {
    "rollup": _rollup, "detect": _detect, "packets": _packets, "scan": _scan, "alerts": _alerts, "prune": _prune,
}


def loop_step(loop: Loop, watch_stage: Callable[[str, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """The step for ``foreachBatch`` on a stream of stored log rows.

    ``watch_stage`` is called with each stage's name and epoch when it has run, before it is entered.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        for name, stage in STAGES.items():
            if loop.ledger.done(spark, epoch, name):
                continue
            stage(loop, batch, epoch)
            if watch_stage is not None:
                watch_stage(name, epoch)
            loop.ledger.enter(spark, epoch, name)
        loop.ledger.forget_before(spark, epoch)

    return step


def start_loop(
    logs: DataFrame, loop: Loop, checkpoint: str, watch_stage: Callable[[str, int], None] | None = None, **trigger
) -> StreamingQuery:
    step = loop_step(loop, watch_stage)
    return logs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()
