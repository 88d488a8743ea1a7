"""What follows a rollup: detection, incident state, alerts.

The anomaly table is append-only: every run adds the rows it created or changed under its
epoch, and so do verdicts, correlations, hypotheses and injection scans under a step of the
epoch they followed. The current state is the newest row per id, read from a snapshot and the
epochs after it (:mod:`vigilog.sources.events`). A run reads only epochs before its own and
overwrites its own, so repeating it changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog import schemas
from vigilog.config import AlertPolicy, DetectionConfig
from vigilog.functions import times
from vigilog.operators.alerts import due_alerts
from vigilog.operators.detect import detect_latest, firings, reach_of
from vigilog.operators.frames import newest_bucket
from vigilog.operators.incidents import persist_run
from vigilog.sources.events import EventLog
from vigilog.sources.logs import project_lines, read_logs, scan_logs
from vigilog.sources.rollups import read_rollup, read_signatures
from vigilog.sources.staging import staged, stages
from vigilog.sources.tables import latest_per

_EVENTS = T.StructType(schemas.ANOMALY.fields + [
    T.StructField("action", T.StringType()),
    T.StructField("added_kinds", T.ArrayType(T.StringType())),
    T.StructField("epoch", T.LongType()),
    T.StructField("step", T.IntegerType()),
])
#: What changes an anomaly within an epoch, in this order.
STEPS = {"detected": 0, "classified": 1, "correlated": 2, "diagnosed": 3, "scanned": 4}


@dataclass(frozen=True)
class Watch:
    """Tables and settings of the detection that runs after each rollup."""

    logs_path: str
    rollup_path: str
    anomalies_path: str
    config: DetectionConfig = field(default_factory=DetectionConfig)
    # Where the rollup step stores signatures by bucket; without it a run reads the lines in reach.
    signatures_path: str | None = None
    # Where the rollup step keeps counts, so that late lines reread no earlier ones.
    counts_path: str | None = None
    # The wall clock of a run, with time zone, for silence; without it that detector does not run.
    clock: Callable[[], datetime] | None = None

    @property
    def anomalies(self) -> EventLog:
        return EventLog(self.anomalies_path, _EVENTS, "anomaly_id")

    def now(self) -> Column:
        return times.instant(self.clock()) if self.clock else F.current_timestamp()


def anomaly_events(spark: SparkSession, path: str) -> DataFrame:
    """Every change of every anomaly."""
    return EventLog(path, _EVENTS, "anomaly_id").history(spark)


def current_anomalies(events: DataFrame) -> DataFrame:
    newest = latest_per(events, ["anomaly_id"], F.struct("epoch", "step").desc())
    return newest.select(*[f.name for f in schemas.ANOMALY])


def run_detection(spark: SparkSession, watch: Watch, epoch: int) -> None:
    """One run at the newest bucket, folded into the anomaly table."""
    config = watch.config
    rows = read_rollup(spark, watch.rollup_path)
    newest = newest_bucket(rows)
    if newest is None:
        return
    # Nothing looks further back than this, so only these days of either table are read.
    moment = watch.clock() if watch.clock else None
    reach = reach_of(newest, config)
    if moment is not None:
        silence = config.silence_lookback_minutes + config.silence_baseline_minutes
        reach = min(reach, moment - timedelta(minutes=silence))
    in_reach = (F.col("dt") >= F.lit(reach.date())) & (F.col("bucket_start") >= times.instant(reach))
    rows = rows.where(in_reach)
    buckets = None
    if watch.signatures_path is not None:
        buckets = read_signatures(spark, watch.signatures_path).where(in_reach)
    lines = scan_logs(project_lines(read_logs(spark, watch.logs_path)), start=reach)
    now: Column | None = times.instant(moment) if moment is not None else None
    seen_at = now if now is not None else times.instant(newest + timedelta(seconds=config.bucket_seconds))
    before = watch.anomalies.state_before(spark, epoch).select(*[f.name for f in schemas.ANOMALY])
    with stages(spark):
        # A few rows per service: written once, then joined to the anomaly table.
        fired = staged(firings(detect_latest(lines, rows, config, now, buckets)))
        watch.anomalies.append(persist_run(before, fired, seen_at, config), epoch, STEPS["detected"])


def record(anomalies: DataFrame, watch: Watch, epoch: int, step: str) -> None:
    """Append anomalies as a later step left them, for instance with a verdict.

    ``anomalies`` has the anomaly columns; rows that did not change may be left out. The next run
    of the detection sees them: it extends a dismissed incident, and opens another for a new kind
    of trigger.
    """
    rows = anomalies.select(*[f.name for f in schemas.ANOMALY]).withColumns(
        {"action": F.lit(step), "added_kinds": F.array().cast("array<string>")}
    )
    watch.anomalies.append(rows, epoch, STEPS[step])


def detection_step(
    watch: Watch, then: Callable[[SparkSession, Watch, int], None] | None = None
) -> Callable[[DataFrame, int], None]:
    """For ``start_rollup(then=...)``: rollup first, then detection, then what ``then`` adds.

    ``then`` may classify and :func:`record` verdicts, queue :func:`pending_alerts` and prune.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        run_detection(batch.sparkSession, watch, epoch)
        if then is not None:
            then(batch.sparkSession, watch, epoch)

    return step


def pending_alerts(
    spark: SparkSession, watch: Watch, attempts: DataFrame, channels: list[str], policy: AlertPolicy = AlertPolicy()
) -> DataFrame:
    """Alerts due on the current anomalies, for whatever delivers them."""
    return due_alerts(watch.anomalies.state(spark), attempts, channels, watch.now(), policy)
