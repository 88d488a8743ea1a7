"""Folding firings into incidents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog import fixed_values as V
from vigilog.config import DetectionConfig
from vigilog.functions import times
from vigilog.functions.triggers import added_kinds, has_trigger, kinds, merge_triggers
from vigilog.operators.frames import chunk_seconds
from vigilog.schemas import ANOMALY
from vigilog.sources.staging import staged

_KINDS = list(V.TRIGGER_WEIGHTS)


def anomaly_id(service: Column, window_start: Column) -> Column:
    """A stable id, so that recomputing a run produces the same anomalies."""
    return F.md5(F.concat_ws("|", service, F.unix_seconds(window_start).cast("string")))


def _order() -> list[Column]:
    """Firings in run order: by end of window, the silence pass first."""
    silent_last = F.when(has_trigger(F.col("triggers"), V.SERVICE_SILENT), 0).otherwise(1)
    return [F.col("window_end"), silent_last, F.col("window_start")]


def _kind_bits(triggers: Column) -> Column:
    """The kinds of an array of triggers as bits of an integer."""
    held = [F.when(has_trigger(triggers, kind), 1 << i).otherwise(0) for i, kind in enumerate(_KINDS)]
    return reduce(Column.__add__, held).cast("int")


def _in_chunks(firings: DataFrame, config: DetectionConfig) -> DataFrame:
    """Number the firings inside (service, time chunk), as if each chunk were a history of its own.

    ``_run`` counts the chunk's firings from 1; ``_part`` counts the incidents that begin in it, not
    with its first firing, whose incident may have begun before.
    """
    inside = Window.partitionBy("service", "_chunk").orderBy(*_order())
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # In run order the latest end so far is that of the firing before.
    begins = F.lag("window_end").over(inside) < times.shift(F.col("window_start"), -config.merge_gap_minutes * 60)
    return (
        firings.withColumn("_chunk", F.floor(F.unix_seconds("window_end") / chunk_seconds(config)))
        .withColumn("_run", F.row_number().over(inside))
        .withColumn("_begins", F.coalesce(begins, F.lit(False)).cast("int"))
        .withColumn("_part", F.sum("_begins").over(upto))
        .withColumn("_bits", _kind_bits(F.col("triggers")))
    )


def _scan_chunks(local: DataFrame, config: DetectionConfig) -> DataFrame:
    """One row a chunk: what the chunks before it leave to it.

    ``_opens`` says that its first firing begins an incident, ``_runs`` and ``_incidents`` count what
    was before (``_incidents`` with the one its first firing belongs to), ``_carried`` has the kinds
    that the incident still open at its start has had so far.
    """
    summary = (
        local.groupBy("service", "_chunk", "_part")
        .agg(
            F.count("*").alias("n"), F.bit_or("_bits").alias("bits"), F.min("_run").alias("run"),
            F.min_by("window_start", "_run").alias("start"), F.max("window_end").alias("end"),
        )
        .groupBy("service", "_chunk")
        .agg(
            F.sum("n").alias("_n"), F.max("_part").alias("_begun"), F.max_by("bits", "_part").alias("_tail"),
            F.min_by("start", "run").alias("_start"), F.max("end").alias("_end"),
        )
    )
    in_order = Window.partitionBy("service").orderBy("_chunk")
    before, upto = in_order.rowsBetween(Window.unboundedPreceding, -1), in_order.rowsBetween(Window.unboundedPreceding, 0)
    ended = F.lag("_end").over(in_order)
    opens = ended.isNull() | (ended < times.shift(F.col("_start"), -config.merge_gap_minutes * 60))
    same = Window.partitionBy("service", "_island").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    return (
        summary.withColumn("_opens", opens.cast("int"))
        .withColumn("_runs", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_incidents", F.coalesce(F.sum(F.col("_begun") + F.col("_opens")).over(before), F.lit(0)) + F.col("_opens"))
        # Chunks through which one incident goes on; the last part of the first of them belongs to it.
        .withColumn("_island", F.sum(F.when(F.col("_begun") + F.col("_opens") > 0, 1).otherwise(0)).over(upto))
        .withColumn("_held", F.bit_or("_tail").over(same))
        .withColumn("_carried", F.when(F.col("_opens") == 0, F.lag("_held").over(in_order)).otherwise(0))
        .select("service", "_chunk", "_opens", "_runs", "_incidents", "_carried")
    )


def _numbered(firings: DataFrame, config: DetectionConfig) -> DataFrame:
    """Firings with run and incident numbers, by a segmented scan over time chunks.

    A task orders the firings of one service and chunk; only one summary row a chunk is ordered by
    service. So a service with a long history is spread over tasks.
    """
    local = staged(_in_chunks(firings, config))
    return (
        local.join(_scan_chunks(local, config), ["service", "_chunk"])
        .withColumn("run_no", F.col("_runs") + F.col("_run"))
        .withColumn("incident_no", F.col("_incidents") + F.col("_part"))
    )


def assign_incidents(firings: DataFrame, config: DetectionConfig) -> DataFrame:
    """Add ``incident_no`` and the run order ``run_no``.

    A firing joins the incident before it unless it starts more than the merge gap after
    everything seen so far.
    """
    return _numbered(firings, config).select(*firings.columns, "run_no", "incident_no")


def merge_incidents(firings: DataFrame, config: DetectionConfig) -> DataFrame:
    """Incidents from a history of firings with no verdict in between.

    The window keeps the start of its first firing and the latest end; each kind keeps its
    newest trigger, in the order the kinds first appeared.
    """
    single = assign_incidents(firings, config).select(
        "service", "incident_no", "run_no", "window_start", "window_end", F.posexplode("triggers").alias("pos", "trigger")
    )
    # Every aggregate is combined in the tasks first, so an incident that never ends is no hot group.
    per_kind = single.groupBy("service", "incident_no", F.col("trigger.kind").alias("kind")).agg(
        F.min(F.struct("run_no", "pos")).alias("first"),
        F.max_by("trigger", "run_no").alias("trigger"),
        F.min(F.struct("run_no", "window_start")).alias("_opened"),
        F.max(F.struct("run_no", "window_end")).alias("_latest"),
        F.max("window_end").alias("window_end"),
        F.count_if(F.col("pos") == 0).alias("firing_count"),
    )
    # One entry per trigger kind: four at most.
    merged = per_kind.groupBy("service", "incident_no").agg(
        F.min("_opened")["window_start"].alias("window_start"),
        F.max("window_end").alias("window_end"),
        F.max("_latest")["window_end"].alias("detected_at"),
        F.sum("firing_count").alias("firing_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("first", "kind", "trigger"))), lambda e: e["trigger"]).alias("triggers"),
    )
    return merged.select(
        anomaly_id(F.col("service"), F.col("window_start")).alias("anomaly_id"),
        "detected_at", "window_start", "window_end", "service", "triggers", "firing_count",
    )


def firing_actions(firings: DataFrame, config: DetectionConfig) -> DataFrame:
    """Per firing: whether it created or extended an incident, and which kinds it added."""
    earlier = (
        Window.partitionBy("service", "_chunk", "_part").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = F.when(F.col("_part") == 0, F.col("_carried")).otherwise(0)
    known = F.coalesce(F.bit_or("_bits").over(earlier), F.lit(0)).bitwiseOR(carried)
    created = (F.col("_begins") == 1) | ((F.col("_run") == 1) & (F.col("_opens") == 1))
    fresh = [
        F.when(F.col("_bits").bitwiseAND(F.bitwise_not("_known")).bitwiseAND(F.lit(1 << i)) != 0, F.lit(kind))
        for i, kind in enumerate(_KINDS)
    ]
    return _numbered(firings, config).withColumn("_known", known).select(
        "service", "incident_no", "window_start", "window_end",
        F.when(created, "created").otherwise("extended").alias("action"),
        F.array_sort(F.array_compact(F.array(*fresh))).alias("added_kinds"),
    )


def as_anomalies(incidents: DataFrame) -> DataFrame:
    """Rows of the anomaly table before any verdict."""
    given = set(incidents.columns)
    columns = [
        F.col(f.name) if f.name in given else (F.lit("open") if f.name == "status" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in ANOMALY
    ]
    return incidents.select(*columns)


def persist_run(anomalies: DataFrame, firings: DataFrame, now: Column, config: DetectionConfig) -> DataFrame:
    """Apply the firings of one run (at most one per service) to the anomaly table.

    Extends the newest mergeable anomaly of the service whose window ends within the merge
    gap; a dismissed one is left alone when a new kind shows up. Returns the rows that are
    new or changed, with ``action`` and ``added_kinds``; append them and read the newest
    row per id.
    """
    gap = config.merge_gap_minutes * 60
    fired = firings.select(
        "service",
        F.col("window_start").alias("_start"), F.col("window_end").alias("_end"), F.col("triggers").alias("_new"),
    )
    open_until = times.shift(F.col("_start"), -gap)
    candidates = fired.join(
        anomalies.where(F.col("status").isin(V.MERGEABLE_STATUSES)), "service"
    ).where(F.col("window_end") >= open_until)
    newest = Window.partitionBy("service").orderBy(F.col("window_end").desc(), F.col("anomaly_id"))
    recent = candidates.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1")
    fresh_kinds = added_kinds(F.col("triggers"), F.col("_new"))
    extended = (
        recent.where((F.col("status") != "dismissed") | (F.size(fresh_kinds) == 0))
        .withColumn("added_kinds", fresh_kinds)
        .withColumn("triggers", merge_triggers(F.col("triggers"), F.col("_new")))
        .withColumn("window_end", F.greatest("window_end", "_end"))
        .withColumn("detected_at", now)
        .withColumn("action", F.lit("extended"))
    )
    created = fired.join(extended.select("service"), "service", "left_anti")
    created = as_anomalies(
        created.select(
            # The kinds keep it apart from a dismissed anomaly that began at the same moment.
            F.md5(
                F.concat_ws(
                    "|", "service", F.unix_seconds("_start").cast("string"), F.array_join(kinds(F.col("_new")), ",")
                )
            ).alias("anomaly_id"),
            now.alias("detected_at"), F.col("_start").alias("window_start"), F.col("_end").alias("window_end"),
            "service", F.col("_new").alias("triggers"),
        )
    ).withColumn("action", F.lit("created")).withColumn("added_kinds", kinds(F.col("triggers")))
    columns = [f.name for f in ANOMALY] + ["action", "added_kinds"]
    return extended.select(*columns).unionByName(created.select(*columns))
