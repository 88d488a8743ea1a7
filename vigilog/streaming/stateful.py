"""Incidents and silence as keyed state with timers, one service a key.

The variant of :mod:`vigilog.streaming.watch` for continuous streams: firings, lines and verdicts of
a service meet in its state, which holds its newest incident, when it was last seen and how many
lines it sent in each second of the last hour. A processing-time timer raises ``service_silent``
when no line came in time; no new input is needed for it. State lives in the checkpoint, so a
restarted stream extends the incident it had.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilog import fixed_values as V
from vigilog import schemas
from vigilog.config import DetectionConfig

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: A signal: lines of one moment, a firing (with window and triggers) or a verdict (with status).
SIGNALS = (
    "service string, at bigint, window_start bigint, window_end bigint, triggers string, anomaly_id string, status string"
)
#: Changes of incidents; times are microseconds, triggers a JSON array in the order of their kinds.
CHANGES = (
    "service string, anomaly_id string, detected_at bigint, window_start bigint, window_end bigint, "
    "triggers string, status string, action string, added_kinds string"
)
_MINUTE = 60_000_000


def line_signals(lines: DataFrame) -> DataFrame:
    return _signals(lines, at=F.unix_micros("timestamp"))


def firing_signals(firings: DataFrame) -> DataFrame:
    return _signals(
        firings, at=F.unix_micros("window_end"), window_start=F.unix_micros("window_start"),
        window_end=F.unix_micros("window_end"), triggers=F.to_json("triggers"),
    )


def verdict_signals(verdicts: DataFrame) -> DataFrame:
    """From rows with service, anomaly_id, status and the time ``decided_at``."""
    return _signals(verdicts, at=F.unix_micros("decided_at"), anomaly_id=F.col("anomaly_id"), status=F.col("status"))


def _signals(rows: DataFrame, **given) -> DataFrame:
    columns = [part.split() for part in SIGNALS.split(", ")]
    return rows.select(
        *[F.col(n) if n == "service" else given.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in columns]
    )


class IncidentState(StatefulProcessor):
    """Folds the signals of one service; ``tick_seconds`` is how often silence is looked at again."""

    def __init__(self, config: DetectionConfig, tick_seconds: float) -> None:
        self.config, self.tick = config, tick_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.incident = handle.getValueState("incident", "anomaly_id string, start bigint, end bigint, triggers string, status string")
        self.last = handle.getValueState("last", "at bigint")
        self.counts = handle.getMapState("counts", "second bigint", "n bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        service, changes = key[0], []
        signals = pd.concat(list(rows)).sort_values(["at", "window_start"], kind="stable")
        plain = signals["triggers"].isna() & signals["status"].isna()
        for signal in signals[~plain].to_dict("records"):
            if signal["status"] is not None and not pd.isna(signal["status"]):
                self._judge(signal["anomaly_id"], signal["status"])
            else:
                fired = json.loads(signal["triggers"])
                changes.append(self._fold(service, int(signal["window_start"]), int(signal["window_end"]), fired, int(signal["at"])))
        if plain.any():
            self._count(signals.loc[plain, "at"], timerValues)
        yield self._frame(changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Look whether the service is silent, as the batch detector does at this moment."""
        service, now = key[0], timerValues.getCurrentProcessingTimeInMs() * 1000
        config, (last,) = self.config, self.last.get()
        minutes = (now - last) / _MINUTE
        since = (last - config.silence_baseline_minutes * _MINUTE) // 1_000_000
        total = sum(n for (second,), (n,) in self.counts.iterator() if second >= since)
        rate = total / config.silence_baseline_minutes
        changes = []
        if minutes <= config.silence_lookback_minutes:
            if minutes >= config.silence_min_minutes and rate >= config.silence_min_lines_per_minute:
                trigger = {
                    "kind": V.SERVICE_SILENT, "service": service, "silent_minutes": int(minutes), "lines_per_minute": rate,
                    "last_seen_at": pd.Timestamp(last, unit="us", tz="UTC").isoformat(),
                }
                start, end = last - last % _MINUTE, now - now % _MINUTE
                changes.append(self._fold(service, start, max(end, start), [trigger], now))
            self._arm(timerValues, self.tick)
        yield self._frame(changes)

    def _arm(self, timerValues, seconds: float) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(1, int(seconds * 1000)))

    def _count(self, at: pd.Series, timerValues) -> None:
        """Add lines by whole seconds, forget what is over an hour before the last one."""
        last = int(at.max())
        if self.last.exists():
            last = max(last, self.last.get()[0])
        self.last.update((last,))
        since = (last - self.config.silence_baseline_minutes * _MINUTE) // 1_000_000
        for second, n in (at // 1_000_000).astype("int64").value_counts().items():
            if second >= since:
                had = self.counts.getValue((int(second),))
                self.counts.updateValue((int(second),), (int(n) + (had[0] if had else 0),))
        for (second,) in [k for k in self.counts.keys() if k[0] < since]:
            self.counts.removeKey((second,))
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        self._arm(timerValues, self.config.silence_min_minutes * 60 - (now - last) / 1e6)

    def _judge(self, anomaly_id: str, status: str) -> None:
        if self.incident.exists():
            held = self.incident.get()
            if held[0] == anomaly_id:
                self.incident.update((*held[:4], status))

    def _fold(self, service: str, start: int, end: int, fired: list[dict], now: int) -> dict:
        """Extend the newest incident, or begin one; the rules of ``operators.incidents.persist_run``."""
        held = self.incident.get() if self.incident.exists() else None
        kinds = [t["kind"] for t in fired]
        if held is not None and held[4] in V.MERGEABLE_STATUSES and held[2] >= start - self.config.merge_gap_minutes * _MINUTE:
            before = json.loads(held[3])
            fresh = [k for k in kinds if k not in {t["kind"] for t in before}]
            if held[4] != "dismissed" or not fresh:
                newest = {t["kind"]: t for t in fired}
                merged = [newest.get(t["kind"], t) for t in before] + [t for t in fired if t["kind"] in fresh]
                return self._store(service, held[0], held[1], max(held[2], end), merged, held[4], "extended", fresh, now)
        name = "|".join((service, str(start // 1_000_000), ",".join(kinds)))
        return self._store(service, hashlib.md5(name.encode()).hexdigest(), start, end, fired, "open", "created", kinds, now)

    def _store(self, service, anomaly_id, start, end, triggers, status, action, added, now) -> dict:
        text = json.dumps(triggers)
        self.incident.update((anomaly_id, start, end, text, status))
        return {
            "service": service, "anomaly_id": anomaly_id, "detected_at": now, "window_start": start, "window_end": end,
            "triggers": text, "status": status, "action": action, "added_kinds": ",".join(added),
        }

    @staticmethod
    def _frame(changes: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(changes, columns=[part.split()[0] for part in CHANGES.split(", ")])


def incident_changes(signals: DataFrame, config: DetectionConfig = DetectionConfig(), tick_seconds: float = 60) -> DataFrame:
    """Created and extended incidents of a stream of signals, silence included.

    Of a service the newest incident is remembered; lines are counted by whole seconds.
    """
    signals.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    changed = signals.groupBy("service").transformWithStateInPandas(
        statefulProcessor=IncidentState(config, tick_seconds), outputStructType=CHANGES,
        outputMode="Update", timeMode="ProcessingTime",
    )
    trigger = next(f for f in schemas.ANOMALY if f.name == "triggers").dataType
    moments = {c: F.timestamp_micros(c) for c in ("detected_at", "window_start", "window_end")}
    return changed.withColumns(
        {**moments, "triggers": F.from_json("triggers", trigger), "added_kinds": F.split(F.nullif("added_kinds", F.lit("")), ",")}
    )
