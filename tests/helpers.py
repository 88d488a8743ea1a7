"""Small hand-made frames."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from vigilog import schemas

T0 = datetime(2026, 11, 2, 10, 0, tzinfo=timezone.utc)


def at(minutes: float = 0, seconds: float = 0) -> datetime:
    return T0 + timedelta(minutes=minutes, seconds=seconds)


def values(spark, expression, rows, schema="s string"):
    """Evaluate one column expression over literal rows."""
    frame = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [row[0] for row in frame.select(expression).collect()]


def lines(spark, rows):
    """rows: (minutes, service, level, message, latency); the position is the ingest order."""
    data = [
        (i, at(r[0]), r[1], r[2], r[3], None, r[5] if len(r) > 5 else "/x", 200, float(r[4]))
        for i, r in enumerate(rows)
    ]
    from vigilog.functions.text import signature_for

    frame = spark.createDataFrame(data, schemas.LINES)
    return frame.withColumn("error_signature", signature_for(F.col("level"), F.col("message")))


def rollup_rows(spark, rows):
    """rows: (minute, service, requests, errors, p95)."""
    data = [(at(m), s, "", r, e, p, p, p) for m, s, r, e, p in rows]
    return spark.createDataFrame(data, schemas.ROLLUP)


def millis(moment: datetime) -> int:
    return int(moment.timestamp() * 1000)
