"""Time functions. All renderings are UTC."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_of(moment: Column) -> Column:
    return F.unix_seconds(moment)


def from_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def floor_to_bucket(moment: Column, bucket_seconds: int = 60) -> Column:
    """Start of the epoch-aligned bucket a moment falls in."""
    micros = F.unix_micros(moment)
    width = bucket_seconds * 1_000_000
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(width)))


def shift(moment: Column, seconds: Column | int) -> Column:
    """Move a moment by a number of seconds."""
    step = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(F.unix_micros(moment) + step.cast("long") * 1_000_000)


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes from start to end, rounded half up."""
    millis = F.unix_millis(end) - F.unix_millis(start)
    return F.floor((millis + 30_000) / F.lit(60_000.0))


def window_minutes(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), minutes_between(start, end))


def utc_day_start(moment: Column) -> Column:
    return F.date_trunc("day", moment)


def iso_millis(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm'Z'")


def clock(moment: Column) -> Column:
    return F.date_format(moment, "HH:mm:ss")


def format_window(start: Column, end: Column) -> Column:
    return F.concat(stamp(start), F.lit(" · "), window_minutes(start, end).cast("string"), F.lit(" min"))


def format_age(then: Column, now: Column) -> Column:
    """How long ago in the largest whole unit of minutes, hours or days."""
    minutes = minutes_between(then, now)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )


def describe_age(committed_at: Column, window_end: Column) -> Column:
    """Age of a commit when a window ended, as days, hours and (below a day) minutes."""
    minutes = minutes_between(committed_at, window_end)
    days = F.floor(minutes / 1440)
    hours = F.floor((minutes % 1440) / 60)
    rest = minutes % 60
    parts = F.concat_ws(
        " ",
        F.when(days > 0, F.concat(days.cast("string"), F.lit("d"))),
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))),
        F.when((rest > 0) & (days == 0), F.concat(rest.cast("string"), F.lit("m"))),
    )
    return (
        F.when(minutes < 0, "after the window ended")
        .when(minutes == 0, "as the window ended")
        .otherwise(F.concat(parts, F.lit(" before")))
    )


def chart_range(
    start: Column, end: Column, before: int = 45, after: int = 10, longest: int = 120, bucket_seconds: int = 60
) -> tuple[Column, Column]:
    """Bucket-aligned range around a window, counted in buckets.

    If it is longer than allowed it keeps its end and gives up its beginning.
    """
    to = shift(floor_to_bucket(end, bucket_seconds), after * bucket_seconds)
    wanted = shift(floor_to_bucket(start, bucket_seconds), -before * bucket_seconds)
    return F.greatest(wanted, shift(to, -longest * bucket_seconds)), to


def instant(moment: datetime) -> Column:
    """A point in time as a literal; a datetime without zone is UTC, wherever the driver runs."""
    known = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(round((known - _EPOCH) / timedelta(microseconds=1))))


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
