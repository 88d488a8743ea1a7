"""Expressions over trigger structs and arrays of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilog import fixed_values as V
from vigilog.functions.numbers import fixed_text, plain_text, round_half_up
from vigilog.functions.text import truncate
from vigilog.functions.times import iso_millis, stamp
from vigilog.schemas import TRIGGER


def make_trigger(kind: str, service: Column, **fields: Column) -> Column:
    """A trigger struct of one kind; fields of other kinds are NULL."""
    given = {"kind": F.lit(kind), "service": service, **fields}
    return F.struct(*[
        given.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name) for field in TRIGGER
    ])


def kinds(triggers: Column) -> Column:
    return F.transform(triggers, lambda t: t["kind"])


def has_trigger(triggers: Column, kind: str) -> Column:
    return F.exists(triggers, lambda t: t["kind"] == kind)


def has_readable_trigger(triggers: Column) -> Column:
    """Any trigger that leaves log lines to read, that is any but silence."""
    return F.exists(triggers, lambda t: t["kind"] != V.SERVICE_SILENT)


def merge_triggers(existing: Column, incoming: Column) -> Column:
    """Union by kind: an incoming trigger replaces one of its kind in place, new kinds go last."""
    replaced = F.transform(
        existing,
        lambda old: F.coalesce(
            F.try_element_at(F.filter(incoming, lambda new: new["kind"] == old["kind"]), F.lit(-1)), old
        ),
    )
    added = F.filter(incoming, lambda new: ~F.exists(existing, lambda old: old["kind"] == new["kind"]))
    return F.concat(replaced, added)


def added_kinds(existing: Column, incoming: Column) -> Column:
    """Kinds of the incoming triggers that the anomaly did not have yet."""
    return F.filter(kinds(incoming), lambda kind: ~F.exists(existing, lambda old: old["kind"] == kind))


def _rate_text(t: Column) -> Column:
    return F.concat(
        t["observed_errors"].cast("string"),
        F.lit(" errors {in}against a baseline of "), plain_text(t["baseline_mean"], 2),
        F.lit("/min (sd "), plain_text(t["baseline_sd"], 2), F.lit(", z="), plain_text(t["z_score"], 2), F.lit(")"),
    )


def _latency_text(t: Column) -> Column:
    return F.concat(
        t["metric"], F.lit(" "), round_half_up(t["observed_ms"]).cast("string"),
        F.lit("ms against a baseline of "), round_half_up(t["baseline_ms"]).cast("string"),
        F.lit("ms ("), plain_text(t["ratio"], 2), F.lit("x)"),
    )


def describe_trigger(t: Column) -> Column:
    """One sentence about a trigger, as evidence packets and alerts show it."""
    kind = t["kind"]
    return (
        F.when(
            kind == V.ERROR_RATE_SPIKE,
            F.concat(F.lit("error_rate_spike: "), F.replace(_rate_text(t), F.lit("{in}"), F.lit("in the window "))),
        )
        .when(kind == V.LATENCY_JUMP, F.concat(F.lit("latency_jump: "), _latency_text(t)))
        .when(
            kind == V.NEW_ERROR_SIGNATURE,
            F.concat(
                F.lit('new_error_signature: "'), t["signature"], F.lit('" occurred '),
                t["occurrences"].cast("string"), F.lit(" times and appears nowhere in the baseline hour"),
            ),
        )
        .when(
            kind == V.SERVICE_SILENT,
            F.concat(
                F.lit("service_silent: no log lines for "), t["silent_minutes"].cast("string"),
                F.lit(" minutes since "), iso_millis(t["last_seen_at"]),
                F.lit(", against a normal rate of "), plain_text(t["lines_per_minute"], 1),
                F.lit(" log lines/min"),
            ),
        )
    )


def describe_trigger_short(t: Column) -> Column:
    """One sentence about a trigger, as the dashboard shows it."""
    kind = t["kind"]
    return (
        F.when(kind == V.ERROR_RATE_SPIKE, F.replace(_rate_text(t), F.lit("{in}"), F.lit("")))
        .when(kind == V.LATENCY_JUMP, _latency_text(t))
        .when(
            kind == V.NEW_ERROR_SIGNATURE,
            F.concat(
                F.lit('"'), t["signature"], F.lit('" ×'), t["occurrences"].cast("string"),
                F.lit(", absent from the baseline hour"),
            ),
        )
        .when(
            kind == V.SERVICE_SILENT,
            F.concat(
                F.lit("silent for "), t["silent_minutes"].cast("string"), F.lit(" min since "),
                stamp(t["last_seen_at"]), F.lit("; normally "), plain_text(t["lines_per_minute"], 1),
                F.lit(" lines/min"),
            ),
        )
    )


def describe_with_example(t: Column, limit: int) -> Column:
    """A trigger line, followed by the raw message behind a new signature."""
    line = F.concat(F.lit("- "), describe_trigger(t))
    example = F.concat(line, F.lit("\n    raw example: "), truncate(t["sample_message"], limit))
    return F.when(t["kind"] == V.NEW_ERROR_SIGNATURE, example).otherwise(line)


def confidence_text(value: Column) -> Column:
    return fixed_text(value, 2)


def severity_rank(severity: Column) -> Column:
    """0 for the mildest; NULL for an unknown severity."""
    ranks = [F.when(severity == name, F.lit(rank)) for rank, name in enumerate(V.SEVERITIES)]
    return F.coalesce(*ranks)


def severity_distance(a: Column, b: Column) -> Column:
    return F.abs(severity_rank(a) - severity_rank(b))


def severity_class(severity: Column, is_real: Column) -> Column:
    """Display class: dismissed beats the severity, no severity is unclassified."""
    return F.when(is_real == F.lit(False), "dismissed").otherwise(F.coalesce(severity, F.lit("unclassified")))


def trigger_score(triggers: Column) -> Column:
    """Sum of fixed weights over the triggers of a known kind."""
    weight = lambda t: F.coalesce(
        *[F.when(t["kind"] == kind, F.lit(points)) for kind, points in V.TRIGGER_WEIGHTS.items()], F.lit(0)
    )
    return F.aggregate(triggers, F.lit(0), lambda total, t: total + weight(t))


def severity_for_score(score: Column) -> Column:
    return F.when(score >= 4, "critical").when(score >= 3, "high").when(score >= 2, "medium").otherwise("low")
