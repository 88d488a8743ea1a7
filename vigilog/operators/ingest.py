"""Validation of posted log batches, row by row, with a reason for every rejection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog import fixed_values as V
from vigilog.functions import answers as A
from vigilog.functions import text
from vigilog.sources.staging import staged

REASON_TIMESTAMP_INVALID = "timestamp: neither an ISO-8601 date nor a number of milliseconds"
REASON_TIMESTAMP_OLD = (
    "timestamp: earlier than the year 2000 (were seconds sent instead of milliseconds?)"
)
REASON_TIMESTAMP_FUTURE = (
    "timestamp: over 5 minutes ahead of the receiver (wrong clock or unit)"
)
REASON_SERVICE_PATTERN = (
    "service: only letters, digits, dot, dash and underscore, the first a letter or digit"
)
REASON_MESSAGE_BLANK = "message: has no visible character"
REASON_METADATA_SIZE = "metadata: over 16384 characters as JSON"

#: The ingest order counts from 2020, in so many steps a microsecond.
ORDER_EPOCH_MICROS = 1_577_836_800_000_000
ORDER_SLOTS = 16_384

_ENTRY = ["timestamp", "service", "level", "message", "metadata"]
_METADATA = ["requestId", "endpoint", "method", "statusCode", "latencyMs", "errorType", "stack"]

_TIMESTAMP, _SERVICE, _LEVEL, _MESSAGE, _META = (A.Field(name, "_e_") for name in _ENTRY)
_KNOWN = {name: A.Field(name, "_m_", "metadata.") for name in _METADATA}


def check_envelopes(batches: DataFrame) -> DataFrame:
    """Add ``entries`` (array of variant) and ``batch_error``, NULL for a usable envelope.

    The body must be an object with 1 to 1000 entries; the key, if any, must be well formed.
    """
    parsed = A.unpack(batches.withColumn("_body", F.try_parse_json("body")), "_body", ["entries"], "_")
    entries, key = A.Field("entries"), F.trim("idempotency_key")
    return (
        parsed.withColumn("_entries", entries.as_("array<variant>"))
        .withColumn(
            "batch_error",
            F.coalesce(
                F.when(key.isNotNull() & ~text.valid_idempotency_key(key), "invalid_idempotency_key"),
                F.when(~A.is_object(F.col("_body")), "Invalid input: expected object"),
                entries.wrong_type("array"),
                F.when(F.size("_entries") < 1, "entries: Too small: expected array to have >=1 items"),
                F.when(
                    F.size("_entries") > V.MAX_BATCH_ENTRIES,
                    f"entries: Too big: expected array to have <={V.MAX_BATCH_ENTRIES} items",
                ),
            ),
        )
        .withColumn("idempotency_key", key)
        .drop("_body", "_entries_type")
        .withColumnRenamed("_entries", "entries")
    )


def explode_entries(envelopes: DataFrame) -> DataFrame:
    """One row per entry of the usable batches, with its position."""
    keep = [c for c in envelopes.columns if c not in ("entries", "batch_error", "body")]
    return envelopes.where(F.col("batch_error").isNull()).select(
        *keep, F.posexplode("entries").alias("index", "entry")
    )


_ISO = (
    r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?"
    r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
)
# Beyond this many milliseconds no calendar date exists.
_LAST_MILLIS = 8.64e15


def _entry_time() -> Column:
    """Instant of an entry: ISO text (UTC if it has no offset) or epoch milliseconds."""
    raw, millis = _TIMESTAMP.as_("string"), _TIMESTAMP.as_("double")
    return F.when(
        _TIMESTAMP.is_a("number"),
        F.timestamp_millis(F.when(F.abs(millis) <= _LAST_MILLIS, millis).try_cast("long")),
    ).when(_TIMESTAMP.is_a("string") & raw.rlike(_ISO), F.try_to_timestamp(raw))


def _too_old() -> Column:
    """Before 2000. JSON null and booleans read as instants of 1970."""
    epoch = _TIMESTAMP.is_a("null") | _TIMESTAMP.is_a("boolean")
    old = F.col("timestamp") < F.timestamp_seconds(F.lit(946_684_800))
    return F.coalesce(epoch, F.lit(False)) | F.coalesce(old, F.lit(False))


def _metadata_issue() -> Column:
    def optional(name: str, issue: Column) -> Column:
        return F.when(~_KNOWN[name].is_a("undefined"), issue)

    longest = {"requestId": 128, "endpoint": 256, "method": 16, "errorType": 128, "stack": 8192}
    numbers = {
        "statusCode": A.number_issue(_KNOWN["statusCode"], 100, 599, whole=True),
        "latencyMs": A.number_issue(_KNOWN["latencyMs"], 0, 600_000),
    }
    issues = [
        optional(name, numbers[name] if name in numbers else A.string_issue(_KNOWN[name], 0, longest[name]))
        for name in _METADATA
    ]
    size = F.length(F.to_json(_META.value))
    return F.when(
        ~_META.is_a("undefined"),
        F.coalesce(
            _META.wrong_type("object"), *issues, F.when(size > V.MAX_METADATA_CHARS, REASON_METADATA_SIZE)
        ),
    )


def validate_entries(entries: DataFrame, now: Column) -> DataFrame:
    """Add ``timestamp``, the unpacked fields, and ``reason``: the first issue, NULL if accepted."""
    unpacked = A.unpack(entries, "entry", _ENTRY, "_e_")
    unpacked = A.unpack(unpacked, "_e_metadata", _METADATA, "_m_").withColumn("timestamp", _entry_time())
    service, message = _SERVICE.as_("string"), _MESSAGE.as_("string")
    bad_name = ~service.rlike(V.SERVICE_NAME) | F.contains(service, F.lit("\n"))
    reason = F.coalesce(
        F.when(~A.is_object(F.col("entry")), "Invalid input: expected object"),
        F.when(_too_old(), REASON_TIMESTAMP_OLD),
        F.when(F.col("timestamp").isNull(), REASON_TIMESTAMP_INVALID),
        A.string_issue(_SERVICE, 1, 64),
        F.when(bad_name, REASON_SERVICE_PATTERN),
        A.enum_issue(_LEVEL, V.LEVELS),
        A.string_issue(_MESSAGE, 1, 4096),
        _metadata_issue(),
        reject_future(F.col("timestamp"), now),
        reject_blank(message),
    )
    return unpacked.withColumn("reason", reason)


def reject_future(timestamp: Column, now: Column) -> Column:
    late = F.unix_micros(timestamp) > F.unix_micros(now) + V.MAX_FUTURE_MINUTES * 60_000_000
    return F.when(late, REASON_TIMESTAMP_FUTURE)


def reject_blank(message: Column) -> Column:
    return F.when(text.is_blank(message), REASON_MESSAGE_BLANK)


def sanitize_metadata(metadata: Column) -> Column:
    """Typed metadata of an entry (a variant); only top-level strings are stripped of invisibles.

    Keys without a column of their own stay together as JSON in ``extra``.
    """

    def clean(name: str) -> Column:
        return text.strip_invisible(F.try_variant_get(metadata, f"$.{name}", "string")).alias(name)

    fields = F.try_variant_get(metadata, "$", "map<string,variant>")
    extra = F.map_filter(fields, lambda key, _: ~key.isin(_METADATA))
    cleaned = F.transform_values(
        extra,
        lambda _, value: F.when(
            F.schema_of_variant(value) == "STRING",
            text.strip_invisible(F.try_variant_get(value, "$", "string")).cast("variant"),
        ).otherwise(value),
    )
    return F.struct(
        clean("requestId"), clean("endpoint"), clean("method"),
        F.try_variant_get(metadata, "$.statusCode", "int").alias("statusCode"),
        F.try_variant_get(metadata, "$.latencyMs", "double").alias("latencyMs"),
        clean("errorType"), clean("stack"),
        F.when(F.size(extra) > 0, F.to_json(cleaned)).alias("extra"),
    )


def accepted_logs(validated: DataFrame) -> DataFrame:
    """Rows for the log table. Arrival time, batch and position give the ingest order.

    Lines that arrive in the same microsecond, of one batch or several, are numbered; there is
    room for 16384 of them, so the order is unique up to 2037, and more raise an error: a load of
    many lines needs arrival times of its own. A stream cannot number across its batches: there the
    hash of the batch's id chooses one of 16 ranges of the microsecond, so two batches tie only if
    they share the microsecond and the range.
    """
    if validated.isStreaming:
        own = F.pmod(F.xxhash64("batch_id"), F.lit(ORDER_SLOTS // 1024)) * 1024 + F.col("index")
    else:
        own = F.row_number().over(Window.partitionBy("received_at").orderBy("batch_id", "index")) - 1
        too_many = F.raise_error(F.concat(F.lit("over 16384 lines arrived at "), F.col("received_at").cast("string")))
        own = F.when(own < ORDER_SLOTS, own).otherwise(too_many.cast("int"))
    order = (F.unix_micros("received_at") - F.lit(ORDER_EPOCH_MICROS)) * F.lit(ORDER_SLOTS) + own
    rows = validated.where(F.col("reason").isNull()).select(
        order.cast("long").alias("ingest_seq"),
        "timestamp",
        _SERVICE.as_("string").alias("service"),
        _LEVEL.as_("string").alias("level"),
        text.strip_invisible(_MESSAGE.as_("string")).alias("message"),
        sanitize_metadata(_META.value).alias("metadata"),
    )
    return rows.select(
        "ingest_seq", "timestamp", "service", "level", "message",
        text.signature_for(F.col("level"), F.col("message")).alias("error_signature"),
        "metadata", F.to_date("timestamp").alias("dt"),
    )


def rejects(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reason").isNotNull()).select("batch_id", "index", "reason")


def ingest_report(validated: DataFrame) -> DataFrame:
    """Per batch: accepted, rejected, the first 20 reasons and the answer status.

    A batch holds at most 1000 entries, which bounds the group.
    """
    errors = F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("index", "reason")))
    rejected = F.count("reason")
    return validated.groupBy("batch_id").agg(
        (F.count(F.lit(1)) - rejected).alias("accepted"),
        rejected.alias("rejected"),
        F.slice(F.array_sort(errors), 1, V.MAX_REPORTED_ERRORS).alias("errors"),
        F.when(rejected > 0, 207).otherwise(202).alias("status"),
    )


def envelope_report(envelopes: DataFrame) -> DataFrame:
    """The batches that were refused as a whole."""
    return envelopes.where(F.col("batch_error").isNotNull()).select(
        "batch_id", F.lit(400).alias("status"), F.col("batch_error").alias("error")
    )


#: Arrivals of a key up to which they are chained as one array.
MOST_ARRIVALS = 1000
#: Length of a time block of a busier key, in lifetimes.
BLOCK_LIFETIMES = 32


def deduplicate_batches(batches: DataFrame, most_arrivals: int = MOST_ARRIVALS) -> DataFrame:
    """Keep the first delivery of an idempotency key within its lifetime; others pass.

    ``batches`` must have passed :func:`check_envelopes`: a refused batch is not remembered.
    A delivery counts as a replay if it follows a kept one by less than the lifetime, so the
    kept deliveries form a chain. Keys with few arrivals are chained as arrays of bounded size,
    busy ones in time blocks, see :func:`kept_in_blocks`.
    """
    usable = batches.where(F.col("batch_error").isNull())
    keyed = usable.where(F.col("idempotency_key").isNotNull())
    times = staged(
        keyed.select(F.col("idempotency_key").alias("key"), F.unix_micros("received_at").alias("at")).distinct()
    )
    busy = times.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most_arrivals).select("key")
    if busy.isEmpty():
        firsts = _kept_in_arrays(times)
    else:
        busy = staged(busy)
        few, many = times.join(busy, "key", "left_anti"), times.join(busy, "key", "left_semi")
        firsts = _kept_in_arrays(few).unionByName(kept_in_blocks(many))
    firsts = firsts.select(F.col("key").alias("idempotency_key"), F.timestamp_micros("at").alias("received_at"))
    kept = keyed.join(firsts, ["idempotency_key", "received_at"], "left_semi").dropDuplicates(
        ["idempotency_key", "received_at"]
    )
    return kept.select(*usable.columns).unionByName(usable.where(F.col("idempotency_key").isNull()))


_LIFETIME = V.IDEMPOTENCY_TTL_MINUTES * 60_000_000


def _kept_in_arrays(times: DataFrame) -> DataFrame:
    chain = F.aggregate(
        F.array_sort(F.collect_list("at")),
        F.array().cast("array<bigint>"),
        lambda kept, at: F.when(
            (F.size(kept) == 0) | (at - F.try_element_at(kept, F.lit(-1)) >= _LIFETIME), F.concat(kept, F.array(at))
        ).otherwise(kept),
    )
    return times.groupBy("key").agg(chain.alias("kept")).select("key", F.explode("kept").alias("at"))


def _next_kept(at: np.ndarray) -> np.ndarray:
    """For each of the sorted arrivals the place of the first one a lifetime later, or their number."""
    return np.searchsorted(at, at + _LIFETIME)


def _block_function(key: tuple, rows: pa.Table) -> pa.Table:
    """What a block does to the last kept time: where it may begin to keep, and what it keeps last.

    The last kept time lies before the block, so the first arrival it keeps is one of those within
    a lifetime of its start, or the one after them.
    """
    name, block = key
    at = np.sort(rows["at"].to_numpy())
    follow = _next_kept(at)
    last = np.where(follow < len(at), follow, np.arange(len(at)))
    while (last[last] != last).any():  # pointers double: as many steps as the block's lifetimes have bits
        last = last[last]
    start = block.as_py() * BLOCK_LIFETIMES * _LIFETIME
    entries = min(int(np.searchsorted(at, start + _LIFETIME)) + 1, len(at))
    lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (at[:entries], at[last[:entries]])]
    return pa.table([pa.array([name.as_py()]), pa.array([block.as_py()], pa.int64()), *lists], names=["key", "block", "entries", "exits"])


def _chain_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks by key and time: the first arrival that each keeps. Only the last kept time is held."""
    name, kept = None, None
    for batch in batches:
        rows = []
        for key, block, entries, exits in zip(*[batch.column(c) for c in ("key", "block", "entries", "exits")], strict=True):
            if key.as_py() != name:
                name, kept = key.as_py(), None
            entries = entries.values.to_numpy()
            place = 0 if kept is None else int(np.searchsorted(entries, kept + _LIFETIME))
            if place < len(entries):
                rows.append((name, block.as_py(), int(entries[place])))
                kept = int(exits.values[place].as_py())
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)],
            names=["key", "block", "first"],
        )


def _kept_of_block(key: tuple, rows: pa.Table) -> pa.Table:
    at = np.sort(rows["at"].to_numpy())
    follow = _next_kept(at)
    place, kept = int(np.searchsorted(at, rows["first"][0].as_py())), []
    while place < len(at):
        kept.append(int(at[place]))
        place = int(follow[place])
    return pa.table([pa.array([key[0].as_py()] * len(kept), pa.string()), pa.array(kept, pa.int64())], names=["key", "at"])


def kept_in_blocks(times: DataFrame) -> DataFrame:
    """The kept arrivals of distinct (key, at), by composing functions over time blocks.

    Each block of a key's arrivals becomes a function from the last kept time before it to its
    own last one. Blocks, not arrivals, are then chained in the order of time, and each block
    follows its own chain from the arrival found. No task holds more than a block of a key.
    """
    length = BLOCK_LIFETIMES * _LIFETIME
    dealt = times.withColumn("block", F.floor(F.col("at") / length))
    functions = dealt.groupBy("key", "block").applyInArrow(
        _block_function, "key string, block bigint, entries array<bigint>, exits array<bigint>"
    )
    firsts = (
        functions.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_chain_blocks, "key string, block bigint, first bigint")
    )
    return dealt.join(firsts, ["key", "block"]).groupBy("key", "block").applyInArrow(_kept_of_block, "key string, at bigint")
