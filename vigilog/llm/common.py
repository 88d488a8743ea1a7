"""Helpers shared by the corpus operators: tables, staging, Arrow columns, word and byte arrays."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.sources.staging import shared_folder

#: Bytes of text handled at once inside a task; a longer text is handled alone, whole.
CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that lost executors repeat little."""
    path = f"{shared_folder(frame.sparkSession)}/llm-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)  # written once, read a few times
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def remainder(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text modulo ``parts``; 0 for a null key."""
    column = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(column.cast("string")), F.lit(0)) % parts


def without(frame: DataFrame, names: list[str]) -> DataFrame:
    """The frame without columns of these names, however they are spelled."""
    drop = {name.lower() for name in names}
    return frame.select(*[f"`{c}`" for c in frame.columns if c.lower() not in drop])


def unused(frame: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the frame bears it."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name += "_"
    return name


def pack(frame: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, and all others in one column ``row``, so that no name can clash."""
    others = [f"`{c}`" for c in frame.columns if c not in keep]
    first = F.lit(0).alias(unused(frame, "none"))
    return frame.select(*keep, F.struct(first, *others).alias("row"))


def unpack(frame: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """The columns ``names`` of what was packed."""
    return frame.select(
        *[F.col(f"`{c}`") if c in keep else F.col("row").getField(c).alias(c) for c in names]
    )


def with_arrow_columns(
    frame: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    compute: Callable[..., list[pa.Array]],
    start: Callable[[], object] | None = None,
) -> DataFrame:
    """Append columns that ``compute`` makes from the input columns of each Arrow batch.

    Columns of the frame that bear the name of a new one are replaced. ``start`` runs once per
    task; what it returns is passed to ``compute`` first.
    """
    kept = without(frame, [field.name for field in fields])
    places = [kept.columns.index(name) for name in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start() if start else None
        for batch in batches:
            made = compute(state, *[batch.column(i) for i in places])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *made],
                names=[*batch.schema.names, *[field.name for field in fields]],
            )

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``limit`` bytes, or one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _power_tables(size: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < size:
        size = max(size, CHUNK_BYTES + 2)
        inverse = pow(int(_MULTIPLIER), -1, 1 << 64)
        for base in (int(_MULTIPLIER), inverse):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
        _powers[:] = _powers[-2:]
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span of bytes; equal bytes have equal hashes."""
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    mixed = (sums[ends] - sums[starts]) * inverses[starts]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def word_spans(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.diff(is_word.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()
#: Space and the controls 0x09 to 0x0D.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
