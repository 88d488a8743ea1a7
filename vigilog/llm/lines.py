"""Dropping lines that documents share, by a sharded minimal perfect hash.

1. Each line becomes 128 bits of hash of its key, with its document and place. Keys that lie in
   more than one document are found by an aggregate (first and last document, number of lines).
2. These keys are dealt to shards by hash. A shard is one row of flat arrays: the bits of a minimal
   perfect hash (levels of bits; a key that is alone at its place of a level takes it, the others
   go on to the next), and at the key's rank its fingerprint, first document and number of lines.
   No line is joined with another, and no text is in the index.
3. Lines travel as hashes to the shards and probe the arrays. A shard that many lines probe, for
   instance as one line fills a third of the documents, is copied for slices of its lines, so that
   a task reads one bounded array and streams a bounded share of the lines.
4. The places found come back to the documents, which drop their lines.

Two different keys are taken for one only if all 128 bits agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm import common

LEAST_CHARS = 10
#: Keys of a shard, and lines of a slice.
SHARD_KEYS = 1 << 17
SLICE_LINES = 1 << 17
#: Bits of a level for each key that is left.
BITS_PER_KEY = 2
#: Stands for a missing document key: such rows are one document, after all others.
_LAST_DOCUMENT = (1 << 63) - 1


def _document(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(_LAST_DOCUMENT))


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def line_hashes(data: np.ndarray, offsets: np.ndarray, least_chars: int) -> tuple[np.ndarray, ...]:
    """Row, place, and two hashes of the key of each line whose key is long enough.

    ``data`` are the texts' UTF-8 bytes. A key is the line without blanks at its ends and with A-Z in
    lower case.
    """
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((breaks, offsets[1:])))
    counts = 1 + np.diff(np.searchsorted(breaks, offsets))
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    shown = np.flatnonzero(~common.BLANK[data])
    first, past = np.searchsorted(shown, starts), np.searchsorted(shown, ends)
    some = np.flatnonzero(past > first)
    starts, ends = shown[first[some]], shown[past[some] - 1] + 1
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    long = points[ends] - points[starts] >= least_chars
    row, place = row[some[long]], place[some[long]]
    raw, digest = memoryview(common.LOWER[data].tobytes()), xxhash.xxh3_128_digest
    spans = zip(starts[long].tolist(), ends[long].tolist(), strict=True)
    hashes = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in spans]), np.int64).reshape(-1, 2)
    return row, place, hashes[:, 0], hashes[:, 1]


def hashed_lines(docs: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """A row for each line whose key is long enough: doc, unit, place, h1, h2.

    ``unit`` tells texts of one document key apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, unit = batch.column("doc").to_numpy(), batch.column("unit").to_numpy()
            data, offsets = common.as_bytes(batch.column("text"))
            for first, last in common.chunks(offsets):
                part = offsets[first : last + 1]
                row, place, h1, h2 = line_hashes(data[part[0] : part[-1]], part - part[0], least_chars)
                row = row + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[row]), pa.array(unit[row]), pa.array(place.astype(np.int32)), pa.array(h1), pa.array(h2)],
                    names=["doc", "unit", "place", "h1", "h2"],
                )

    texts = docs.select(_document(key).alias("doc"), F.xxhash64(_text(text)).alias("unit"), _text(text).alias("text"))
    return texts.mapInArrow(run, "doc bigint, unit bigint, place int, h1 bigint, h2 bigint")


def shared_keys(lines: DataFrame) -> DataFrame:
    """Keys in at least two documents: h1, h2, first document, number of lines."""
    spans = lines.groupBy("h1", "h2").agg(
        F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")
    )
    return spans.where("first <> last").drop("last")


def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """64 bits of the key for a level."""
    out = h2 + np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 64) - 1))
    for multiplier, more in ((0xFF51AFD7ED558CCD, h1), (0xC4CEB9FE1A85EC53, np.uint64(level))):
        out = (out ^ (out >> np.uint64(33))) * np.uint64(multiplier)
        out = out ^ more
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


@dataclass(frozen=True)
class PerfectHash:
    """Levels of bits (sizes in bits, multiples of 64) and the number of set bits before each word."""

    sizes: np.ndarray
    words: np.ndarray
    before: np.ndarray

    @classmethod
    def from_words(cls, sizes: np.ndarray, words: np.ndarray) -> PerfectHash:
        counts = np.bitwise_count(words).astype(np.int64)
        return cls(sizes, words, np.cumsum(counts) - counts)

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        """For distinct keys (h1, h2)."""
        sizes, words = [], []
        while len(h1):
            size = -(-len(h1) * BITS_PER_KEY // 64) * 64
            at = (_mix(h1, h2, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = ~alone[at]
            h1, h2 = h1[left], h2[left]
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        return cls.from_words(np.array(sizes, np.int64), flat)

    def ranks(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Rank of each key, from 0; of what is no key any rank, or -1."""
        out = np.full(len(h1), -1, np.int64)
        open_ = np.arange(len(h1))
        first = 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _mix(h1[open_], h2[open_], level) % np.uint64(size)
            word = first + (at >> np.uint64(6)).astype(np.int64)
            bit = np.uint64(1) << (at & np.uint64(63))
            taken = (self.words[word] & bit) != 0
            below = np.bitwise_count(self.words[word] & (bit - np.uint64(1)))
            out[open_[taken]] = (self.before[word] + below)[taken]
            open_ = open_[~taken]
            first += size // 64
        return out


def _compact(values: np.ndarray) -> np.ndarray:
    """In the smallest unsigned type that holds them."""
    most = int(values.max(initial=0))
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


_ARRAYS = "sizes binary, words binary, fingerprints binary, firsts binary, counts binary"


def _index_shard(key: tuple, rows: pa.Table) -> pa.Table:
    h1, h2 = (rows[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    hashed = PerfectHash.of(h1, h2)
    place = hashed.ranks(h1, h2)
    arrays = {"fingerprints": h2, "firsts": rows["first"].to_numpy(), "counts": _compact(rows["n"].to_numpy())}
    columns = {"sizes": hashed.sizes, "words": hashed.words}
    for name, values in arrays.items():
        columns[name] = np.empty_like(values)
        columns[name][place] = values
    made = {name: pa.array([values.tobytes()], pa.binary()) for name, values in columns.items()}
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), **made})


def build_index(keys: DataFrame, shards: int) -> DataFrame:
    """One row of flat arrays for each shard of the shared keys."""
    dealt = keys.withColumn("shard", _shard(shards))
    return dealt.groupBy("shard").applyInArrow(_index_shard, f"shard int, {_ARRAYS}")


def _shard(shards: int) -> Column:
    return F.pmod("h1", F.lit(shards)).cast("int")


class _Shard:
    def __init__(self, row: dict[str, bytes]) -> None:
        self.hash = PerfectHash.from_words(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["words"], np.uint64))
        self.fingerprints = np.frombuffer(row["fingerprints"], np.uint64)
        self.firsts = np.frombuffer(row["firsts"], np.int64)
        self.counts = np.frombuffer(row["counts"], f"u{len(row['counts']) // max(len(self.firsts), 1) or 1}")

    def drops(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a line's key is known, found more than once, and first in another document."""
        rank = self.hash.ranks(h1, h2)
        known = np.flatnonzero(rank >= 0)
        rank = rank[known]
        same = (self.fingerprints[rank] == h2[known]) & (self.counts[rank] > 1) & (self.firsts[rank] != doc[known])
        out = np.zeros(len(h1), bool)
        out[known[same]] = True
        return out


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard and slice, the arrays of each before its lines."""
    shard, number, slice_ = None, -1, -1
    for batch in batches:
        is_index = batch.column("place").is_null().to_numpy(zero_copy_only=False)
        shards, slices = (batch.column(c).to_numpy() for c in ("shard", "slice"))
        cuts = np.flatnonzero(is_index | np.r_[True, (np.diff(shards) != 0) | (np.diff(slices) != 0)])
        found = []
        for first, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(is_index)], strict=True):
            if is_index[first]:
                shard = _Shard({c: batch.column(c)[first].as_py() for c in ("sizes", "words", "fingerprints", "firsts", "counts")})
                number, slice_ = shards[first], slices[first]
                first += 1
            if first < end and (shards[first], slices[first]) == (number, slice_):
                h1, h2, doc = (batch.column(c).slice(first, end - first).to_numpy() for c in ("h1", "h2", "doc"))
                found.append(first + np.flatnonzero(shard.drops(h1.view(np.uint64), h2.view(np.uint64), doc)))
        if found:
            rows = pa.array(np.concatenate(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(rows) for c in ("doc", "unit", "place")], names=["doc", "unit", "place"]
            )


def probe(lines: DataFrame, index: DataFrame, shards: int, slice_lines: int = SLICE_LINES) -> DataFrame:
    """doc, unit and place of the lines to drop."""
    dealt = lines.withColumn("shard", _shard(shards))
    # One row for each shard, written so that the planner knows how small it is.
    counts = dealt.groupBy("shard").agg(F.ceil(F.count("*") / slice_lines).cast("int").alias("slices"))
    counts = common.stage(counts)
    copies = index.join(counts, "shard").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    sliced = dealt.join(counts, "shard").withColumn("slice", F.pmod(F.xxhash64("doc", "unit", "place"), "slices").cast("int"))
    both = copies.drop("slices").unionByName(sliced.drop("slices"), allowMissingColumns=True)
    ordered = both.repartition("shard", "slice").sortWithinPartitions("shard", "slice", F.asc_nulls_first("place"))
    return ordered.mapInArrow(_probe, "doc bigint, unit bigint, place int")


_COUNTS = [T.StructField("n_lines", T.LongType(), False), T.StructField("n_dropped", T.LongType(), False)]


def _without_lines(_: object, texts: pa.Array, places: pa.Array) -> list[pa.Array]:
    kept, n_lines, n_dropped = [], [], []
    for text, drop in zip(texts, places, strict=True):
        text = text.as_py()
        n_lines.append(text.count("\n") + 1)
        gone = np.array(drop.values.to_numpy()) if drop.is_valid else np.zeros(0, np.int32)
        n_dropped.append(len(gone))
        if len(gone):
            stays = np.ones(n_lines[-1], bool)
            stays[gone] = False
            parts = text.split("\n")
            text = "\n".join([parts[i] for i in np.flatnonzero(stays).tolist()])
        kept.append(text)
    return [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]


def drop_shared_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_chars: int = LEAST_CHARS,
    shard_keys: int = SHARD_KEYS,
    slice_lines: int = SLICE_LINES,
) -> DataFrame:
    """All columns, with the text less its shared lines, and ``n_lines`` and ``n_dropped``.

    A line goes if its key has ``least_chars`` code points or more and also lies in a document with
    a smaller key. Lines that repeat in their first document alone stay. Rows with equal keys are one
    document; rows without a key are one, after all others. A null text counts as empty and becomes
    so; a text whose lines all go is empty. Columns named as the new ones are replaced.
    """
    found = common.stage(hashed_lines(docs, key, text, least_chars))
    keys = common.stage(shared_keys(found))
    shards = max(1, -(-keys.count() // shard_keys))
    index = common.stage(build_index(keys, shards))
    dropped = probe(found, index, shards, slice_lines)
    # Places of one text: no more than it has lines, however often the row is repeated.
    places = common.stage(dropped.groupBy("doc", "unit").agg(F.collect_set("place").alias("places")))
    whole = common.without(docs, [f.name for f in _COUNTS])
    packed = common.pack(whole, text).withColumn(text, _text(text))
    document = F.coalesce(F.col("row").getField(key).cast("long"), F.lit(_LAST_DOCUMENT))
    joined = packed.withColumns({"doc": document, "unit": F.xxhash64(text)}).join(places, ["doc", "unit"], "left")
    # Named apart from the input's own column, which is replaced.
    fields = [T.StructField("kept", T.StringType(), False), *_COUNTS]
    cleaned = common.with_arrow_columns(joined.select("row", text, "places"), [text, "places"], fields, _without_lines)
    names = [F.col("kept").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in whole.columns]
    return cleaned.select(*names, *[f.name for f in _COUNTS])
