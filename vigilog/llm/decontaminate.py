"""Benchmark decontamination by Wu-Manber multi-pattern search.

Test strings are windows of 13 consecutive words of a benchmark item (a shorter item is one
window), written as bytes with a blank around each word; a text is written the same way, so a
window occurs in the text where its bytes do. For a set of windows with at least m bytes, a shift
table over blocks of B bytes tells how far the search may jump, blocks that end some window's
first m bytes lead to the windows by a hash of that suffix and of the first block, and the bytes are
compared directly. Many places of a batch of texts are advanced at once with numpy, each by its own
jumps. Windows are places in one buffer of the items' bytes, and all tables are flat arrays.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm import common

WORDS = 13
#: Benchmark text searched for by one pass of a task. More text makes more passes, each bounded.
PASS_BYTES = 8 << 20
#: Slots of a shift table: four for each byte of the windows, within these powers of two.
_TABLE_BITS = (16, 24)
#: Windows are searched in groups by length in bytes, so that a short one shortens no other's jumps.
_LENGTHS = (1, 8, 16, 32)
_LANE = 512

_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_WORD_BYTES = np.where(_IS_WORD[common.LOWER], common.LOWER, 32).astype(np.uint8)


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as their words, each with one blank on either side; and where each text starts.

    Neighbours share a blank, but every text has its own first and last.
    """
    mapped = np.empty(len(data) + len(offsets) - 1, np.uint8)
    own = np.ones(len(mapped), bool)
    ends = offsets[1:] + np.arange(len(offsets) - 1)
    own[ends] = False
    mapped[own] = _WORD_BYTES[data]
    mapped[ends] = 32
    keep = mapped != 32
    keep[1:] |= keep[:-1].copy()  # the first blank after a word
    first = np.concatenate(([0], ends + 1))[:-1]
    kept = np.concatenate(([0], np.cumsum(keep)))
    # Room for one more blank in front of each text.
    starts = kept[np.append(first, len(mapped))] + np.arange(len(offsets))
    out = np.full(int(starts[-1]), 32, np.uint8)
    place = np.ones(len(out), bool)
    place[starts[:-1]] = False
    out[place] = mapped[keep]
    return out, starts


def _windows(data: np.ndarray, starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, number of words and text of all windows of spaced texts, blanks around them included."""
    blanks = np.flatnonzero(data == 32)
    first = np.searchsorted(blanks, starts[:-1])
    n_words = np.searchsorted(blanks, starts[1:]) - first - 1
    many = np.where(n_words > 0, np.maximum(1, n_words - words + 1), 0)
    text = np.repeat(np.arange(len(many)), many)
    lead = np.repeat(first, many) + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    size = np.minimum(n_words, words)[text]
    return blanks[lead], blanks[lead + size] + 1, size, text


def _blocks(data: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes up to each place as one number; the first ``width - 1`` are partial."""
    values = np.zeros(len(data), np.uint64)
    for k in range(width):
        values[k:] |= data[: len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    return values


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _slots(blocks: np.ndarray, bits: int) -> np.ndarray:
    return (blocks * _ODD) >> np.uint64(64 - bits)


def _suffix_keys(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of the last and the first block of a window's head."""
    mixed = (last * _ODD) ^ (first * np.uint64(0xC2B2AE3D27D4EB4F))
    return mixed ^ (mixed >> np.uint64(29))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each range of the buffer, modulo 2^64."""
    base = 0xD6E8FEB86659FD93
    values = np.random.default_rng(8).integers(1, 1 << 63, 256, np.uint64)[data]

    def powers(b: int) -> np.ndarray:
        steps = np.full(len(data), b, np.uint64)
        steps[:1] = 1
        return np.cumprod(steps, dtype=np.uint64)

    values *= powers(base)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    found = sums[end] - sums[start]
    del values, sums
    return found * powers(pow(base, -1, 1 << 64))[start]


def _distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each window the number of the first one with the same bytes."""
    hashes = _hashes(data, start, end)
    _, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    same = first[code]
    raw = data.tobytes()
    for i in np.flatnonzero(same != np.arange(len(same))).tolist():
        j = same[i]
        if raw[start[i] : end[i]] != raw[start[j] : end[j]]:
            same[i] = i  # the hash alone was equal; the window stands for itself
    return same


@dataclass
class Group:
    """Windows of at least ``least`` bytes with their shift table and suffix buckets."""

    least: int
    width: int
    bits: int
    shift: np.ndarray
    suffixes: np.ndarray  # sorted keys of the first and last block of the first ``least`` bytes
    bounds: np.ndarray  # where each key's windows begin in ``members``
    members: np.ndarray


@dataclass
class Patterns:
    """Distinct windows as places in a buffer, the items that have them, and how to search for them."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    names: list[str]
    owner_bounds: np.ndarray  # where each window's items begin in ``owners``
    owners: np.ndarray
    groups: list[Group]

    @staticmethod
    def of(rows: list[tuple[str, str | None]], words: int = WORDS) -> Patterns:
        """From (item id, text); windows of a null or wordless text do not exist."""
        raw = [(text or "").encode() for _, text in rows]
        offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(t) for t in raw], dtype=np.int64)))
        data, starts = spaced(np.frombuffer(b"".join(raw), np.uint8), offsets)
        names = sorted({item for item, _ in rows})
        number = {name: i for i, name in enumerate(names)}
        start, end, size, text = _windows(data, starts, words)
        kept, code = np.unique(_distinct(data, start, end), return_inverse=True)
        pairs = np.unique(code * len(names) + np.array([number[item] for item, _ in rows], np.int64)[text])
        start, end, size = start[kept], end[kept], size[kept]
        length = np.searchsorted(_LENGTHS, end - start, side="right")
        groups = [Patterns._group(data, start, np.flatnonzero(length == k), end - start) for k in np.unique(length)]
        return Patterns(
            data.tobytes(), start.astype(np.int32), end.astype(np.int32), size.astype(np.int32), names,
            np.searchsorted(pairs, np.arange(len(kept) + 1) * max(len(names), 1)).astype(np.int32),
            (pairs % max(len(names), 1)).astype(np.int32), groups,
        )

    @staticmethod
    def _group(data: np.ndarray, start: np.ndarray, members: np.ndarray, length: np.ndarray) -> Group:
        least = int(length[members].min())
        width = min(8, least)
        bits = int(np.clip(np.ceil(np.log2(4 * min(len(members) * least, len(data)))), *_TABLE_BITS))
        shift = np.full(1 << bits, least - width + 1, np.uint8 if least < 256 else np.int32)
        blocks, at = _blocks(data, width), start[members]
        for place in range(width - 1, least):  # each place allows a smaller jump than those before it
            shift[_slots(blocks[at + place], bits)] = least - 1 - place
        keys = _suffix_keys(blocks[at + least - 1], blocks[at + width - 1])
        order = np.argsort(keys, kind="stable")
        suffixes, bounds = np.unique(keys[order], return_index=True)
        return Group(
            least, width, bits, shift, suffixes,
            np.append(bounds, len(members)).astype(np.int32), members[order].astype(np.int32),
        )

    def items(self, window: int) -> list[str]:
        return [self.names[k] for k in self.owners[self.owner_bounds[window] : self.owner_bounds[window + 1]].tolist()]

    def occurrences(self, data: np.ndarray) -> tuple[list[int], list[int]]:
        """Places in ``data`` where a window starts, and which window."""
        raw = data.tobytes()
        places: list[int] = []
        found: list[int] = []
        by_width: dict[int, np.ndarray] = {}
        for group in self.groups:
            if len(data) < group.least:
                continue
            if group.width not in by_width:
                by_width[group.width] = _blocks(data, group.width)
            blocks = by_width[group.width]
            for end, code in zip(*self._candidates(group, blocks), strict=True):
                start = end - group.least + 1
                for i in group.members[group.bounds[code] : group.bounds[code + 1]].tolist():
                    if raw.startswith(self.data[self.start[i] : self.end[i]], start):
                        places.append(start)
                        found.append(i)
        return places, found

    @staticmethod
    def _candidates(group: Group, blocks: np.ndarray) -> tuple[list[int], list[int]]:
        """Places where a block ends the head of some window, and its bucket.

        The text is cut into lanes; every lane jumps on its own until it leaves its part.
        """
        at = np.arange(group.least - 1, len(blocks), _LANE)
        stop = np.minimum(at + _LANE, len(blocks))
        ends, codes = [], []
        while len(at):
            here = blocks[at]
            jump = group.shift[_slots(here, group.bits)]
            maybe = np.flatnonzero(jump == 0)
            if len(maybe):
                keys = _suffix_keys(here[maybe], blocks[at[maybe] - group.least + group.width])
                code = np.searchsorted(group.suffixes, keys)
                code[code == len(group.suffixes)] = 0
                real = group.suffixes[code] == keys
                ends += at[maybe][real].tolist()
                codes += code[real].tolist()
            at = at + np.maximum(jump, 1)
            inside = at < stop
            at, stop = at[inside], stop[inside]
        return ends, codes


def _merge(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges (end exclusive) without overlaps, in order."""
    merged: list[tuple[int, int]] = []
    for first, last in sorted(hits):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return merged


_HITS = T.ArrayType(
    T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
)
_FIELDS = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("hits", _HITS, False),
    T.StructField("items", T.ArrayType(T.StringType()), False),
]


def _search(docs: DataFrame, patterns: Broadcast[Patterns], text: str, again: bool) -> DataFrame:
    """Append words, hit ranges and items of one set of windows; ``again``: add to those there."""

    def compute(_: object, column: pa.Array, *earlier: pa.Array) -> list[pa.Array]:
        search = patterns.value
        data, offsets = common.as_bytes(column)
        rows = len(column)
        n_words = np.zeros(rows, np.int64)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        for first, last in common.chunks(offsets):
            own = offsets[first : last + 1]
            words, starts = spaced(data[own[0] : own[-1]], own - own[0])
            blanks = np.cumsum(words == 32)
            lead = blanks[starts[:-1]]
            n_words[first:last] = blanks[starts[1:] - 1] - lead
            places, found = search.occurrences(words)
            rank = np.searchsorted(starts, places, side="right") - 1
            for place, i, r in zip(places, found, rank.tolist(), strict=True):
                word = int(blanks[place] - lead[r])
                hits[first + r].append((word, word + int(search.words[i])))
                items[first + r].update(search.items(i))
        if earlier:
            for r, (old_hits, old_items) in enumerate(zip(*(x.to_pylist() for x in earlier), strict=True)):
                hits[r] += [(x["first"], x["last"]) for x in old_hits]
                items[r].update(old_items)
        ranges = [[{"first": a, "last": b} for a, b in _merge(hits.get(r, []))] for r in range(rows)]
        pair = pa.struct([("first", pa.int64()), ("last", pa.int64())])
        return [
            pa.array(n_words),
            pa.array(ranges, pa.list_(pair)),
            pa.array([sorted(items.get(r, ())) for r in range(rows)], pa.list_(pa.string())),
        ]

    if not again:
        return common.with_arrow_columns(docs, [text], _FIELDS, compute)
    renamed = docs.withColumnsRenamed({"hits": "_hits", "items": "_items"})
    found = common.with_arrow_columns(renamed, [text, "_hits", "_items"], _FIELDS, compute)
    return found.drop("_hits", "_items")


def _passes(items: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """Rows of the benchmark in lists of about ``limit`` bytes of text (or one item)."""
    named = items.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // limit) or 1
    for k in range(parts):
        part = named.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        yield [(row.item, row.text) for row in part.collect()]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    words: int = WORDS,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Append to each document ``n_words``, ``hits``, ``items``, ``n_hit`` and ``contaminated``.

    ``hits`` are the ranges of words (from 0, end exclusive) inside any occurrence of a window,
    ``items`` the sorted ids of the items with occurring windows, ``n_hit`` the words hit.
    Contaminated means that a twentieth of the words, or more, are hit. Null and empty texts have
    no words; a null item id counts as the empty string; repeated items count once; without items
    nothing is hit. Columns of the input named like the new ones are replaced.
    """
    context = docs.sparkSession.sparkContext
    found = docs
    for k, rows in enumerate(_passes(benchmark, item, item_text, pass_bytes)):
        found = _search(found, context.broadcast(Patterns.of(rows, words)), text, again=k > 0)
    added = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    found = common.without(found, ["n_hit", "contaminated"]).withColumn("n_hit", added)
    return found.withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    )
