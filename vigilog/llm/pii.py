"""Personal data: base patterns, and terms that give protected entities away.

Every distinct address, card or number found by the patterns is a protected entity. Words near its
occurrences are counted over all documents: with n_e documents that hold entity e, n_t that hold
term t, n_et that hold t near e, and n documents, the information term t gives about e is
PMI = log2(n_et n / (n_e n_t)), and e itself has log2(n / n_e) bits. The quotient is the share of
the entity that the term discloses; 1 means that the term occurs nowhere else. Terms above one
threshold are generalised to their category, above a higher one removed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm import common

KINDS = ("email", "ip", "card", "phone")
GENERALISED, REMOVED = "generalised", "removed"
#: Words on either side of an entity that are looked at.
NEAR_WORDS = 5
#: Shares of an entity from which a term is generalised or removed. An entity of one document among
#: n has terms above a share s that lie in at most n ** (1 - s) documents.
GENERALISE_FROM = 0.75
REMOVE_FROM = 0.95
#: For a large corpus, where n ** 0.25 documents would make many rare words of others go.
GENERALISE_FROM_LARGE = 0.9
#: Ends of the slices of documents in which terms are counted, in parts of the last.
SLICES = (1, 6, 32)
#: Slots of the bitmap that tells candidate terms from other words; its size is fixed.
_SLOTS = 1 << 22
#: Slots of the bitmap over numbers of rows.
_ROW_SLOTS = 1 << 19

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(rb"[0-9]")
# Starting only where a run of digits starts changes no match and keeps long runs linear.
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_NOT_DIGITS = bytes(set(range(256)) - set(b"0123456789"))
_IS_TERM = np.zeros(256, bool)
_IS_TERM[48:58] = _IS_TERM[65:91] = _IS_TERM[97:123] = _IS_TERM[128:] = True


def luhn(digits: bytes) -> bool:
    total = 0
    for i, byte in enumerate(reversed(digits)):
        value = byte - 48
        total += value if i % 2 == 0 else value * 2 - 9 * (value > 4)
    return total % 10 == 0


def _emails(raw: bytes) -> Iterator[tuple[int, int]]:
    end, at = 0, raw.find(b"@")
    while at >= 0:
        start = at
        while start > end and raw[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(raw, at + 1) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = raw.find(b"@", max(at + 1, end))


def base_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by kind and start."""
    found = [("email", *span) for span in _emails(raw)]
    if not _DIGIT.search(raw):
        return found
    for match in _IP.finditer(raw):
        parts = [part.lstrip(b"0") or b"0" for part in match[0].split(b".")]
        if all(len(part) <= 3 and int(part) <= 255 for part in parts):
            found.append(("ip", *match.span()))
    for match in _CARD.finditer(raw):
        digits = match[0].translate(None, _NOT_DIGITS)
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *match.span()))
    if b"+" in raw:
        for match in _PHONE.finditer(raw):
            if 9 <= len(match[0].translate(None, _NOT_DIGITS)) <= 15:
                found.append(("phone", *match.span()))
    return found


def entity_key(kind: str, value: bytes) -> str:
    """A name for an entity that does not show it; spellings of one number are one entity."""
    plain = value.lower() if kind in ("email", "ip") else value.translate(None, _NOT_DIGITS)
    return xxhash.xxh3_128_hexdigest(kind.encode() + b":" + plain)


def near_terms(
    raw: bytes, spans: list[tuple[str, int, int]], reach: int = NEAR_WORDS
) -> dict[tuple[str, bytes], set[tuple[int, int]]]:
    """Places of the words near each entity, by entity and lower-cased word."""
    covered = sorted((a, b) for _, a, b in spans)
    words = []
    i = 0
    for match in _WORD.finditer(raw):
        a, b = match.span()
        while i < len(covered) and covered[i][1] <= a:
            i += 1
        # Spans of several kinds may overlap, so all that start before the word's end count.
        if not any(x < b and a < y for x, y in covered[i : bisect_left(covered, (b, 0))]):
            words.append((a, b))
    found: dict[tuple[str, bytes], set[tuple[int, int]]] = {}
    for kind, start, end in spans:
        entity = entity_key(kind, raw[start:end])
        middle = bisect_left(words, (start, start))
        for a, b in words[max(0, middle - reach) : middle + reach]:
            found.setdefault((entity, raw[a:b].lower()), set()).add((a, b))
    return found


_SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
    ]
)
_TERM = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("slot", T.LongType()),
        T.StructField("places", T.ArrayType(_SPAN)),
    ]
)
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_ARROW_TERM = pa.struct(
    [
        ("entity", pa.string()),
        ("term", pa.string()),
        ("slot", pa.int64()),
        ("places", pa.list_(_ARROW_SPAN)),
    ]
)


def _slots(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (common.span_hashes(data, starts, ends) % np.uint64(_SLOTS)).astype(np.int64)


def _term_slot(term: bytes) -> int:
    return int(_slots(np.frombuffer(term, np.uint8), np.array([0]), np.array([len(term)]))[0])


def _points(raw: bytes) -> np.ndarray | None:
    """Code points before each byte; None if bytes and code points are the same."""
    if raw.isascii():
        return None
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(lead)))


def detect(docs: DataFrame, text: str = "text", reach: int = NEAR_WORDS) -> DataFrame:
    """Append ``base`` spans and the ``terms`` near them (both in code points) to each row."""

    def compute(_: object, column: pa.Array) -> list[pa.Array]:
        data, offsets = common.as_bytes(column)
        whole = memoryview(data)
        base: list[list[dict]] = []
        terms: list[list[dict]] = []
        for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            raw = bytes(whole[first:last])
            spans = base_spans(raw)
            base.append([])
            terms.append([])
            if not spans:
                continue
            points = _points(raw)
            at = (lambda x: x) if points is None else (lambda x, p=points: int(p[x]))
            base[-1] += [{"kind": k, "start": at(a), "end": at(b)} for k, a, b in spans]
            for (entity, term), places in near_terms(raw, spans, reach).items():
                shown = [{"kind": _category(raw[a:b]), "start": at(a), "end": at(b)} for a, b in sorted(places)]
                terms[-1].append(
                    {"entity": entity, "term": term.decode(), "slot": _term_slot(term), "places": shown}
                )
        return [pa.array(base, pa.list_(_ARROW_SPAN)), pa.array(terms, pa.list_(_ARROW_TERM))]

    fields = [
        T.StructField("base", T.ArrayType(_SPAN), False),
        T.StructField("terms", T.ArrayType(_TERM), False),
    ]
    return common.with_arrow_columns(docs, [text], fields, compute)


def _category(word: bytes) -> str:
    if word.isdigit():
        return "NUMBER"
    return "NAME" if word.decode()[0].isupper() else "WORD"


def _bitmap(candidates: DataFrame) -> Broadcast:
    """The slots of ``candidates``, packed, for all tasks."""
    slots = candidates.select("slot").distinct().toArrow()["slot"].to_numpy()
    bitmap = np.zeros(_SLOTS, bool)
    bitmap[slots] = True
    return candidates.sparkSession.sparkContext.broadcast(np.packbits(bitmap))


def _wanted_words(
    data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of some texts, and of the words whose slot is wanted the starts, ends
    and texts, counted from 0."""
    own = common.LOWER[data[offsets[0] : offsets[-1]]]
    bounds = offsets - offsets[0]
    inside = _IS_TERM[own]
    # Words never span two texts: cut at the first byte of each.
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    cuts = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(own))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]]) if len(cuts) else cuts
    starts = np.sort(np.concatenate((np.flatnonzero(edges == 1), cuts)))
    ends = np.sort(np.concatenate((np.flatnonzero(edges == -1), cuts)))
    hits = np.flatnonzero(wanted[_slots(own, starts, ends)])
    return own, starts[hits], ends[hits], np.searchsorted(bounds, starts[hits], side="right") - 1


def _documents_with(docs: DataFrame, candidates: DataFrame, text: str) -> DataFrame:
    """(``term``, ``n``): the number of documents with each word, at least for the candidates.

    A bitmap of fixed size drops most words that are no candidate.
    """
    packed = _bitmap(candidates)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(packed.value).view(bool)
        for batch in batches:
            data, offsets = common.as_bytes(batch.column(0))
            counts: dict[bytes, int] = {}
            for first, last in common.chunks(offsets):
                own, starts, ends, owner = _wanted_words(data, offsets[first : last + 1], wanted)
                raw = own.tobytes()
                seen = set()
                for a, b, i in zip(starts.tolist(), ends.tolist(), owner.tolist(), strict=True):
                    if (i, word := raw[a:b]) not in seen:
                        seen.add((i, word))
                        counts[word] = counts.get(word, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([word.decode() for word in counts], pa.string()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                names=["term", "n"],
            )

    found = docs.select(text).mapInArrow(words, "term string, n bigint")
    return found.groupBy("term").agg(F.sum("n").alias("n"))


def _document_counts(docs: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """(``term``, ``n_t``) of the terms that lie in at most ``most`` documents; ``terms`` has
    ``term``, ``slot``, ``most`` and ``least``, a number of documents known to hold it.

    Slices of the documents, each a few times larger than those before, are counted in turn. A term
    that has too many already is not looked for any more, as it can't come back under its limit, so
    what is counted stays in proportion to the input. Every slice is counted for the terms that are left.
    """
    part = F.pmod(F.xxhash64(text), F.lit(SLICES[-1]))
    left = common.stage(terms.where(F.col("least") <= F.col("most")).withColumn("n_t", F.lit(0).cast("long")))
    for first, end in zip((0, *SLICES[:-1]), SLICES, strict=True):
        found = _documents_with(docs.where((part >= first) & (part < end)), left, text)
        counted = left.join(found, "term", "left").withColumn("n_t", F.col("n_t") + F.coalesce("n", F.lit(0)))
        left = common.stage(counted.drop("n").where(F.col("n_t") <= F.col("most")))
    return left.select("term", "n_t")


def disclosing_terms(
    detected: DataFrame,
    docs: DataFrame,
    text: str = "text",
    generalise: float = GENERALISE_FROM,
    remove: float = REMOVE_FROM,
) -> DataFrame:
    """(``entity``, ``term``, ``share``, ``action``) of the terms above the thresholds.

    ``detected`` has the rows of ``detect``; ``docs`` the texts of the same documents.
    """
    near = detected.select(F.explode("terms").alias("t")).select("t.entity", "t.term", "t.slot")
    pairs = common.stage(near.groupBy("entity", "term", "slot").agg(F.count("*").alias("n_et")))
    held = detected.select(F.array_distinct(F.transform("terms", lambda t: t["entity"])).alias("e"))
    held = common.stage(held.select(F.explode("e").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")))
    own = detected.select(F.explode(F.array_distinct(F.transform("terms", lambda t: t["term"]))).alias("term"))
    known = own.groupBy("term").agg(F.count("*").alias("least"))
    n = F.lit(float(detected.count()))
    # share >= generalise if and only if n_t is at most this; a little more, for rounding.
    most = F.col("n_et") * F.pow(n / F.col("n_e"), F.lit(1 - generalise)) * (1 + 1e-9)
    limits = pairs.join(held, "entity").groupBy("term", "slot").agg(F.max(most).alias("most"))
    counts = _document_counts(docs, limits.join(known, "term"), text)
    counted = pairs.join(counts, "term").join(held, "entity")
    bits = F.log2(n / F.col("n_e"))
    pmi = F.log2(F.col("n_et") * n / (F.col("n_e") * F.col("n_t")))
    counted = counted.withColumn("share", F.when(bits > 0, pmi / bits).otherwise(0.0))
    action = F.when(F.col("share") >= remove, REMOVED).otherwise(GENERALISED)
    return counted.where(F.col("share") >= generalise).select(
        "entity", "term", "slot", "share", action.alias("action")
    )


def _occurrences(docs: DataFrame, flagged: DataFrame, text: str) -> DataFrame:
    """(``_row``, ``term``, ``p``) of each word of ``docs`` whose slot is a flagged term's and that
    lies outside base spans, in code points."""
    packed = _bitmap(flagged)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(packed.value).view(bool)
        for batch in batches:
            data, offsets = common.as_bytes(batch.column(1))
            for first, last in common.chunks(offsets):
                bounds = offsets[first : last + 1]
                own, starts, ends, owner = _wanted_words(data, bounds, wanted)
                lower, raw = own.tobytes(), data[bounds[0] : bounds[-1]].tobytes()
                rows, terms, kinds, froms, tos = [], [], [], [], []
                text_, begin, points, spans = -1, 0, None, []
                for a, b, i in zip(starts.tolist(), ends.tolist(), owner.tolist(), strict=True):
                    if i != text_:
                        text_, begin = i, int(bounds[i] - bounds[0])
                        whole = raw[begin : int(bounds[i + 1] - bounds[0])]
                        points, row = _points(whole), batch.column(0)[first + i].as_py()
                        spans = sorted((x, y) for _, x, y in base_spans(whole))
                        reach = list(accumulate((y for _, y in spans), max))
                    x, y = a - begin, b - begin
                    k = bisect_left(spans, (y, 0))
                    if k and reach[k - 1] > x:
                        continue
                    rows.append(row)
                    terms.append(lower[a:b].decode())
                    kinds.append(_category(raw[a:b]))
                    froms.append(x if points is None else int(points[x]))
                    tos.append(y if points is None else int(points[y]))
                place = pa.StructArray.from_arrays(
                    [pa.array(kinds, pa.string()), pa.array(froms, pa.int64()), pa.array(tos, pa.int64())],
                    ["kind", "start", "end"],
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), pa.array(terms, pa.string()), place], names=["_row", "term", "p"]
                )

    fields = [
        T.StructField("_row", T.LongType()),
        T.StructField("term", T.StringType()),
        T.StructField("p", _SPAN),
    ]
    return docs.select("_row", text).mapInArrow(scan, T.StructType(fields))


def find_spans(
    docs: DataFrame,
    text: str = "text",
    keep_text: bool = True,
    reach: int = NEAR_WORDS,
    everywhere: bool = False,
    generalise: float = GENERALISE_FROM,
    remove: float = REMOVE_FROM,
) -> DataFrame:
    """Append ``base`` (spans of the patterns) and ``added`` (spans of disclosing terms).

    Spans are (kind, start, end) in code points, end exclusive; ``added`` kinds are
    ``generalised`` and ``removed``, with the term's ``category``. A null or empty text has none.
    Terms near several entities take the strongest action; every pair of entity and term counts,
    also of an entity in one document. With ``everywhere`` all occurrences of
    a term in all texts are spans, without it those near its entity. Repeated rows count as
    documents of their own. Columns of the input named like the new ones are replaced;
    ``keep_text`` false leaves out the text, which is then not written anew.
    """
    docs = common.without(docs, ["base", "added", "terms", "_row"])
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    if everywhere and not keep_text:
        # The texts are scanned again, so rows must keep their numbers.
        numbered = common.stage(numbered)
    marked = detect(numbered, text, reach)
    stored = common.stage(marked if keep_text else marked.drop(text))
    texts = stored if keep_text else numbered
    flagged = disclosing_terms(stored, texts, text, generalise, remove)
    if everywhere:
        flagged = common.stage(flagged.groupBy("term", "slot").agg(F.max("action").alias("action")))
        hits = _occurrences(texts, flagged, text).join(flagged.select("term", "action"), "term")
    else:
        near = stored.select("_row", F.explode("terms").alias("t")).select("_row", "t.*")
        hits = near.join(flagged.select("entity", "term", "action"), ["entity", "term"])
        hits = hits.select("_row", "action", F.explode("places").alias("p"))
    hits = hits.groupBy("_row", "p").agg(F.max("action").alias("kind"))  # "removed" is the greater
    span = F.struct("kind", F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.col("p.kind").alias("category"))
    spans = hits.groupBy("_row").agg(F.sort_array(F.collect_list(span)).alias("added"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,category:string>>")
    if everywhere:
        spans = common.stage(spans)
        apart = ~_maybe_in(spans)
    else:
        apart = F.size("terms") == 0
    # Only rows that can get spans are shuffled, not the other texts.
    plain = stored.where(apart).drop("terms", "_row").withColumn("added", none)
    joined = stored.where(~apart).drop("terms").join(spans, "_row", "left").drop("_row")
    return plain.unionByName(joined.withColumn("added", F.coalesce("added", none)))


def _maybe_in(spans: DataFrame) -> Column:
    """False only for rows without ``spans``, by a bitmap of fixed size over ``_row``."""
    slot = lambda: F.pmod(F.xxhash64("_row"), F.lit(_ROW_SLOTS))
    slots = spans.select(slot().alias("slot")).distinct().toArrow()["slot"].to_numpy()
    bitmap = np.zeros(_ROW_SLOTS, bool)
    bitmap[slots] = True
    shown = F.lit(bytearray(np.packbits(bitmap).tobytes()))
    byte = F.conv(F.hex(F.substring(shown, (F.floor(slot() / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (F.lit(7) - slot() % 8).cast("int")) == 1


def replace_spans(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each (start, end, replacement) put in; of overlapping spans the first counts.

    The part of a later span beyond the first is taken out as well.
    """
    parts, at = [], 0
    for start, end, shown in sorted(spans):
        if start >= at:
            parts += [text[at:start], shown]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def sanitise(
    docs: DataFrame,
    text: str = "text",
    everywhere: bool = False,
    generalise: float = GENERALISE_FROM,
    remove: float = REMOVE_FROM,
) -> DataFrame:
    """Rows with personal data and disclosing terms replaced in the text; other texts unchanged.

    Base spans become their kind in brackets, generalised terms ``[NAME]``, ``[NUMBER]`` or
    ``[WORD]``, removed terms nothing. Null texts stay null. Columns are those of ``docs``.
    """
    names = docs.columns
    found = find_spans(common.pack(docs.withColumnRenamed(text, "text"), "text"), "text", True, NEAR_WORDS, everywhere, generalise, remove)

    def compute(_: object, texts: pa.Array, base: pa.Array, added: pa.Array) -> list[pa.Array]:
        marked = (pa.compute.list_value_length(base).to_numpy(zero_copy_only=False) > 0) | (
            pa.compute.list_value_length(added).to_numpy(zero_copy_only=False) > 0
        )
        out = []
        for i in np.flatnonzero(marked).tolist():
            spans = [(x["start"], x["end"], f"[{x['kind'].upper()}]") for x in base[i].as_py()]
            spans += [
                (x["start"], x["end"], f"[{x['category']}]" if x["kind"] == GENERALISED else "")
                for x in added[i].as_py()
            ]
            out.append(replace_spans(texts[i].as_py(), spans))
        # Other texts are handed on as they are.
        kept = texts.cast(pa.large_string())
        return [pa.compute.replace_with_mask(kept, pa.array(marked), pa.array(out, pa.large_string())).cast(pa.string())]

    field = T.StructField("clean", T.StringType(), True)
    clean = common.with_arrow_columns(found, ["text", "base", "added"], [field], compute)
    return clean.select(
        *[(F.col("clean").alias(c) if c == text else F.col("row").getField(c).alias(c)) for c in names]
    )
