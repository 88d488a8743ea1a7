"""Main text of web pages by union-free regular-expression inference.

A page is a stream of tags and texts. Tandem repeats in it become repeated groups. The streams of a
host are aligned one after the other: what only some have becomes optional, texts that differ
and texts of repeated groups become slots, texts that never differ stay part of the template. The result is a wrapper for the
host, a regular expression without unions. A page is read by aligning it with its wrapper: texts
of slots are its content, unless an element around them says otherwise (menu, form, advert ...).

Every task aligns the pages it reads, so a host sends one wrapper per task, not its pages; equal
wrappers are counted once, and the rest of a host's wrappers are aligned with each other.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm import common

#: Longest repeated group looked for, in tokens.
LONGEST_GROUP = 16
#: Cells of an alignment table; larger ones have a bit for a cell.
MOST_CELLS = 1 << 20
#: Bits of such a table; where more were needed, streams are halved and the halves aligned.
MOST_BITS = 1 << 28
#: Pages, and share of a host's pages, that must have a constant text for it to be template text.
LEAST_PAGES, LEAST_SHARE = 3, 0.5
#: Wrappers up to so many bytes in all are broadcast, more are joined by host.
BROADCAST_BYTES = 32 << 20
#: Hosts a task remembers before it sends their wrappers and starts anew.
REMEMBERED_HOSTS = 20_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/<>]*)(?P<more>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^<>]*>"
    r"|</?[a-z][^<>]*\Z",
    re.S | re.I,
)
_MARKS = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", re.I)

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr img".split()
)
#: Elements that are never article text.
OUTSIDE = frozenset(
    "head title nav header footer aside form noscript template svg iframe button select textarea "
    "object canvas dialog menu".split()
)
MAIN = frozenset(["article", "main"])
MAIN_MARKS = frozenset(["main", "articlebody", "article"])
#: Words of a class, id or role that mark what is not article text.
OUTSIDE_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo "
    "promotion banner cookie cookies consent gdpr notice popup modal overlay menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar aside footer header masthead comment comments "
    "commentlist respond reply replies discussion disqus share sharing social related newsletter "
    "subscribe subscription login signup widget pagination pager toolbar complementary "
    "contentinfo search".split()
)

IN_MAIN, OTHER, DROPPED = "#main", "#other", "#out"
#: Text of an article below an element whose class, id or role says outside, while a page is read.
_DOUBTFUL = "#doubtful"
_TEXTS = frozenset([IN_MAIN, OTHER, DROPPED])


@dataclass
class Piece:
    """A token of a page: its key and, of a text, the raw text and its fingerprint."""

    key: str | tuple
    text: str = ""
    breaks: bool = False  # a block ends here
    inner: list[Piece] = field(default_factory=list)

    def mark(self) -> int:
        return xxhash.xxh64_intdigest(self.text.strip().encode("utf-8", "replace")) >> 1


def _marks(more: str) -> list[str]:
    found = []
    for match in _MARKS.finditer(more):
        found += _PARTS.findall((match[1] or match[2] or match[3] or "").lower())
    return found


def read_page(page: str) -> list[Piece]:
    """Tags and texts of a page; each text knows whether it is in the article or outside."""
    pieces: list[Piece] = []
    # Name, outside, outside by words of class, id or role alone, in main, in a main below such words.
    stack: list[tuple[str, bool, bool, bool, bool]] = []
    open_: dict[str, int] = {}

    def text(raw: str) -> None:
        _, outside, _, main, doubtful = stack[-1] if stack else ("", False, False, False, False)
        kind = DROPPED if outside else _DOUBTFUL if doubtful else IN_MAIN if main else OTHER
        if raw and pieces and pieces[-1].key == kind:
            pieces[-1].text += raw  # only a comment was between
        elif raw and (not raw.isspace() or kind != DROPPED):
            pieces.append(Piece(kind, raw))

    at = 0
    for match in _TOKEN.finditer(page):
        if match.start() > at:
            text(page[at : match.start()])
        at = match.end()
        name = (match["name"] or "").lower()
        if not name:
            continue
        if match["close"]:
            if open_.get(name):
                while True:
                    last = stack.pop()[0]
                    open_[last] -= 1
                    if last == name:
                        break
            pieces.append(Piece(f"/{name}", breaks=name not in INLINE))
            continue
        more = match["more"]
        marks = _marks(more) if "=" in more else []
        pieces.append(Piece(".".join([f"<{name}", *marks]), breaks=name not in INLINE))
        if name in VOID or more.endswith("/") and name in ("svg", "path"):
            continue
        _, outside, by_words, main, doubtful = stack[-1] if stack else ("", False, False, False, False)
        named = name not in ("html", "body")
        words = named and not OUTSIDE_MARKS.isdisjoint(marks)
        by_words = by_words if outside else words and name not in OUTSIDE
        if named and (name in MAIN or not MAIN_MARKS.isdisjoint(marks)):
            if by_words and not main and not words:
                outside, by_words, doubtful = False, False, True
            main = True
        outside = outside or name in OUTSIDE or words
        by_words = by_words and name not in OUTSIDE
        stack.append((name, outside, by_words, main, doubtful))
        open_[name] = open_.get(name, 0) + 1
    text(page[at:])
    pieces = _settled(pieces)
    # White space between blocks is no text.
    return [
        p
        for i, p in enumerate(pieces)
        if p.key not in _TEXTS
        or not p.text.isspace()
        or 0 < i < len(pieces) - 1
        and not pieces[i - 1].breaks
        and not pieces[i + 1].breaks
    ]


def _settled(pieces: list[Piece]) -> list[Piece]:
    """Articles below a class word such as ``with-sidebar`` count if the page has no other article
    and less text elsewhere; if not, they are outside."""
    size = {IN_MAIN: 0, OTHER: 0, _DOUBTFUL: 0}
    for p in pieces:
        if p.key in size:
            size[p.key] += len(p.text.strip())
    kind = IN_MAIN if not size[IN_MAIN] and size[_DOUBTFUL] > size[OTHER] else DROPPED
    out: list[Piece] = []
    for p in pieces:
        if p.key != _DOUBTFUL:
            out.append(p)
        elif kind != DROPPED or not p.text.isspace():
            out.append(Piece(kind, p.text))
    return out


def fold_repeats(pieces: list[Piece]) -> list[Piece]:
    """Tandem repeats, the shortest first, as one piece each; its key is the group's keys."""
    for width in range(1, LONGEST_GROUP + 1):
        keys = [p.key for p in pieces]
        if len(keys) < 2 * width:
            break
        same = [*map(eq, keys, keys[width:]), False]
        if bytes(width).replace(b"\0", b"\1") not in bytes(same):
            continue
        out: list[Piece] = []
        start = 0
        while start < len(pieces):
            # As long as each key equals the one a group later, the group goes on.
            i, run = start, 0
            while i < len(same) and same[i]:
                i, run = i + 1, run + 1
            if run >= width:
                size = width * (run // width + 1)
                group = tuple(keys[start : start + width])
                if width == 1 and isinstance(group[0], tuple):
                    group = group[0][1:]
                out.append(Piece(("+", *group), inner=pieces[start : start + size]))
                start += size
            else:
                out += pieces[start : i + 1]
                start = i + 1
        pieces = out
    return pieces


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence."""
    first = 0
    while first < len(a) and first < len(b) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    pairs = [(i, i) for i in range(first)]
    x, y = a[first : len(a) - last], b[first : len(b) - last]
    if x and y:
        inner = _table(x, y) if len(x) * len(y) <= MOST_CELLS else _bits(x, y)
        pairs += [(first + i, first + j) for i, j in inner]
    return pairs + [(len(a) - k, len(b) - k) for k in range(last, 0, -1)]


def _table(a: list, b: list) -> list[tuple[int, int]]:
    best = [[0] * (len(b) + 1)]
    for x in reversed(a):
        below, row = best[-1], [0] * (len(b) + 1)
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == b[j] else max(below[j], row[j + 1])
        best.append(row)
    best.reverse()
    pairs, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def _rows_of_bits(a: list, b: list) -> Iterator[int]:
    """For each prefix of ``a`` the row of the table: bit j is 0 where b[j] adds a pair."""
    where: dict = {}
    for j, k in enumerate(b):
        where[k] = where.get(k, 0) | 1 << j
    every = row = (1 << len(b)) - 1
    for k in a:
        if both := row & where.get(k, 0):
            row = (row + both | row - both) & every
        yield row


def _pairs_before(a: list, b: list) -> np.ndarray:
    """Most pairs of ``a`` and the first j of ``b``, for each j."""
    row = 0
    for row in _rows_of_bits(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.concatenate(([0], np.cumsum(1 - bits[: len(b)].astype(np.int64))))


def _bits(a: list, b: list) -> list[tuple[int, int]]:
    """As ``_table``, by operations on whole rows; halves ``a`` until its table is small."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > MOST_BITS:
        half = len(a) // 2
        j = int(np.argmax(_pairs_before(a[:half], b) + _pairs_before(a[half:][::-1], b[::-1])[::-1]))
        return _bits(a[:half], b[:j]) + [(half + x, j + y) for x, y in _bits(a[half:], b[j:])]
    rows = [(1 << len(b)) - 1, *_rows_of_bits(a, b)]
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> j - 1 & 1:
            j -= 1
        elif not rows[i - 1] >> j - 1 & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


@dataclass
class Node:
    """A part of a wrapper: key, whether only some pages have it, and a constant text's mark.

    ``mark`` is None for a slot and for what is no text; ``pages`` counts the pages that have it, and
    ``seen`` names up to ``LEAST_PAGES`` different contents of pages with a constant text.
    """

    key: str | tuple
    optional: bool = False
    mark: int | None = None
    pages: int = 1
    seen: tuple[int, ...] = ()


@dataclass
class Wrapper:
    nodes: list[Node]
    pages: int = 1

    def constant(self, node: Node) -> bool:
        """Whether a text is the same on so many pages that it is the template's."""
        return node.mark is not None and len(node.seen) >= LEAST_PAGES and node.pages >= LEAST_SHARE * self.pages

    def times(self, n: int) -> Wrapper:
        """The wrapper of ``n`` times as many pages."""
        return Wrapper([replace(x, pages=x.pages * n) for x in self.nodes], self.pages * n)

    @staticmethod
    def of(pieces: list[Piece]) -> Wrapper:
        seen = (_content(pieces),)
        return Wrapper([Node(p.key, mark=p.mark(), seen=seen) if p.key in _TEXTS else Node(p.key) for p in pieces])

    def align(self, other: Wrapper) -> Wrapper:
        """The wrapper that reads what either reads."""
        a, b = self.nodes, other.nodes
        groups = {n.key for n in [*a, *b] if isinstance(n.key, tuple)}
        if groups:
            a, b = _regroup(a, groups), _regroup(b, groups)
        made: list[Node] = []
        i = j = 0
        for x, y in [*_common([n.key for n in a], [n.key for n in b]), (len(a), len(b))]:
            made += [replace(n, optional=True) for n in [*a[i:x], *b[j:y]]]
            if x < len(a):
                mark = a[x].mark if a[x].mark == b[y].mark else None
                seen = () if mark is None else tuple(sorted({*a[x].seen, *b[y].seen})[:LEAST_PAGES])
                made.append(Node(a[x].key, a[x].optional or b[y].optional, mark, a[x].pages + b[y].pages, seen))
            i, j = x + 1, y + 1
        return Wrapper(_regroup(made, set()), self.pages + other.pages)

    def dump(self) -> str:
        shown = [[n.key, n.optional, n.mark, n.pages, n.seen] for n in self.nodes]
        return json.dumps([self.pages, shown], ensure_ascii=False)

    @staticmethod
    def load(text: str) -> Wrapper:
        pages, nodes = json.loads(text)
        return Wrapper([Node(_frozen(k), o, m, n, tuple(seen)) for k, o, m, n, seen in nodes], pages)

    def expression(self) -> str:
        """The wrapper as a regular expression over tags, ``#`` for a slot."""
        parts = []
        for n in self.nodes:
            shown = _shown(n.key) if n.mark is None else "text"
            parts.append(f"({shown})?" if n.optional else shown)
        return " ".join(parts)


def _shown(key: str | tuple) -> str:
    if isinstance(key, tuple):
        return f"({' '.join(_shown(k) for k in key[1:])})+"
    return "#" if key in _TEXTS else f"{key}>"


def _frozen(key: object) -> str | tuple:
    return tuple(_frozen(k) for k in key) if isinstance(key, list) else key


def _regroup(nodes: list[Node], groups: set[tuple]) -> list[Node]:
    """A single occurrence of a group that repeats elsewhere is that group, too."""
    first = {}
    for group in sorted(groups, key=len):
        first.setdefault(group[1], []).append(group[1:])
    out: list[Node] = []
    i = 0
    keys = [n.key for n in nodes]
    while i < len(nodes):
        found = next((g for g in first.get(keys[i], ()) if tuple(keys[i : i + len(g)]) == g), None)
        size = len(found) if found else 1
        part = nodes[i : i + size]
        own = nodes[i]
        if found:
            own = Node(("+", *found), all(n.optional for n in part), pages=max(n.pages for n in part))
        if out and isinstance(own.key, tuple) and out[-1].key == own.key:
            # One group goes on.
            out[-1] = Node(own.key, own.optional and out[-1].optional, pages=max(own.pages, out[-1].pages))
        else:
            out.append(own)
        i += size
    return out


def _regroup_pieces(pieces: list[Piece], groups: set[tuple]) -> list[Piece]:
    first = {}
    for group in sorted(groups, key=len):
        first.setdefault(group[1], []).append(group[1:])
    out: list[Piece] = []
    i = 0
    keys = [p.key for p in pieces]
    while i < len(pieces):
        found = next((g for g in first.get(keys[i], ()) if tuple(keys[i : i + len(g)]) == g), None)
        size = len(found) if found else 1
        own = Piece(("+", *found), inner=pieces[i : i + size]) if found else pieces[i]
        if out and isinstance(own.key, tuple) and out[-1].key == own.key:
            out[-1] = Piece(own.key, inner=[out[-1], own])
        else:
            out.append(own)
        i += size
    return out


def has_main(pieces: list[Piece]) -> bool:
    return any(p.key == IN_MAIN for p in pieces)


def _content(pieces: list[Piece]) -> int:
    """A fingerprint of the texts that may be content; copies of an article share it."""
    texts = [p for piece in pieces for p in _flat(piece) if p.key in _TEXTS]
    wanted = IN_MAIN if has_main(texts) else OTHER
    own = "\0".join(" ".join(p.text.split()) for p in texts if p.key == wanted)
    return xxhash.xxh64_intdigest(own.encode("utf-8", "replace")) >> 1


def host_of(url: str | None) -> str:
    match = _HOST.match(url or "")
    return match[1].lower() if match else ""


def template_of(url: str | None, pieces: list[Piece]) -> str:
    """Pages of a host that name their article have a wrapper of their own."""
    return f"{'main' if has_main(pieces) else 'plain'} {host_of(url)}"


def main_text(pieces: list[Piece], wrapper: Wrapper) -> str:
    """Texts of the page at the wrapper's content slots, as blocks joined by one space.

    Content are the texts of its article or, if the page names none, those outside menus and the
    like, except those that are the same on many pages while other texts differ.
    """
    article = has_main(pieces)
    groups = {n.key for n in wrapper.nodes if isinstance(n.key, tuple)}
    items = _regroup_pieces(fold_repeats(pieces), groups) if groups else fold_repeats(pieces)
    nodes = wrapper.nodes
    wanted = IN_MAIN if article else OTHER
    varied = any(not wrapper.constant(n) and _has(n.key, wanted) for n in nodes)
    fixed = set()
    if varied:
        pairs = _common([p.key for p in items], [n.key for n in nodes])
        fixed = {i for i, j in pairs if wrapper.constant(nodes[j]) and items[i].mark() == nodes[j].mark}
    blocks, block = [], []
    for i, item in enumerate(items):
        for piece in _flat(item):
            if piece.breaks:
                blocks.append("".join(block))
                block = []
            elif piece.key == "<br" or str(piece.key).startswith("<br."):
                block.append(" ")
            elif piece.key == wanted and i not in fixed:
                block.append(html.unescape(piece.text) if "&" in piece.text else piece.text)
    blocks.append("".join(block))
    return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def _flat(piece: Piece) -> Iterator[Piece]:
    if not piece.inner:
        yield piece
    for inner in piece.inner:
        yield from _flat(inner)


def _has(key: str | tuple, wanted: str) -> bool:
    return any(_has(k, wanted) for k in key) if isinstance(key, tuple) else key == wanted


def infer_wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(``template``, ``wrapper``, ``expression``): one row for each kind of page of a host.

    Read are all pages; a null page is empty, a null URL has the empty host.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in batches:
            for where, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces = read_page(raw or "")
                template = template_of(where, pieces)
                own = Wrapper.of(fold_repeats(pieces))
                known[template] = known[template].align(own) if template in known else own
                if len(known) >= REMEMBERED_HOSTS:
                    yield _rows(known)
                    known = {}
        yield _rows(known)

    def merge(rows: pa.Table) -> pa.Table:
        whole: Wrapper | None = None
        for text, n in sorted(zip(rows["wrapper"].to_pylist(), rows["n"].to_pylist(), strict=True)):
            own = Wrapper.load(text).times(n)
            whole = own if whole is None else whole.align(own)
        return pa.table(
            {"template": rows["template"][:1], "wrapper": [whole.dump()], "expression": [whole.expression()]}
        )

    found = pages.select(url, page).mapInArrow(partial, "template string, wrapper string")
    found = found.groupBy("template", "wrapper").agg(F.count("*").alias("n"))
    return found.groupBy("template").applyInArrow(merge, "template string, wrapper string, expression string")


def _rows(known: dict[str, Wrapper]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(known), pa.string()), pa.array([w.dump() for w in known.values()], pa.string())],
        names=["template", "wrapper"],
    )


@lru_cache(maxsize=4096)
def _loaded(text: str) -> Wrapper:
    return Wrapper.load(text)


def extract(pages: DataFrame, wrappers: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """Append ``main_text`` to each page, read by the wrapper of its host.

    Empty if there is none, as for null and empty pages. Pages of hosts without a wrapper are read
    as their own. ``wrappers`` should be a stored table. A column of that name is replaced.
    """
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("template"))).first()[0] or 0
    wide = wrappers.select("template", "wrapper")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST.pattern.replace("^", "^(?i)", 1), 1))
    both = (
        wide.withColumn("_host", F.substring_index("template", " ", -1))
        .groupBy("_host")
        .agg(F.collect_list(F.struct("template", "wrapper")).alias("_wrappers"))
    )  # at most two rows a host
    if size <= BROADCAST_BYTES:
        both = F.broadcast(both)
    placed = common.without(pages, ["_host", "_wrappers"]).withColumn("_host", host)
    joined = placed.join(both, "_host", "left")

    def compute(_: object, urls: pa.Array, raws: pa.Array, found: pa.Array) -> list[pa.Array]:
        texts = []
        for i, (where, raw) in enumerate(zip(urls.to_pylist(), raws.to_pylist(), strict=True)):
            pieces = read_page(raw or "")
            template = template_of(where, pieces)
            own = {x["template"]: x["wrapper"] for x in found[i].as_py() or ()}
            wrapper = _loaded(own[template]) if template in own else Wrapper.of(fold_repeats(pieces))
            texts.append(main_text(pieces, wrapper))
        return [pa.array(texts, pa.string())]

    field_ = T.StructField("main_text", T.StringType(), False)
    return common.with_arrow_columns(joined, [url, page, "_wrappers"], [field_], compute).drop("_host", "_wrappers")
