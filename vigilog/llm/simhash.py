"""Near-duplicates by SimHash: vantage-point trees find all fingerprints a few bits apart.

1. Each text becomes a 64-bit fingerprint of its word shingles; equal fingerprints are one point.
2. A vantage-point tree over a sample deals the points into shards of bounded size. A point has
   one home, and is also a guest in every shard that points near it may call home: where a tree
   node splits at radius r, points with a distance of at most r + bits go inward as guests, and
   guests go outward if theirs exceeds r - bits. By the triangle inequality no pair is missed.
3. Each shard is joined with itself and its guests by the same recursion. Pairs are united at once,
   so a shard sends a forest (one link per point), never all pairs of a dense group.
4. Spark spreads the smallest label over the forests of all shards until nothing changes.

The sample only sets the shards' sizes; results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm import common

WORDS = 4
BITS = 4
SEED = 42
#: Points that a shard should be home to.
SHARD_POINTS = 1 << 16
#: Sampled points per shard for the upper tree, and the most in all (bounds the driver's tree).
SAMPLE_PER_SHARD = 256
MAX_SAMPLE = 1 << 18
#: Points below which a node is compared pair by pair.
LEAF_POINTS = 96
_BLOCK = 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of the shingles of a text, repeats included; 0 for a text without words."""
    parts = text.lower().split()  # lower-cases A-Z, splits at 0x20 and 0x09-0x0D
    if not parts:
        return 0
    joined = memoryview(b" ".join(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(parts))
    n = len(parts) - width + 1
    starts, ends = starts[:n].tolist(), ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for first in range(0, n, _BLOCK):
        spans = zip(starts[first : first + _BLOCK], ends[first : first + _BLOCK], strict=True)
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in spans])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """Append ``fp`` (the fingerprint's 64 bits as a long); a null text is empty."""

    def compute(_: object, column: pa.Array) -> list[pa.Array]:
        data, offsets = common.as_bytes(column)
        raw = memoryview(data)
        found = [
            fingerprint(bytes(raw[a:b]), words)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        ]
        return [pa.array(np.array(found, np.uint64).view(np.int64))]

    field = T.StructField("fp", T.LongType(), False)
    return common.with_arrow_columns(docs, [text], [field], compute)


@dataclass(frozen=True)
class Node:
    """A vantage point and radius with the nodes inside and outside, or a shard's number."""

    shard: int = -1
    vantage: int = 0
    radius: int = 0
    inside: Node | None = None
    outside: Node | None = None


def _distances(points: np.ndarray, vantage: int | np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int16)


def _split(points: np.ndarray, bits: int, tries: int = 5) -> tuple[int, int, np.ndarray]:
    """Place of a vantage point, radius and distances that part the points well.

    Of a few candidates the one wins whose larger side, guests included, is smallest.
    """
    best: tuple[float, int, int] | None = None
    some = points[:: max(1, len(points) // 512)]
    for place in np.linspace(0, len(points) - 1, tries).astype(int).tolist():
        near = _distances(some, points[place])
        radius = int(np.median(near))
        inward, outward = (near <= radius + bits).mean(), (near > radius).mean()
        cost = max(inward, outward) + 0.01 * inward
        if best is None or cost < best[0]:
            best = (cost, place, radius)
    _, place, radius = best
    distances = _distances(points, points[place])
    # Both sides get points: the vantage point itself is always inside.
    return place, min(radius, int(distances.max()) - 1), distances


def build_tree(sample: np.ndarray, shards: int, bits: int = BITS) -> Node:
    """Halve the sampled points again and again until there is a leaf for each shard."""
    numbers = iter(range(1 << 40))

    def grow(points: np.ndarray, shards: int) -> Node:
        if shards <= 1 or len(points) < 2:
            return Node(shard=next(numbers))
        place, radius, distances = _split(points, bits)
        inner = distances <= radius
        share = min(max(round(shards * inner.mean()), 1), shards - 1)
        return Node(
            vantage=int(points[place]),
            radius=radius,
            inside=grow(points[inner], share),
            outside=grow(points[~inner], shards - share),
        )

    return grow(np.unique(sample), shards)


def route(tree: Node, points: np.ndarray, bits: int = BITS) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Shard, places of points and whether they are guests there."""
    none = np.zeros(0, np.int64)
    todo = [(tree, np.arange(len(points)), none)]
    while todo:
        node, home, guests = todo.pop()
        if not len(home) and not len(guests):
            continue
        if node.inside is None:
            yield node.shard, home, False
            yield node.shard, guests, True
            continue
        d, g = _distances(points[home], node.vantage), _distances(points[guests], node.vantage)
        near = home[(d > node.radius) & (d <= node.radius + bits)]
        inward = np.concatenate((guests[g <= node.radius + bits], near))
        todo.append((node.inside, home[d <= node.radius], inward))
        todo.append((node.outside, home[d > node.radius], guests[g > node.radius - bits]))


class Classes:
    """Disjoint sets of places; each is named by its smallest place."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, places: np.ndarray) -> np.ndarray:
        found = self.parent[places]
        while True:
            above = self.parent[found]
            if (above == found).all():
                self.parent[places] = found
                return found
            found = above

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def join_shard(home: np.ndarray, guests: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """All points that have a partner here, and the smallest (signed) of those linked with each.

    Links are home with home and home with guest. A node all of whose points are one class
    already needs no look.
    """
    signed = np.unique(np.concatenate((home, guests)).view(np.int64))
    points = signed.view(np.uint64)
    classes = Classes(len(points))
    todo = [(np.searchsorted(signed, np.sort(x.view(np.int64))) for x in (home, guests))]
    todo = [tuple(x) for x in todo]
    while todo:
        home, guests = todo.pop()
        every = np.concatenate((home, guests))
        if not len(home) or len(every) < 2:
            continue
        roots = classes.find(every)
        if (roots == roots[0]).all():
            continue
        if len(home) <= LEAF_POINTS:
            for first in range(0, len(every), _BLOCK):
                part = every[first : first + _BLOCK]
                apart = np.bitwise_count(points[home][:, None] ^ points[part][None, :])
                x, y = np.nonzero(apart <= bits)
                x, y = home[x], part[y]
                fresh = classes.parent[x] != classes.parent[y]
                classes.unite(x[fresh], y[fresh])
            continue
        place, radius, d = _split(points[home], bits)
        g = _distances(points[guests], points[home[place]])
        linked = np.concatenate((home[d <= bits], guests[g <= bits]))
        classes.unite(linked, np.full(len(linked), home[place]))
        near = home[(d > radius) & (d <= radius + bits)]
        todo.append((home[d <= radius], np.concatenate((guests[g <= radius + bits], near))))
        todo.append((home[d > radius], guests[g > radius - bits]))
    roots = classes.find(np.arange(len(points)))
    partnered = roots != np.arange(len(points))
    return signed[partnered], signed[roots[partnered]]


def links(points: DataFrame, n: int, bits: int = BITS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Links (``a``, ``b``) between distinct fingerprints ``fp`` at most ``bits`` bits apart.

    They form forests with the connected components of all such pairs. ``n`` is the number of
    points.
    """
    shards = max(1, -(-n // shard_points))
    wanted = min(shards * SAMPLE_PER_SHARD, MAX_SAMPLE)
    share = F.pmod(F.xxhash64("fp"), F.lit(max(n, 1))) < wanted
    sample = points.where(share).select("fp").toArrow()["fp"].to_numpy().view(np.uint64)
    tree = points.sparkSession.sparkContext.broadcast(build_tree(sample, shards, bits))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for shard, places, guest in route(tree.value, values, bits):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(places), shard, np.int32)),
                        pa.array(values[places].view(np.int64)),
                        pa.array(np.full(len(places), guest)),
                    ],
                    names=["shard", "fp", "guest"],
                )

    def join(rows: pa.Table) -> pa.Table:
        values = rows["fp"].to_numpy().view(np.uint64)
        guest = rows["guest"].to_numpy()
        a, b = join_shard(values[~guest], values[guest], bits)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    dealt = points.select("fp").mapInArrow(deal, "shard int, fp bigint, guest boolean")
    return dealt.groupBy("shard").applyInArrow(join, "a bigint, b bigint")


def spread_labels(edges: DataFrame) -> DataFrame:
    """For every end of an edge (``a``, ``b``) the smallest end it is connected with, as ``label``.

    Each round takes the smallest label of the neighbours, then the label of the label.
    """
    both = common.stage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("label"))
    labels = common.stage(labels.select("a", F.least("a", "label").alias("label")))
    while True:
        heard = both.join(labels.select(F.col("a").alias("b"), "label"), "b")
        heard = heard.groupBy("a").agg(F.min("label").alias("heard"))
        lower = common.stage(
            labels.join(heard, "a").select("a", F.least("label", "heard").alias("low"), "label")
        )
        jump = lower.select(F.col("a").alias("low"), F.col("low").alias("lowest"))
        labels = common.stage(lower.join(jump, "low").select("a", F.col("lowest").alias("label")))
        if lower.where("low <> label").limit(1).count() == 0:
            return labels


def components(
    docs: DataFrame, key: str = "doc_id", bits: int = BITS, shard_points: int = SHARD_POINTS
) -> DataFrame:
    """Append ``component`` to rows that have a fingerprint ``fp``.

    It is the smallest ``key`` among the documents reachable over links of at most ``bits``
    differing bits, the document itself included. Null keys count only where there is no other.
    ``docs`` is read several times and should be a stored table.
    """
    points = common.stage(docs.groupBy("fp").agg(F.min(key).alias("least")))
    edges = common.stage(links(points, points.count(), bits, shard_points))
    labels = spread_labels(edges).withColumnRenamed("a", "fp")
    named = points.join(labels, "fp", "left")
    named = common.stage(named.withColumn("label", F.coalesce("label", "fp")))
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    member = named.select("fp", "label").join(least, "label").select("fp", "component")
    return common.without(docs, ["component"]).join(common.stage(member), "fp")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest key.

    Of rows with equal keys one stays; a null key stays only where the group has no other. Rows
    come back as they were.
    """
    row = common.unused(docs, "_row")
    order = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), F.col(row).alias("row"))
    stored = common.stage(docs.withColumn(row, F.monotonically_increasing_id()))
    marked = fingerprints(stored.select(F.col(row), order.alias("_key"), F.col(text).alias("text")), "text")
    marked = common.stage(marked.drop("text"))
    kept = components(marked, "_key").where("component = _key").select(row)
    return stored.join(kept, row, "left_semi").drop(row)
