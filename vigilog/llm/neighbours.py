"""Approximate nearest neighbours by largest inner product: a small-world graph for each shard.

Equal vectors are one point (with its smallest ids), so that a group of copies costs nothing and
loses nothing. Points are dealt by hash to shards of bounded size; each shard builds a hierarchical
navigable small-world graph, kept as flat arrays of neighbours. Blocks of queries visit every
shard, and Spark merges the shards' results. A coordinate is added to the points so that all have
the same length; then the largest inner product is the nearest point, and the graph is sound.

Searches run in lockstep: all queries of a block advance together as numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilog.llm import common

#: Points of a shard, and queries of a block.
SHARD_POINTS = 4096
BLOCK_QUERIES = 512
#: Neighbours chosen for a new point, the most a point of the lowest layer keeps, and beam widths.
LINKS = 16
MOST_LINKS = 32
BUILD_BEAM = 64
SEARCH_BEAM = 96
#: Points whose neighbours are looked up at each step of a search.
STEP = 4
_BATCH = 256


@dataclass
class Layer:
    """A graph over ``nodes`` (places of points); ``neighbours`` are places in ``nodes`` or -1."""

    nodes: np.ndarray
    neighbours: np.ndarray


def _beam_search(
    points: np.ndarray, layer: Layer, queries: np.ndarray, entries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places in the layer and inner products of the nearest found, nearest first (-1: none)."""
    n, rows = len(layer.nodes), len(queries)
    ids = np.full((rows, beam), -1, np.int64)
    scores = np.full((rows, beam), -np.inf, np.float32)
    fresh = np.zeros((rows, beam), bool)
    visited = np.zeros((rows, n + 1), bool)
    visited[:, n] = True  # stands for "no neighbour"
    ids[:, 0], fresh[:, 0] = entries, True
    scores[:, 0] = np.einsum("qd,qd->q", queries, points[layer.nodes[entries]])
    visited[np.arange(rows), entries] = True
    step = min(STEP, beam)
    active = np.arange(rows)
    while len(active):
        known, value, new = ids[active], scores[active], fresh[active]
        # The beam is sorted, so the first fresh places are the best.
        rank = np.cumsum(new, axis=1)
        at = np.argsort(~(new & (rank <= step)), axis=1, kind="stable")[:, :step]
        picked = np.take_along_axis(new, at, axis=1)
        bases = np.where(picked, np.take_along_axis(known, at, axis=1), -1)
        np.put_along_axis(new, at, False, axis=1)
        links = []
        for k in range(step):
            own = layer.neighbours[bases[:, k]]
            own = np.where((own >= 0) & (bases[:, k : k + 1] >= 0), own, n)
            seen = visited[active[:, None], own]
            visited[active[:, None], own] = True
            links.append(np.where(seen, n, own))
        link = np.concatenate(links, axis=1)
        where = np.nonzero(link < n)
        fits = np.full(link.shape, -np.inf, np.float32)
        there = points[layer.nodes[link[where]]]
        fits[where] = np.einsum("xd,xd->x", there, queries[active[where[0]]])
        known = np.concatenate((known, link), axis=1)
        value = np.concatenate((value, fits), axis=1)
        new = np.concatenate((new, link < n), axis=1)
        best = np.argsort(-value, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(known, best, axis=1)
        scores[active] = value = np.take_along_axis(value, best, axis=1)
        fresh[active] = new = np.take_along_axis(new, best, axis=1) & (value > -np.inf)
        active = active[new.any(axis=1)]
    ids[scores == -np.inf] = -1
    return ids, scores


def _diverse(fits: np.ndarray, pairs: np.ndarray, keep: int) -> np.ndarray:
    """Which candidates (nearest first, -inf: none) to link, at most ``keep`` in each row.

    A candidate that is nearer to one already chosen than to the point itself comes last.
    """
    rows, n = fits.shape
    chosen = np.zeros((rows, n), bool)
    for c in range(n):
        covered = ((pairs[:, c, :] > fits[:, c : c + 1]) & chosen).any(axis=1)
        chosen[:, c] = ~covered & (fits[:, c] > -np.inf) & (chosen.sum(axis=1) < keep)
    order = np.argsort(~chosen, axis=1, kind="stable")[:, :keep]
    return np.where(np.take_along_axis(fits, order, axis=1) > -np.inf, order, -1)


def _pick(points: np.ndarray, nodes: np.ndarray, at: np.ndarray, candidates: np.ndarray, keep: int) -> np.ndarray:
    """The links of the nodes ``at`` out of ``candidates`` (places, -1: none; no repeats)."""
    there = points[nodes[candidates]]
    fits = np.einsum("acd,ad->ac", there, points[nodes[at]])
    fits[(candidates < 0) | (candidates == at[:, None])] = -np.inf
    order = np.argsort(-fits, axis=1, kind="stable")
    fits, candidates = np.take_along_axis(fits, order, axis=1), np.take_along_axis(candidates, order, axis=1)
    there = np.take_along_axis(there, order[:, :, None], axis=1)
    chosen = _diverse(fits, there @ there.transpose(0, 2, 1), keep)
    return np.where(chosen >= 0, np.take_along_axis(candidates, chosen, axis=1), -1)


def _build_layer(points: np.ndarray, nodes: np.ndarray, upper: list[Layer], most: int) -> Layer:
    """Insert ``nodes`` in their order, those of the layer above first."""
    n = len(nodes)
    layer = Layer(nodes, np.full((n + 1, most), -1, np.int64))
    links = min(LINKS, most)
    done = min(n, BUILD_BEAM)
    first = np.arange(done)
    chosen = _pick(points, nodes, first, np.tile(first, (done, 1)), links)
    layer.neighbours[:done, : chosen.shape[1]] = chosen
    _link_back(points, layer, first, chosen, most)
    above = len(upper[-1].nodes) if upper else 0
    while done < n:
        new = np.arange(done, min(n, done + min(_BATCH, done), above if done < above else n))
        queries = points[nodes[new]]
        entries = _descend(points, upper, queries) if done >= above and upper else np.zeros(len(new), np.int64)
        found, _ = _beam_search(points, layer, queries, entries, BUILD_BEAM)
        near = np.argsort(-(queries @ queries.T), axis=1, kind="stable")[:, : links + 1]
        candidates = np.concatenate((found, new[near]), axis=1)
        chosen = _pick(points, nodes, new, candidates, links)
        layer.neighbours[new, : chosen.shape[1]] = chosen
        _link_back(points, layer, new, chosen, most)
        done = int(new[-1]) + 1
    layer.neighbours = layer.neighbours[:n]
    return layer


def _link_back(points: np.ndarray, layer: Layer, new: np.ndarray, chosen: np.ndarray, most: int) -> None:
    """Add the reverse of each new link; a node with too many keeps a diverse choice."""
    source = np.repeat(new, chosen.shape[1])[chosen.reshape(-1) >= 0]
    target = chosen.reshape(-1)[chosen.reshape(-1) >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    at, firsts, counts = np.unique(target, return_index=True, return_counts=True)
    added = np.full((len(at), int(counts.max(initial=1))), -1, np.int64)
    added[np.repeat(np.arange(len(at)), counts), np.arange(len(target)) - np.repeat(firsts, counts)] = source
    had = layer.neighbours[at]
    added[(added[:, :, None] == had[:, None, :]).any(axis=2)] = -1
    every = np.concatenate((had, added), axis=1)
    fits = (every >= 0).sum(axis=1) <= most
    packed = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable"), axis=1)[:, :most]
    layer.neighbours[at[fits]] = packed[fits]
    for first in range(0, int((~fits).sum()), _BATCH):
        part = np.flatnonzero(~fits)[first : first + _BATCH]
        kept = _pick(points, layer.nodes, at[part], every[part], most)
        layer.neighbours[at[part]] = -1
        layer.neighbours[at[part], : kept.shape[1]] = kept


def _descend(points: np.ndarray, upper: list[Layer], queries: np.ndarray) -> np.ndarray:
    """Entry of each query into the layer below: nodes of a layer are the first of the next."""
    at = np.zeros(len(queries), np.int64)
    for layer in upper:
        found, _ = _beam_search(points, layer, queries, at, 1)
        at = found[:, 0]
    return at


def same_length(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one coordinate more that makes all as long as the longest."""
    squares = np.einsum("nd,nd->n", vectors, vectors)
    rest = np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))
    return np.concatenate((vectors, rest[:, None]), axis=1).astype(np.float32)


def build_graph(vectors: np.ndarray, seed: int = 11) -> list[Layer]:
    """Layers from the top one to the lowest, which has all points."""
    points = same_length(vectors)
    random = np.random.default_rng(seed)
    order = random.permutation(len(points))
    layers: list[Layer] = []
    sizes = [len(points)]
    while sizes[-1] > LINKS * 2:
        sizes.append(sizes[-1] // LINKS)
    for size in reversed(sizes):
        most = MOST_LINKS if size == len(points) else LINKS
        layers.append(_build_layer(points, order[:size], layers, most))
    return layers


def search_graph(vectors: np.ndarray, layers: list[Layer], queries: np.ndarray, beam: int) -> np.ndarray:
    """Places of the points found nearest to each query, nearest first (-1: none)."""
    points = same_length(vectors)
    padded = np.concatenate((queries, np.zeros((len(queries), 1))), axis=1).astype(np.float32)
    found = []
    for first in range(0, len(padded), _BATCH):
        part = padded[first : first + _BATCH]
        places, _ = _beam_search(points, layers[-1], part, _descend(points, layers[:-1], part), beam)
        found.append(np.where(places >= 0, layers[-1].nodes[places], -1))
    return np.concatenate(found) if found else np.zeros((0, beam), np.int64)


_INDEX = (
    "dim int, shard int, vectors binary, ids array<array<bigint>>, "
    "layers array<struct<size: int, most: int, nodes: binary, neighbours: binary>>"
)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _index_shard(key: tuple, rows: pa.Table) -> pa.Table:
    dim, shard = key[0].as_py(), key[1].as_py()
    vectors = _matrix(rows["vector"], dim)
    layers = [
        {
            "size": len(layer.nodes),
            "most": layer.neighbours.shape[1],
            "nodes": layer.nodes.astype(np.int32).tobytes(),
            "neighbours": layer.neighbours.astype(np.int32).tobytes(),
        }
        for layer in build_graph(vectors)
    ]
    layer = pa.struct(
        [("size", pa.int32()), ("most", pa.int32()), ("nodes", pa.binary()), ("neighbours", pa.binary())]
    )
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "shard": pa.array([shard], pa.int32()),
            "vectors": pa.array([vectors.tobytes()], pa.binary()),
            "ids": pa.array([rows["ids"].to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "layers": pa.array([layers], pa.list_(layer)),
        }
    )


def usable(vector: str) -> Column:
    """Not null or zero, and without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def build_index(
    rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", shard_points: int = SHARD_POINTS
) -> DataFrame:
    """A stored table with one row for each shard: its vectors, ids and graph.

    Every usable row with a key is indexed. Of equal vectors the ``k`` + 1 smallest keys are kept,
    which are all that a search for ``k`` can return. Rows with equal key and vector count once.
    Vectors of different sizes have separate shards. No rows give an index without shards.
    """
    good = rows.where(usable(vector) & F.col(key).isNotNull())
    good = good.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    distinct = good.groupBy("vector", "id").agg(F.lit(1).alias("one"))
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    least = distinct.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    points = least.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = common.stage(points.withColumn("dim", F.size("vector")))
    sizes = points.groupBy("dim").agg(F.count("*").alias("n"))
    shards = F.ceil(F.col("n") / F.lit(shard_points)).cast("long")
    dealt = points.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), shards).cast("int"))
    return common.stage(dealt.groupBy("dim", "shard").applyInArrow(_index_shard, _INDEX))


def search(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    key: str = "vec_id",
    vector: str = "embedding",
    beam: int = SEARCH_BEAM,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """For each query the ``k`` nearest found: query_id, rank (from 1), vec_id, score.

    A query never finds its own key; ties go to the smaller key; scores are inner products in
    double precision. Queries that are not usable or have no key take no part.
    """
    good = queries.where(usable(vector) & F.col(key).isNotNull())
    good = good.select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("q"))
    good = good.dropDuplicates(["query_id"])
    blocks = max(1, -(-good.count() // block_queries))
    good = good.withColumn("dim", F.size("q")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))

    def pack(key_: tuple, rows: pa.Table) -> pa.Table:
        dim = key_[0].as_py()
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()),
                "query_ids": pa.array([rows["query_id"].to_numpy().tobytes()], pa.binary()),
                "qs": pa.array([_matrix(rows["q"], dim).tobytes()], pa.binary()),
            }
        )

    packed = good.groupBy("dim", "block").applyInArrow(pack, "dim int, query_ids binary, qs binary")
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    visits = packed.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), "last"))).drop("last")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _visit({name: batch.column(name)[i].as_py() for name in batch.schema.names}, k, beam)

    found = visits.join(index, ["dim", "shard"]).mapInArrow(visit, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _visit(row: dict, k: int, beam: int) -> pa.RecordBatch:
    """The ``k`` nearest of each query of a block in one shard."""
    dim = row["dim"]
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
    queries = np.frombuffer(row["qs"], np.float64).reshape(-1, dim)
    layers = [
        Layer(
            np.frombuffer(x["nodes"], np.int32).astype(np.int64),
            np.frombuffer(x["neighbours"], np.int32).astype(np.int64).reshape(x["size"], x["most"]),
        )
        for x in row["layers"]
    ]
    places = search_graph(vectors, layers, queries, min(beam, len(vectors)))
    counts = np.array([len(x) for x in row["ids"]])
    firsts, flat = np.cumsum(counts) - counts, np.concatenate(row["ids"]).astype(np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for query, own, near in zip(np.frombuffer(row["query_ids"], np.int64), queries, places, strict=True):
        near = near[near >= 0]
        scores = np.array([(vectors[p] * own).sum() for p in near])
        n = counts[near]
        ids = flat[np.repeat(firsts[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        scores = np.repeat(scores, n)
        scores, ids = scores[ids != query], ids[ids != query]
        best = np.lexsort((ids, -scores))[:k]
        out.append((np.full(len(best), query), ids[best], scores[best]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "vec_id", "score"])
