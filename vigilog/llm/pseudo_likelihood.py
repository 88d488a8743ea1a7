"""Language-model scoring by masked pseudo-likelihood.

A network predicts each word from the two words on either side: their vectors pass one hidden
layer, and the word's probability is that of its class times that of the word in its class. A
document's score is the sum of the logarithms over all its words.

Every word of all documents has a probability of its own. The network's places are the most
frequent words and hashed places that the others share; of a shared place's probability a word has
the share of its own count. The counts stay a table that documents are joined with, so the
vocabulary grows with the corpus.
Words fall into eight masks, and the rounds share the masks, so that every word of all documents is
a target once. In each round every task trains, from the common parameters, on all its documents; the results are averaged, weighed by words. Counts and parameters are summed by Spark
as whole numbers, so sums do not depend on their order, and what is gathered grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm import common

CLASSES = 32
VOCABULARY = CLASSES * CLASSES
#: Places of the vocabulary for words that are not in it.
SHARED = 32
DIM, HIDDEN = 8, 16
#: Offsets of the words that predict.
CONTEXT = (-2, -1, 1, 2)
#: Masks; each round trains on its share of them, all rounds on all.
MASK_EVERY = 8
ROUNDS = 2
#: So many of the most frequent words of shared places are looked up in tasks, only rarer ones joined.
CACHED = 1 << 17
#: Logarithms of counts are summed as whole numbers of this unit's parts.
_PARTS = 1 << 24
BATCH = 1024
RATE = 0.1
_BLOCK = 1 << 15
_FIXED = 1 << 16

_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_SHAPES = {
    "vectors": (VOCABULARY + 1, DIM),  # the last stands for "no word"
    "hidden": (len(CONTEXT) * DIM, HIDDEN),
    "hidden_bias": (HIDDEN,),
    "classes": (HIDDEN, CLASSES),
    "class_bias": (CLASSES,),
    "members": (HIDDEN, CLASSES),
    "member_bias": (CLASSES, CLASSES),
}
PARAMETERS = sum(int(np.prod(shape)) for shape in _SHAPES.values())


@dataclass(frozen=True)
class Model:
    """Sorted hashes of known words with their numbers, and all parameters as one vector.

    ``sizes`` are the occurrences and different words of each shared place, plus one for words never
    seen; ``cached`` and ``logs`` the sorted hashes of its frequent words with log(n + 1) in parts;
    ``words`` the table of all counts, on the driver only.
    """

    hashes: np.ndarray
    numbers: np.ndarray
    parameters: np.ndarray
    sizes: np.ndarray | None = None
    cached: np.ndarray | None = None
    logs: np.ndarray | None = None
    words: DataFrame | None = None

    def parts(self) -> dict[str, np.ndarray]:
        found, at = {}, 0
        for name, shape in _SHAPES.items():
            size = int(np.prod(shape))
            found[name] = self.parameters[at : at + size].reshape(shape)
            at += size
        return found


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and the place of each text's first word."""
    own = common.LOWER[data]
    inside = _IS_WORD[own]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(own))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]]) if len(cuts) else cuts
    starts = np.sort(np.concatenate((np.flatnonzero(edges == 1), cuts)))
    ends = np.sort(np.concatenate((np.flatnonzero(edges == -1), cuts)))
    return common.span_hashes(own, starts, ends), np.searchsorted(starts, offsets)


def numbers_of(model: Model, hashes: np.ndarray) -> np.ndarray:
    """The vocabulary's number of each word."""
    found = (hashes % np.uint64(SHARED)).astype(np.int64) + VOCABULARY - SHARED
    if len(model.hashes):
        at = np.minimum(np.searchsorted(model.hashes, hashes), len(model.hashes) - 1)
        known = model.hashes[at] == hashes
        found[known] = model.numbers[at[known]]
    return found


def contexts(numbers: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The numbers around each word of its own text; VOCABULARY where there is none."""
    gap = max(CONTEXT)
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    places = np.arange(len(numbers)) + gap * (owner + 1)
    padded = np.full(len(numbers) + gap * (len(firsts) + 1), VOCABULARY, np.int64)
    padded[places] = numbers
    return np.stack([padded[places + k] for k in CONTEXT], axis=1) if len(numbers) else np.zeros((0, 4), np.int64)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def log_probabilities(model: Model, numbers: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Logarithm of each word's probability given the words around it."""
    p = model.parts()
    # A word's share of the hidden layer depends on its offset alone, so it is looked up.
    steps = [p["vectors"] @ p["hidden"][k * DIM : (k + 1) * DIM] for k in range(len(CONTEXT))]
    found = np.empty(len(numbers))
    for first in range(0, len(numbers), _BLOCK):
        part = slice(first, first + _BLOCK)
        total = p["hidden_bias"] + steps[0][around[part, 0]]
        for k in range(1, len(CONTEXT)):
            total += steps[k][around[part, k]]
        hidden = np.tanh(total)
        group, member = np.divmod(numbers[part], CLASSES)
        rows = np.arange(len(group))
        found[part] = _log_softmax(hidden @ p["classes"] + p["class_bias"])[rows, group]
        found[part] += _log_softmax(hidden @ p["members"] + p["member_bias"][group])[rows, member]
    return found


def start_parameters(counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """Small random weights; biases give each word its share of ``counts``."""
    random = np.random.default_rng(seed)
    parts = {name: random.normal(0, 0.1, shape) for name, shape in _SHAPES.items()}
    parts["hidden"] *= 3
    share = (counts + 1.0).reshape(CLASSES, CLASSES)
    parts["hidden_bias"][:] = 0
    parts["class_bias"] = np.log(share.sum(axis=1) / share.sum())
    parts["member_bias"] = np.log(share / share.sum(axis=1, keepdims=True))
    return np.concatenate([parts[name].reshape(-1) for name in _SHAPES]).astype(np.float32)


def train_batch(model: Model, seen: np.ndarray, numbers: np.ndarray, around: np.ndarray) -> None:
    """One step of Adagrad in place; ``seen`` sums the squares of slopes so far."""
    p = model.parts()
    n = len(numbers)
    rows = np.arange(n)
    near = p["vectors"][around].reshape(n, -1)
    hidden = np.tanh(near @ p["hidden"] + p["hidden_bias"])
    group, member = np.divmod(numbers, CLASSES)
    first = np.exp(_log_softmax(hidden @ p["classes"] + p["class_bias"]))
    second = np.exp(_log_softmax(hidden @ p["members"] + p["member_bias"][group]))
    first[rows, group] -= 1
    second[rows, member] -= 1
    first /= n
    second /= n
    back = (first @ p["classes"].T + second @ p["members"].T) * (1 - hidden * hidden)
    slopes = Model(model.hashes, model.numbers, np.zeros_like(model.parameters))
    s = slopes.parts()
    np.add.at(s["vectors"], around.reshape(-1), (back @ p["hidden"].T).reshape(-1, DIM))
    s["hidden"] += near.T @ back
    s["hidden_bias"] += back.sum(axis=0)
    s["classes"] += hidden.T @ first
    s["class_bias"] += first.sum(axis=0)
    s["members"] += hidden.T @ second
    np.add.at(s["member_bias"], group, second)
    seen += slopes.parameters * slopes.parameters
    model.parameters[:] -= RATE * slopes.parameters / np.sqrt(seen)


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(``word``, ``n``): occurrences of each word, by its hash, in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.as_bytes(batch.column(0))
            parts = []
            for first, last in common.chunks(offsets):
                own = offsets[first : last + 1]
                parts.append(np.unique(word_hashes(data[own[0] : own[-1]], own - own[0])[0], return_counts=True))
            if parts:
                # Texts of one batch repeat words, so most rows go before the shuffle.
                found, where = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                sums = np.bincount(where, np.concatenate([n for _, n in parts]), len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(sums)], names=["word", "n"]
                )

    counted = docs.select(text).mapInArrow(count, "word bigint, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, seed: int = 3) -> Model:
    """Vocabulary and network from all documents; null texts are empty.

    Without words every word has the same probability.
    """
    words = common.stage(count_words(docs, text))
    places = VOCABULARY - SHARED
    top = words.orderBy(F.desc("n"), "word").limit(places + CACHED).toArrow()
    every, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    hashes = every[:places]
    order = np.argsort(hashes)
    shared = F.col("word").bitwiseAND(F.lit(SHARED - 1)).alias("place")
    held = words.groupBy(shared).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    own = (hashes % np.uint64(SHARED)).astype(np.int64)
    size, kinds = -np.bincount(own, n[:places], SHARED), -np.bincount(own, minlength=SHARED)
    size[held["place"].to_numpy()] += held["n"].to_numpy()
    kinds[held["place"].to_numpy()] += held["words"].to_numpy()
    counts = np.zeros(VOCABULARY)
    counts[: len(hashes)] = n[:places]
    counts[places:] = size
    more = np.argsort(every[places:])
    model = Model(
        hashes[order],
        order,
        start_parameters(counts, seed),
        size + kinds + 1,
        every[places:][more],
        np.round(np.log(n[places:][more] + 1.0) * _PARTS).astype(np.int64),
        words if len(every) == places + CACHED else None,
    )
    for k in range(rounds):
        model = _round(docs, model, k, min(rounds, MASK_EVERY), text)
    return model


def in_round(place: np.ndarray, hashes: np.ndarray, k: int, parts: int) -> np.ndarray:
    """Places of the words that round ``k`` trains on, when ``parts`` rounds share the masks."""
    mask = (place * 5 + (hashes >> np.uint64(60)).astype(np.int64)) % MASK_EVERY
    return np.flatnonzero(mask % parts == k % parts)


def _round(docs: DataFrame, model: Model, k: int, parts: int, text: str) -> Model:
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.hashes, model.numbers, model.parameters))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        own = replace(start, parameters=start.parameters.copy())
        seen, words = np.full(PARAMETERS, 1e-4, np.float32), 0
        for batch in batches:
            data, offsets = common.as_bytes(batch.column(0))
            for first, last in common.chunks(offsets):
                bounds = offsets[first : last + 1]
                hashes, firsts = word_hashes(data[bounds[0] : bounds[-1]], bounds - bounds[0])
                numbers = numbers_of(own, hashes)
                place = np.arange(len(numbers)) - np.repeat(firsts[:-1], np.diff(firsts))
                masked = in_round(place, hashes, k, parts)
                around = contexts(numbers, firsts)[masked]
                for at in range(0, len(masked), BATCH):
                    part = masked[at : at + BATCH]
                    train_batch(own, seen, numbers[part], around[at : at + BATCH])
                words += len(masked)
        if words:
            values = np.round(own.parameters.astype(np.float64) * words * _FIXED).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(-1, PARAMETERS, dtype=np.int32)),
                    pa.array(np.concatenate(([words], values))),
                ],
                names=["place", "value"],
            )

    found = docs.select(text).mapInArrow(learn, "place int, value bigint")
    sums = found.groupBy("place").agg(F.sum("value").alias("value")).toArrow().sort_by("place")
    values = sums["value"].to_numpy()
    if not len(values):
        return model
    mean = values[1:] / (values[0] * _FIXED)
    return replace(model, parameters=mean.astype(np.float32))


def own_shares(
    model: Model, numbers: np.ndarray, hashes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of shared places: where they are, log(n + 1) in parts less that of the place's size,
    and whether the count is still to be added, as the word is not cached."""
    at = np.flatnonzero(numbers >= VOCABULARY - SHARED)
    logs = -np.round(np.log(model.sizes) * _PARTS).astype(np.int64)[numbers[at] - (VOCABULARY - SHARED)]
    missing = np.ones(len(at), bool)
    if len(model.cached):
        places = np.minimum(np.searchsorted(model.cached, hashes[at]), len(model.cached) - 1)
        missing = model.cached[places] != hashes[at]
        logs += np.where(missing, 0, model.logs[places])
    return at, logs, missing


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Append ``n_words``, ``log_likelihood`` (the sum) and ``mean_log_likelihood``.

    A text without words, null or empty, has 0 words, a sum of 0 and a null mean. Columns of the
    input named like the new ones are replaced; ``keep_text`` false leaves out the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, words=None))
    joined = model.words is not None
    names = [f.name for f in _SCORES]
    kept = common.without(docs, names)
    row, rare = common.unused(kept, "_row"), common.unused(kept, "_rare")

    def compute(_: object, column: pa.Array) -> list[pa.Array]:
        own = shared.value
        data, offsets = common.as_bytes(column)
        words, sums = np.zeros(len(column), np.int64), np.zeros(len(column))
        rare_ends, rare_words, rare_times = [0], [], []
        for first, last in common.chunks(offsets):
            bounds = offsets[first : last + 1]
            hashes, firsts = word_hashes(data[bounds[0] : bounds[-1]], bounds - bounds[0])
            numbers = numbers_of(own, hashes)
            logs = log_probabilities(own, numbers, contexts(numbers, firsts))
            words[first:last] = np.diff(firsts)
            filled = np.flatnonzero(np.diff(firsts))
            if len(filled):
                sums[first + filled] = np.add.reduceat(logs, firsts[:-1][filled])
            if own.sizes is None:
                continue
            at, parts, missing = own_shares(own, numbers, hashes)
            owner = np.searchsorted(firsts, at, side="right") - 1
            totals = np.concatenate(([0], np.cumsum(parts)))
            ends = np.searchsorted(owner, np.arange(last - first + 1))
            sums[first:last] += (totals[ends[1:]] - totals[ends[:-1]]) / _PARTS
            if joined:
                # Words of a text once each, with how often.
                pairs = np.stack((owner[missing], hashes[at][missing].view(np.int64)), axis=1)
                pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
                new = np.ones(len(pairs), bool)
                new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
                starts = np.flatnonzero(new)
                rare_words.append(pairs[starts, 1])
                rare_times.append(np.diff(np.append(starts, len(pairs))))
                ends = np.searchsorted(pairs[starts, 0], np.arange(1, last - first + 1))
                rare_ends += (ends + rare_ends[-1]).tolist()
        mean = np.divide(sums, words, out=np.zeros(len(sums)), where=words > 0)
        made = [pa.array(words), pa.array(sums), pa.array(mean, mask=words == 0)]
        if joined:
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rare_words, rare_times)]
            entries = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in flat], ["word", "times"])
            made.append(pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), entries))
        return made

    if not joined:
        found = common.with_arrow_columns(docs, [text], _SCORES, compute)
        return found if keep_text else found.drop(text)
    fields = [*_SCORES, T.StructField(rare, _RARE, False)]
    marked = common.with_arrow_columns(kept.withColumn(row, F.monotonically_increasing_id()), [text], fields, compute)
    stored = common.stage(marked if keep_text else marked.drop(text))
    each = stored.select(row, F.explode(rare).alias("r")).select(row, "r.word", "r.times")
    counted = model.words.select("word", F.round(F.log(F.col("n") + 1.0) * _PARTS).cast("long").alias("log"))
    added = each.join(counted, "word").groupBy(row).agg(F.sum(F.col("times") * F.col("log")).alias("_added"))
    # Only texts with rare words are shuffled.
    apart = F.size(rare) == 0
    part = common.pack(stored.where(~apart).drop(rare), row)
    part = part.join(added, row, "left")
    total = F.col("row").getField("log_likelihood") + F.coalesce("_added", F.lit(0)) / F.lit(float(_PARTS))
    mean = total / F.col("row").getField("n_words")
    new = {"log_likelihood": total, "mean_log_likelihood": mean}
    columns = [c for c in stored.columns if c not in (row, rare)]
    part = part.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in columns])
    return stored.where(apart).select(*[f"`{c}`" for c in columns]).unionByName(part)


_SCORES = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("log_likelihood", T.DoubleType(), False),
    T.StructField("mean_log_likelihood", T.DoubleType(), True),
]
_RARE = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("times", T.LongType())]))
