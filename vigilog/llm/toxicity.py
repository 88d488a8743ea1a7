"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of the hashed vectors of the word and of its first 4 and 5 bytes, so
that inflected forms of a known stem are near it. Filters over 1, 2 and 3 neighbouring words are
max-pooled over the whole text and weighed by a logistic layer. All labelled rows are dealt to
shards by a hash of their key; in each round every shard trains on its rows from the same model, and
what the shards changed is averaged. The model is broadcast (its size is fixed). Scores and thresholds,
the general one and those by language, are calibrated on all labelled rows of one fold, counted by
Spark. Scores only ever see the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm import common

#: Bytes of labelled text that one shard trains on (a shard has at least one text, however long).
SHARD_BYTES = 1 << 24
BUCKETS = 1 << 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIXES = (4, 5)
#: Passes over the rows, and the fewest steps of BATCH texts (small shards take more passes).
EPOCHS = 5
LEAST_STEPS = 300
BATCH = 64
#: Places that filters look at in one go while training; a longer text is cut, with an overlap.
SLICE = 1 << 17
#: Changes of parameters are added as whole numbers of 1 / _FIXED, so that their order is of no account.
_FIXED = float(1 << 20)
#: Cells of equal width that the scores of a calibration are counted in before they are put in order.
CELLS = 4096
#: One in so many labelled rows is kept from a first model, to calibrate scores and thresholds.
CALIBRATION = 5

_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_SHIFTS = [(w, j) for w in WIDTHS for j in range(w)]


@dataclass
class ToxicityModel:
    """Parameters; ``filters`` has a slice of DIM x FILTERS for each width and offset."""

    embeddings: np.ndarray
    filters: np.ndarray  # DIM x (number of shifts x FILTERS)
    bias: np.ndarray  # number of widths x FILTERS
    weights: np.ndarray
    constant: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    thresholds: dict[str, float] = field(default_factory=dict)


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows of each word (one column for each hashed part), with blank places between.

    Every text is followed by as many blank places as the widest filter reaches over. Returned
    are the rows, where each text starts, and which places are blank.
    """
    own = common.LOWER[data]
    inside = _IS_WORD[own]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(own))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]]) if len(cuts) else cuts
    starts = np.sort(np.concatenate((np.flatnonzero(edges == 1), cuts)))
    ends = np.sort(np.concatenate((np.flatnonzero(edges == -1), cuts)))
    gap = max(WIDTHS) - 1
    before = np.searchsorted(starts, offsets)
    firsts = before + gap * np.arange(len(offsets))
    rows = np.full((int(firsts[-1]), 1 + len(PREFIXES)), BUCKETS, np.int32)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    places = np.arange(len(starts)) + gap * owner
    for k, size in enumerate((None, *PREFIXES)):
        stops = ends if size is None else np.minimum(starts + size, ends)
        hashed = common.span_hashes(own, starts, stops) + np.uint64(k * 0x51ED27)
        rows[places, k] = (hashed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)
    blank = np.ones(len(rows), bool)
    blank[places] = False
    return rows, firsts, blank


def _vectors(model: ToxicityModel, rows: np.ndarray) -> np.ndarray:
    found = model.embeddings[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        found += model.embeddings[rows[:, k]]
    return found


def _convolve(model: ToxicityModel, vectors: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Filter outputs at each place (0 at blank places, which also cuts off negative maxima)."""
    parts = vectors @ model.filters
    out = np.repeat(model.bias.reshape(1, -1), len(vectors), axis=0)
    for s, (width, j) in enumerate(_SHIFTS):
        k = WIDTHS.index(width) * FILTERS
        n = len(vectors) - j
        out[:n, k : k + FILTERS] += parts[j:, s * FILTERS : (s + 1) * FILTERS]
    out[blank] = 0
    return out


def logits(model: ToxicityModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows, firsts, blank = word_rows(data, offsets)
    out = _convolve(model, _vectors(model, rows), blank)
    return np.maximum.reduceat(out, firsts[:-1], axis=0) @ model.weights + model.constant


def calibrated(model: ToxicityModel, raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * raw + model.shift, -60, 60)))


def new_model(seed: int = 7) -> ToxicityModel:
    """Filters are random; word vectors are zero, so that words never trained on say nothing."""
    random = np.random.default_rng(seed)
    return ToxicityModel(
        np.zeros((BUCKETS + 1, DIM), np.float32),
        random.normal(0, 0.5, (DIM, len(_SHIFTS) * FILTERS)).astype(np.float32),
        np.full((len(WIDTHS), FILTERS), 0.01, np.float32),
        random.normal(0, 0.5, len(WIDTHS) * FILTERS).astype(np.float32),
    )


class _Adagrad:
    def __init__(self, shape: tuple[int, ...], rate: float) -> None:
        self.seen, self.rate = np.full(shape, 1e-2, np.float32), rate

    def step(self, values: np.ndarray, slope: np.ndarray, at: object = ...) -> None:
        self.seen[at] += slope * slope
        values[at] -= self.rate * slope / np.sqrt(self.seen[at])


def _pooled(model: ToxicityModel, known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The greatest output of each filter in each text, and the first place in the text that has it."""
    top = np.empty((len(known), len(WIDTHS) * FILTERS), np.float32)
    best = np.zeros(top.shape, np.int64)
    first = 0
    while first < len(known):
        last, size = first + 1, len(known[first])
        while last < len(known) and size + len(known[last]) <= SLICE:
            size += len(known[last])
            last += 1
        rows = np.concatenate(known[first:last])
        ends = np.cumsum([len(r) for r in known[first:last]]).tolist()
        for at in range(0, max(size, 1), SLICE):
            # Only a text that stands alone has more than one slice.
            own = rows[at : at + SLICE + max(WIDTHS) - 1]
            out = _convolve(model, _vectors(model, own), own[:, 0] == BUCKETS)[:SLICE]
            bounds = [0, *ends] if last - first > 1 else [0, len(out)]
            places = np.array([a + out[a:b].argmax(axis=0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            found = np.take_along_axis(out, places, axis=0)
            places += at - np.array(bounds[:-1])[:, None]
            more = found > top[first:last] if at else np.ones(found.shape, bool)
            top[first:last][more], best[first:last][more] = found[more], places[more]
        first = last
    return top, best


def fit(
    model: ToxicityModel, known: list[np.ndarray], labels: np.ndarray, weights: tuple[float, float], epochs: int, seed: object
) -> None:
    """Train in place on the word rows of texts with labels 0 and 1; ``weights`` are those of the labels."""
    random = np.random.default_rng(seed)
    weight = np.where(labels == 1, weights[1], weights[0]).astype(np.float32)
    rates = {
        "embeddings": _Adagrad(model.embeddings.shape, 0.15),
        "filters": _Adagrad(model.filters.shape, 0.05),
        "bias": _Adagrad((len(WIDTHS) * FILTERS,), 0.02),
        "weights": _Adagrad(model.weights.shape, 0.05),
        "constant": _Adagrad((1,), 0.05),
    }
    constant = np.array([model.constant], np.float32)
    for _ in range(epochs):
        order = random.permutation(len(known))
        for first in range(0, len(order), BATCH):
            chosen = order[first : first + BATCH]
            own = [known[i] for i in chosen]
            firsts = np.concatenate(([0], np.cumsum([len(r) for r in own])))
            top, best = _pooled(model, own)
            rows = np.concatenate(own)
            best += firsts[:-1, None]
            wrong = 1 / (1 + np.exp(-np.clip(top @ model.weights + constant[0], -60, 60)))
            wrong = ((wrong - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            back = wrong[:, None] * model.weights * (top > 0)
            slopes = np.zeros_like(model.filters)
            touched, pulls = [], []
            for s, (width, j) in enumerate(_SHIFTS):
                k = WIDTHS.index(width) * FILTERS
                part = slice(s * FILTERS, (s + 1) * FILTERS)
                places = np.minimum(best[:, k : k + FILTERS] + j, len(rows) - 1)
                near = rows[places]
                share = back[:, k : k + FILTERS] * (near[:, :, 0] != BUCKETS)
                vectors = _vectors(model, near.reshape(-1, near.shape[2])).reshape(*places.shape, DIM)
                slopes[:, part] = np.einsum("bf,bfd->df", share, vectors)
                pull = share[:, :, None] * model.filters[:, part].T[None]
                used = np.nonzero(share)
                touched.append(near[used])
                pulls.append(pull[used])
            rates["filters"].step(model.filters, slopes)
            rates["bias"].step(model.bias.reshape(-1), back.sum(axis=0))
            rates["weights"].step(model.weights, top.T @ wrong)
            rates["constant"].step(constant, np.array([wrong.sum()]))
            found, where = np.unique(np.concatenate(touched), return_inverse=True)
            sums = np.zeros((len(found), DIM), np.float32)
            pulled = np.concatenate(pulls)
            for part in where.reshape(len(pulled), 1 + len(PREFIXES)).T:
                np.add.at(sums, part, pulled)
            rates["embeddings"].step(model.embeddings, sums, found)
    model.constant = float(constant[0])


def _small(model: ToxicityModel) -> np.ndarray:
    """All parameters but the embeddings, in rows of DIM."""
    parts = [model.filters.reshape(-1), model.bias.reshape(-1), model.weights, [model.constant]]
    flat = np.concatenate([np.asarray(p, np.float32) for p in parts])
    return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)


def _with_small(model: ToxicityModel, rows: np.ndarray) -> ToxicityModel:
    flat, made = rows.reshape(-1).astype(np.float32), {}
    for name in ("filters", "bias", "weights"):
        old = getattr(model, name)
        made[name], flat = flat[: old.size].reshape(old.shape).copy(), flat[old.size :]
    return replace(model, **made, constant=float(flat[0]))


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """Number, word rows and labels of each shard, whose rows come one after another."""
    at, known, labels = None, [], []
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("_shard", "_label", "_rows")]
        for shard, label, rows in zip(*columns, strict=True):
            if shard != at and known:
                yield at, known, np.array(labels)
                known, labels = [], []
            at = shard
            known.append(np.frombuffer(rows, np.int32).reshape(-1, 1 + len(PREFIXES)))
            labels.append(label)
    if known:
        yield at, known, np.array(labels)


def _round(rows: DataFrame, model: ToxicityModel, weights: tuple[float, float], epochs: int, seed: list[int]) -> ToxicityModel:
    """Each shard trains from the model; a parameter moves by the mean over the shards that moved it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        for shard, known, labels in _by_shard(batches):
            own = _with_small(replace(start, embeddings=start.embeddings.copy()), _small(start))
            fit(own, known, labels, weights, epochs, [*seed, shard])
            moved = np.concatenate((own.embeddings - start.embeddings, _small(own) - _small(start)))
            moved = np.round(moved.astype(np.float64) * _FIXED).astype(np.int32)
            places = np.flatnonzero(moved.any(axis=1))
            columns = [places.astype(np.int32), *moved[places].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    moves = [f"m{k}" for k in range(DIM)]
    names = ["place", *moves]
    found = rows.select("_shard", "_label", "_rows").mapInArrow(learn, ", ".join(f"{n} int" for n in names))
    sums = found.groupBy("place").agg(F.count("*").alias("n"), *[F.sum(m).alias(m) for m in moves]).toArrow()
    shared.unpersist()
    every = np.concatenate((model.embeddings, _small(model)))
    mean = np.stack([sums[m].to_numpy() for m in moves], axis=1) / (sums["n"].to_numpy()[:, None] * _FIXED)
    every[sums["place"].to_numpy()] += mean.astype(np.float32)
    return _with_small(replace(model, embeddings=every[: BUCKETS + 1]), every[BUCKETS + 1 :])


def _fitted(rows: DataFrame, totals: tuple[int, int], shards: int, seed: int) -> ToxicityModel:
    """A model of all rows, each class weighing the same; one shard takes all its passes at once."""
    weights = tuple(0.5 * sum(totals) / n for n in totals)
    batches = -(-sum(totals) // (shards * BATCH))
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    rounds = EPOCHS if shards > 1 else 1
    model = new_model(seed)
    for k in range(rounds):
        model = _round(rows, model, weights, -(-epochs // rounds), [seed, k])
    return model


def _raw_scores(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """``raw, y, lang``: logit, label and language of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            known = [np.frombuffer(r, np.int32).reshape(-1, 1 + len(PREFIXES)) for r in batch.column("_rows").to_pylist()]
            if known:
                raw = (_pooled(own, known)[0] @ own.weights + own.constant).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(raw), batch.column("_label"), batch.column("lang")], names=["raw", "y", "lang"]
                )

    return rows.select("_rows", "_label", "lang").mapInArrow(compute, "raw double, y int, lang string")


def _calibrate(model: ToxicityModel, scored: DataFrame) -> None:
    """Logistic regression of the label on the logit, by Newton steps whose sums are over all rows."""
    means = [F.avg(F.when(F.col("y") == y, F.col("raw"))) for y in (0, 1)]
    middle, spread, *centres = scored.agg(F.avg("raw"), F.stddev_pop("raw") + 1e-6, *means).first()
    x = (F.col("raw") - middle) / spread
    # A row of either label at the mean of each label keeps a perfect separation from infinite slopes.
    own_x, own_y = (np.array([*centres, *centres]) - middle) / spread, np.array([0, 0, 1, 1])
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + F.exp(-F.least(F.greatest(a * x + b, F.lit(-40.0)), F.lit(40.0))))
        terms = scored.select(x.alias("x"), (p - F.col("y")).alias("e"), (p * (1 - p) + 1e-9).alias("q"))
        sums = terms.agg(
            F.sum(F.expr("e * x")), F.sum("e"), F.sum(F.expr("q * x * x")), F.sum(F.expr("q * x")), F.sum("q")
        ).first()
        own = 1 / (1 + np.exp(-np.clip(a * own_x + b, -40, 40)))
        e, q = 0.05 * (own - own_y), 0.05 * own * (1 - own) + 1e-9
        ex, e1, qxx, qx, q1 = np.array(sums) + [(e * own_x).sum(), e.sum(), (q * own_x**2).sum(), (q * own_x).sum(), q.sum()]
        curve = np.array([[qxx + 1e-3, qx], [qx, q1 + 1e-6]])
        step = np.clip(np.linalg.solve(curve, np.array([ex + 1e-3 * a, e1])), -1, 1)
        a, b = max(a - step[0], 1e-3), b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(a / spread), float(b - a * middle / spread)


def cuts(scored: DataFrame) -> DataFrame:
    """``every, lang, raw, below``: the last logit to be flagged for the greatest F1, and the next one.

    One row is over all (``every``), one over each language with both labels; ties go to the greater
    logit. Logits are counted in cells first, so that no task needs more than those of one cell.
    """
    group = ["every", "lang"]
    kinds = F.array(
        F.struct(F.lit(True).alias("every"), F.lit("").alias("lang")),
        F.struct(F.lit(False).alias("every"), F.coalesce("lang", F.lit("")).alias("lang")),
    )
    each = scored.select("raw", "y", F.explode(kinds).alias("g")).groupBy("g.every", "g.lang", "raw")
    each = common.stage(each.agg(F.count("*").alias("n"), F.sum("y").alias("hits")))
    totals = each.groupBy(group).agg(
        F.min("raw").alias("_least"), F.max("raw").alias("_most"), F.sum("hits").alias("_hits"), F.sum("n").alias("_n")
    )
    share = F.try_divide(F.col("raw") - F.col("_least"), F.col("_most") - F.col("_least"))
    cell = F.coalesce(F.floor(share * CELLS), F.lit(0)).alias("cell")
    both = F.broadcast(totals.where("_hits > 0 and _hits < _n"))
    each = each.join(both, group).select(*group, "raw", "n", "hits", "_hits", cell)
    cells = each.groupBy(*group, "cell").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.max("raw").alias("raw"))
    down = Window.partitionBy(group).orderBy(F.desc("cell"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *group, "cell", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_taken"),
        F.coalesce(F.sum("hits").over(above), F.lit(0)).alias("_caught"), F.lead("raw").over(down).alias("_below"),
    )
    inside = Window.partitionBy(*group, "cell").orderBy(F.desc("raw"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    caught, taken = F.sum("hits").over(upto) + F.col("_caught"), F.sum("n").over(upto) + F.col("_taken")
    found = each.join(F.broadcast(cells), [*group, "cell"]).select(
        *group, "raw", (2 * caught / (taken + F.col("_hits"))).alias("f1"),
        F.coalesce(F.lead("raw").over(inside), "_below").alias("below"),
    )
    best = found.groupBy(group).agg(F.max(F.struct("f1", "raw", "below")).alias("b"))
    return best.select(*group, "b.raw", "b.below")


def best_threshold(scores: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float | None:
    """The threshold of the greatest F1 (midway between two scores); None without both labels.

    For scores in memory; :func:`cuts` finds it among any number of rows.
    """
    order = np.argsort(-scores, kind="stable")
    s, y, w = scores[order], labels[order], weight[order]
    if not 0 < y.sum() < len(y):
        return None
    hits, taken = np.cumsum(y * w), np.cumsum(w)
    f1 = 2 * hits / (taken + (y * w).sum())
    last = np.append(s[1:] < s[:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    lang: str = "lang",
    shard_bytes: int = SHARD_BYTES,
    seed: int = 7,
) -> ToxicityModel:
    """Fit on all labelled documents, in shards of about ``shard_bytes`` of text.

    Null labels and keys are left out; a key labelled twice takes the greater label, a document
    listed twice the lesser text; a null text is empty. Without both classes every score is the
    share of label 1 (0.5 without labels).
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    marked = common.stage(marked.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label")))
    # Only these columns, so that no other column of the documents can bear a name used here.
    language = F.col(lang) if lang in docs.columns else F.lit(None)
    slim = docs.select(
        F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("text"), language.cast("string").alias("lang")
    )
    labelled = slim.join(marked, "_key")
    size = labelled.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    rows = _known(labelled, shards, seed)
    counts = {(r["_held"], r["_label"]): r["count"] for r in rows.groupBy("_held", "_label").count().collect()}
    part = tuple(counts.get((False, y), 0) for y in (0, 1))
    fold = tuple(counts.get((True, y), 0) for y in (0, 1))
    totals = (part[0] + fold[0], part[1] + fold[1])
    if not all(totals):
        model = new_model(seed)
        of = {r["_label"]: r["count"] for r in marked.groupBy("_label").count().collect()}
        share = of.get(1, 0) / sum(of.values()) if of else 0.5
        model.weights[:] = 0
        model.constant = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        return model
    # Calibrated on rows the first model has not seen; the one that is used has seen all.
    apart = all(part) and all(fold)
    first = _fitted(rows.where(~F.col("_held")), part, shards, seed) if apart else None
    model = _fitted(rows, totals, shards, seed)
    held = rows.where("_held") if all(fold) else rows
    scored = common.stage(_raw_scores(held, first or model))
    _calibrate(model, scored)
    found = cuts(scored).toArrow().to_pylist()

    def between(cut: dict) -> float:
        two = calibrated(model, np.array([cut["raw"], cut["raw"] if cut["below"] is None else cut["below"]]))
        return float((two[0] + (0.0 if cut["below"] is None else two[1])) / 2)

    for cut in found:
        if cut["every"] and 0 < (best := between(cut)) < 1:
            # A score of 0.5 is where the greatest F1 is, so the general threshold.
            model.shift -= float(np.log(best / (1 - best)))
    model.thresholds = {cut["lang"]: between(cut) for cut in sorted(found, key=lambda c: c["lang"]) if not cut["every"]}
    return model


def _known(labelled: DataFrame, shards: int, seed: int) -> DataFrame:
    """Word rows of each key's lesser text, stored in one file for each shard, in order of keys."""
    spread = F.xxhash64("_key", F.lit(seed))
    dealt = labelled.select(
        F.pmod(spread, F.lit(shards)).cast("int").alias("_shard"),
        (F.pmod(F.xxhash64("_key", F.lit(seed + 1)), F.lit(CALIBRATION)) == 0).alias("_held"),
        "_key", "text", "lang", "_label",
    )
    dealt = dealt.repartitionById(shards, "_shard").sortWithinPartitions("_shard", "_key", "text", "lang")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = None
        for batch in batches:
            keys = batch.column("_key").to_pylist()
            new = [k != before for k, before in zip(keys, [last_key, *keys[:-1]], strict=True)]
            last_key = keys[-1] if keys else last_key
            batch = batch.filter(pa.array(new, pa.bool_()))
            data, offsets = common.as_bytes(batch.column("text"))
            for first, last in common.chunks(offsets):
                own = offsets[first : last + 1]
                rows, firsts, _ = word_rows(data[own[0] : own[-1]], own - own[0])
                part = batch.slice(first, last - first)
                column = pa.array([rows[a:b].tobytes() for a, b in zip(firsts[:-1], firsts[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], column], names=[*names, "_rows"])

    names = ["_shard", "_held", "lang", "_label"]
    return common.stage(dealt.mapInArrow(hashed, "_shard int, _held boolean, lang string, _label int, _rows binary"))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", lang: str = "lang") -> DataFrame:
    """Append ``toxic_score`` (0 to 1, from the text alone) and ``toxic_flag``.

    The flag compares the score with the threshold of the row's language, or the general one.
    Null and empty texts are scored as texts without words. Columns of the input named like the
    new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(_: object, column: pa.Array) -> list[pa.Array]:
        data, offsets = common.as_bytes(column)
        return [pa.array(np.concatenate([np.zeros(0), *_scores(shared.value, data, offsets)]))]

    made = [T.StructField("toxic_score", T.DoubleType(), False)]
    found = common.with_arrow_columns(common.without(docs, ["toxic_flag"]), [text], made, compute)
    limit = F.lit(model.threshold)
    if lang in docs.columns:
        for name, value in model.thresholds.items():
            limit = F.when(F.coalesce(lang, F.lit("")) == name, value).otherwise(limit)
    return found.withColumn("toxic_flag", F.col("toxic_score") >= limit)


def _scores(model: ToxicityModel, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    for first, last in common.chunks(offsets):
        own = offsets[first : last + 1]
        raw = logits(model, data[own[0] : own[-1]], own - own[0])
        yield calibrated(model, raw.astype(np.float64))
