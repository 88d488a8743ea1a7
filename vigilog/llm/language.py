"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of all labelled texts in one pass; every task sends its non-zero
counts, which Spark sums. The matrix of log probabilities (buckets x languages, a few MB) is
broadcast, and each batch of texts is scored as a sparse matrix of n-grams times that matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilog.llm import common

BUCKETS = 1 << 16
#: Languages a model may have; labels are a stated set, not data that grows.
MAX_LANGUAGES = 256
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order of their names, and the logarithms of prior and conditional shares."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # languages x buckets


def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _letters[0]


def ngrams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For pairs and for triples of characters: their buckets, and how many each text has.

    Texts are lower-cased and anything but letters is one blank. An n-gram lies within a word and
    the blanks around it, so none spans two words or texts.
    """
    lowered = [text.lower() for text in texts]
    codes = np.frombuffer(f" {' '.join(lowered)} ".encode("utf-32-le"), np.uint32)
    starts = np.ones(len(texts) + 1, np.int64)
    starts[1:] += np.cumsum([len(text) + 1 for text in lowered])
    letters = letter_table()[codes]
    codes = np.where(letters, codes, np.uint32(32))
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # one blank after each word
    keep[0] = True
    places = np.concatenate(([0], np.cumsum(keep)))[starts]
    codes = codes[keep]
    blank = codes == 32
    mixed = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA6B)
    owner = np.arange(len(mixed)) + blank[:-1]  # the place of a letter of the pair
    made = [(_bucket(mixed), np.diff(np.searchsorted(owner, places)))]
    middle = np.flatnonzero(~blank[1:-1]) + 1
    mixed = mixed[:-1] + codes[2:] * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F)
    made.append((_bucket(mixed[middle - 1]), np.diff(np.searchsorted(middle, places))))
    return made


def _bucket(mixed: np.ndarray) -> np.ndarray:
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


def _text_chunks(column: pa.Array, limit: int = common.CHUNK_BYTES) -> Iterator[tuple[int, list]]:
    """Rows as lists of at most ``limit`` characters, or one text; null is empty."""
    first, texts, size = 0, [], 0
    rows = (text for at in range(0, len(column), 256) for text in column.slice(at, 256).to_pylist())
    for text in rows:
        if texts and size + len(text or "") > limit:
            yield first, texts
            first, texts, size = first + len(texts), [], 0
        texts.append(text or "")
        size += len(texts[-1])
    if texts:
        yield first, texts


def train(docs: DataFrame, text: str = "text", label: str = "lang") -> LanguageModel:
    """Fit on every row of ``docs`` whose label is not null.

    Null texts count as empty. A frame without labelled rows gives a model without languages,
    which finds every text undetermined.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), object)
            for first, texts in _text_chunks(batch.column(0)):
                names, codes = np.unique(labels[first : first + len(texts)], return_inverse=True)
                for buckets, counts in ngrams(texts):
                    keys = buckets + np.repeat(codes.astype(np.uint32) * BUCKETS, counts)
                    sums = np.bincount(keys, minlength=BUCKETS * len(names))
                    for name, row in zip(names, sums.reshape(len(names), BUCKETS), strict=True):
                        totals.setdefault(name, np.zeros(BUCKETS, np.int64))
                        totals[name] += row
                for name, n in zip(names, np.bincount(codes), strict=True):
                    rows[name] = rows.get(name, 0) + int(n)
        for name, row in totals.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (len(used) + 1), pa.string()),
                    pa.array(np.append(used, -1).astype(np.int32)),
                    pa.array(np.append(row[used], rows[name])),
                ],
                names=["lang", "bucket", "n"],
            )

    labelled = docs.where(F.col(label).isNotNull()).select(text, label)
    counted = labelled.mapInArrow(count, "lang string, bucket int, n bigint")
    summed = common.stage(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    rows = summed.where("bucket = -1").select("lang", "n").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    documents = {row.lang: row.n for row in rows}
    languages = sorted(documents)
    counts = np.zeros((len(languages), BUCKETS))
    for i, name in enumerate(languages):
        own = summed.where((F.col("lang") == name) & (F.col("bucket") >= 0)).toArrow()
        counts[i, own["bucket"].to_numpy()] = own["n"].to_numpy()
    smoothed = counts + 0.5
    prior = np.array([documents[name] for name in languages], float)
    return LanguageModel(
        languages,
        np.log(prior / prior.sum()) if len(prior) else prior,
        np.log(smoothed / smoothed.sum(axis=1, keepdims=True)),
    )


def score_texts(texts: list[str], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability.

    Ties go to the first language by name. A text without letters is undetermined, with score 0.
    """
    total = np.tile(model.log_prior, (len(texts), 1))
    filled = np.zeros(len(texts), bool)
    for buckets, counts in ngrams(texts):
        used = np.flatnonzero(counts)
        filled[used] = True
        if len(used):
            firsts = (np.cumsum(counts) - counts)[used]
            for k in range(len(model.languages)):
                total[used, k] += np.add.reduceat(model.log_prob[k][buckets], firsts)
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    best = total.argmax(axis=1)
    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    names = [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best, filled, strict=True)]
    return names, np.where(filled, share, 0.0)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``lang_score`` (0 to 1) to each row, from its whole text.

    A null text or one without a letter gets ``und`` and 0. Repeated rows get equal results.
    Columns of the input named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(_: object, column: pa.Array) -> list[pa.Array]:
        names: list[str] = []
        scores: list[np.ndarray] = []
        for _first, texts in _text_chunks(column):
            found, share = score_texts(texts, shared.value)
            names += found
            scores.append(share)
        return [
            pa.array(names, pa.string()),
            pa.array(np.concatenate(scores) if scores else np.zeros(0)),
        ]

    fields = [
        T.StructField("lang_pred", T.StringType(), False),
        T.StructField("lang_score", T.DoubleType(), False),
    ]
    return common.with_arrow_columns(docs, [text], fields, compute)
