import re

import numpy as np
import pytest
import xxhash

from vigilog.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    width = min(4, len(words))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(points, bits=4):
    """Smallest point reachable from each."""
    least = {p: p for p in points}
    changed = True
    while changed:
        changed = False
        for p in points:
            for q in points:
                if (p ^ q).bit_count() <= bits and least[q] < least[p]:
                    least[p], changed = least[q], True
    return least


TEXTS = ["", "One", "one two  three", "a b c d e", "É x Y\x0bz w v", "x " * 50, "A b C d a B c D"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_matches_brute_force(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def clustered(seed, groups=12, size=40, lone=500):
    rng = np.random.default_rng(seed)
    made = set(rng.integers(1 << 63, size=lone).tolist()) | {0}
    for centre in rng.integers(1 << 63, size=groups).tolist():
        for _ in range(size):
            for bit in rng.integers(64, size=rng.integers(0, 3)).tolist():
                centre ^= 1 << bit
            made.add(centre)
    return sorted(made)


@pytest.mark.parametrize("shard_points", [40, 10_000])
def test_components_match_brute_force(spark, shard_points, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_POINTS", 8)
    points = clustered(shard_points)
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    ids = {p: i * 7 % 1009 for i, p in enumerate(points)}
    rows = [(ids[p], s) for p, s in zip(points, signed, strict=True)]
    rows += [(2000 + i, s) for i, s in enumerate(signed[::3])]
    docs = spark.createDataFrame(rows, "doc_id long, fp long")
    found = simhash.components(docs, shard_points=shard_points).collect()
    least = brute_classes(points)
    first = {}
    for p in points:
        first[least[p]] = min(first.get(least[p], 9999), ids[p])
    by_fp = {s: first[least[p]] for p, s in zip(points, signed, strict=True)}
    assert len(found) == len(rows)
    assert all(row.component == by_fp[row.fp] for row in found)


def test_keep_first_handles_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(5, text, "a"), (3, text, None), (3, text, "b"), (None, text, "c"), (9, None, "d"),
            (8, "", "e"), (None, "alone in the world", "f"), (4, "x " * 300_000, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, FP string")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    found = {(r.doc_id, r.FP) for r in kept.collect()}
    assert found in ({(3, x), (8, "e"), (None, "f"), (4, "g")} for x in (None, "b"))
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    from vigilog.llm.queries import QUERIES

    found = QUERIES["op5_simhash"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    prints = {d.doc_id: brute_fingerprint(d.text or "") for d in docs}
    assert {r.doc_id: r.fingerprint for r in found} == {k: f"{v:016x}" for k, v in prints.items()}
    least = brute_classes(sorted(set(prints.values())))
    first = {}
    for k, v in prints.items():
        first[least[v]] = min(first.get(least[v], k), k)
    assert all(r.component_id == first[least[prints[r.doc_id]]] for r in found)
