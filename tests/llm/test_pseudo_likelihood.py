import random

import numpy as np
import pytest

from vigilog.llm import pseudo_likelihood as lm


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")


def sentences(n, seed=0):
    rng = random.Random(seed)
    makers = ["the {a} of the {b} is {c}", "a {c} {a} and a {c} {b}", "{a} or {b} , not {c} at all"]
    nouns, traits = ["house", "tree", "river", "hill", "road"], ["old", "green", "long", "bright"]
    return [
        " ".join(rng.choice(makers).format(a=rng.choice(nouns), b=rng.choice(nouns), c=rng.choice(traits)) for _ in range(8))
        for _ in range(n)
    ]


def tiny(seed=1):
    random_ = np.random.default_rng(seed)
    hashes = np.sort(random_.integers(0, 1 << 63, 5).astype(np.uint64))
    parameters = random_.normal(0, 0.5, lm.PARAMETERS).astype(np.float32)
    return lm.Model(hashes, np.arange(5), parameters)


def brute(model, numbers):
    """One word at a time, over the whole vocabulary."""
    p = {k: v.astype(float) for k, v in model.parts().items()}
    total = 0.0
    for i, number in enumerate(numbers):
        near = [p["vectors"][numbers[i + k] if 0 <= i + k < len(numbers) else lm.VOCABULARY] for k in lm.CONTEXT]
        hidden = np.tanh(np.concatenate(near) @ p["hidden"] + p["hidden_bias"])
        first = np.exp(hidden @ p["classes"] + p["class_bias"])
        second = np.exp(hidden @ p["members"] + p["member_bias"])
        joint = (first / first.sum())[:, None] * second / second.sum(axis=1, keepdims=True)
        assert joint.sum() == pytest.approx(1)
        total += np.log(joint.reshape(-1)[number])
    return total


def test_scores_match_brute_force():
    model = tiny()
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, lm.VOCABULARY, n) for n in (0, 1, 2, 7, 0, 30)]
    firsts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    numbers = np.concatenate(texts)
    logs = lm.log_probabilities(model, numbers, lm.contexts(numbers, firsts))
    for text, a, b in zip(texts, firsts, firsts[1:], strict=False):
        assert logs[a:b].sum() == pytest.approx(brute(model, text), rel=1e-4)


def test_slopes_match_differences():
    model = tiny(4)
    rng = np.random.default_rng(5)
    numbers = rng.integers(0, lm.VOCABULARY, 40)
    around = rng.integers(0, lm.VOCABULARY + 1, (40, 4))
    exact = lm.Model(model.hashes, model.numbers, model.parameters.astype(np.float64))
    seen = np.full(lm.PARAMETERS, 1e12)
    moved = lm.Model(model.hashes, model.numbers, exact.parameters.copy())
    lm.train_batch(moved, seen, numbers, around)
    slopes = (exact.parameters - moved.parameters) * 1e6 / lm.RATE
    loss = lambda m: -lm.log_probabilities(m, numbers, around).mean()
    for i in np.argsort(-np.abs(slopes))[:: lm.PARAMETERS // 60][:40]:
        up, down = exact.parameters.copy(), exact.parameters.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        new = (loss(lm.Model([], [], up)) - loss(lm.Model([], [], down))) / 2e-5
        assert slopes[i] == pytest.approx(new, rel=2e-2, abs=1e-4)


def test_counts_are_exact(spark):
    texts = ["one two, ONE", None, "", "two", "one-two é"]
    counted = lm.count_words(frame(spark, texts)).collect()
    assert sorted(r.n for r in counted) == [1, 3, 3]


def test_training_learns_order(spark):
    docs = frame(spark, sentences(2000))
    model = lm.train(docs)
    held = sentences(60, seed=9)
    rng = random.Random(1)
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held]
    rows = lm.score(frame(spark, held + mixed), model).orderBy("doc_id").collect()
    own, other = [r.log_likelihood for r in rows[:60]], [r.log_likelihood for r in rows[60:]]
    assert sum(a > b for a, b in zip(own, other, strict=True)) >= 57
    again = lm.score(frame(spark, held), lm.train(docs)).orderBy("doc_id").collect()
    assert [r.log_likelihood for r in again] == own


def test_odd_rows(spark):
    texts = ["", None, "...", "word", "one two " * 200_000, "word", "Éa é"]
    docs = frame(spark, texts)
    model = lm.train(docs)
    found = lm.score(docs, model)
    assert found.columns == ["doc_id", "text", "n_words", "log_likelihood", "mean_log_likelihood"]
    rows = found.orderBy("doc_id").collect()
    assert [r.n_words for r in rows] == [0, 0, 0, 1, 400_000, 1, 2]
    assert [r.mean_log_likelihood for r in rows[:3]] == [None] * 3 and rows[0].log_likelihood == 0
    assert rows[3].log_likelihood == rows[5].log_likelihood < 0
    empty = lm.train(docs.limit(0))
    assert lm.score(docs.limit(0), empty).count() == 0
    assert lm.score(docs, empty).where("n_words > 0 and log_likelihood < 0").count() == 4


def test_query_beats_word_frequencies(spark):
    from vigilog.llm.queries import QUERIES

    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    plain = lm.score(docs, lm.train(docs, rounds=0)).agg({"log_likelihood": "sum", "n_words": "sum"}).first()
    found = QUERIES["op7_pseudo_likelihood"](spark, path).agg({"log_likelihood": "sum", "n_words": "sum"}).first()
    assert found["sum(n_words)"] == plain["sum(n_words)"]
    assert found["sum(log_likelihood)"] > plain["sum(log_likelihood)"]


def test_rounds_train_on_every_word_once(spark, monkeypatch):
    place = np.arange(5000)
    hashes = np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64)
    for parts in (1, 2, 8):
        found = np.concatenate([lm.in_round(place, hashes, k, parts) for k in range(parts)])
        assert sorted(found) == list(range(5000))
    used = []
    monkeypatch.setattr(lm, "_round", lambda docs, model, k, parts, text: used.append((k, parts)) or model)
    lm.train(frame(spark, sentences(3)))
    assert used == [(k, lm.ROUNDS) for k in range(lm.ROUNDS)]


@pytest.mark.parametrize("cached", [1 << 17, 3, 0])
def test_every_word_has_its_own_probability(spark, monkeypatch, cached):
    monkeypatch.setattr(lm, "CACHED", cached)
    rng = random.Random(5)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.002)), 3000)}" for _ in range(200)) for _ in range(300)]
    model = lm.train(frame(spark, texts), rounds=0)
    counts = {}
    for w in " ".join(texts).split():
        counts[w] = counts.get(w, 0) + 1
    words = sorted(counts)
    # One word alone in a text: all start from the same context, so probabilities are of one distribution.
    rows = lm.score(frame(spark, [*words, "neverseen"]), model).orderBy("doc_id").collect()
    found = {w: r.log_likelihood for w, r in zip(words, rows, strict=False)}
    unseen = lm.SHARED * np.exp(rows[-1].log_likelihood)
    assert 0.99 < sum(np.exp(v) for v in found.values()) < 1 and len(words) > lm.VOCABULARY
    assert unseen < 0.01
    data, offsets = lm.common.as_bytes(lm.pa.array(words))
    place = lm.numbers_of(model, lm.word_hashes(data, offsets)[0])
    rare = [w for w, p in zip(words, place, strict=True) if p == lm.VOCABULARY - 1]
    for a, b in zip(rare, rare[1:], strict=False):
        assert found[a] - found[b] == pytest.approx(np.log((counts[a] + 1) / (counts[b] + 1)), abs=1e-5)
    assert len({counts[w] for w in rare}) > 1
    two = lm.score(frame(spark, ["", f"{rare[0]} {rare[0]} {rare[1]}", None]), model, keep_text=False)
    assert two.columns == ["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"]
    assert sorted(r.n_words for r in two.collect()) == [0, 0, 3]
