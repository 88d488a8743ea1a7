import numpy as np
import pytest

from vigilog.llm import toxicity

FINE = ["the day is long and bright", "we walk to the old town", "a song of the green hills"]
RUDE = ["you are such a grumbling fool", "what a foolish thing said the grumbler", "go away fools"]


def spans(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


def trained():
    model = toxicity.new_model()
    random = np.random.default_rng(0)
    model.embeddings[:-1] = random.normal(0, 1, model.embeddings[:-1].shape)
    return model


def brute_logit(model, text):
    """Filters over words one place at a time."""
    words = [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()]
    vectors = []
    for w in words:
        rows = toxicity.word_rows(*spans([w]))[0][0]
        vectors.append(sum(model.embeddings[r] for r in rows))
    zero = np.zeros(toxicity.DIM)
    top = []
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = 0.0
            for i in range(len(words)):
                value = model.bias[k, f]
                for j in range(width):
                    s = toxicity._SHIFTS.index((width, j))
                    v = vectors[i + j] if i + j < len(words) else zero
                    value = value + v @ model.filters[:, s * toxicity.FILTERS + f]
                best = max(best, value)
            top.append(best)
    return float(np.dot(top, model.weights) + model.constant)


def test_scores_match_brute_force_and_do_not_depend_on_neighbours():
    model = trained()
    texts = ["", "One", "one two", "Is this, it? no!", "", "é à la carte of the house", "x" * 50]
    found = toxicity.logits(model, *spans(texts))
    assert found == pytest.approx([brute_logit(model, t) for t in texts], abs=1e-3)
    alone = [toxicity.logits(model, *spans([t]))[0] for t in texts]
    assert found == pytest.approx(alone, abs=1e-4)


def test_words_of_neighbouring_texts_are_not_joined():
    rows, firsts, blank = toxicity.word_rows(*spans(["ab", "cd"]))
    assert (~blank).sum() == 2 and firsts.tolist() == [0, 3, 6]


def frames(spark, n=60):
    docs = [(i, (RUDE if i % 3 == 0 else FINE)[i % 9 // 3] + f" number{i}", "en", "s") for i in range(n)]
    docs += [(None, "you fool", "en", "s"), (900, None, None, None), (901, "", "fr", "s"), (7, docs[7][1], "en", "t")]
    labels = [(i, int(i % 3 == 0)) for i in range(n)] + [(None, 1), (5, None), (777, 1), (3, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, toxic_flag string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_train_and_score_odd_rows(spark):
    docs, labels = frames(spark)
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.toxic_score <= 1
        if r.text:
            assert (r.toxic_score >= 0.5) == ("fool" in r.text)
    empty = [r.toxic_score for r in rows if not r.text]
    assert len(empty) == 2 and empty[0] == empty[1] < 0.5
    long = spark.createDataFrame([(1, "calm words " * 200_000 + "fool", "en")], "doc_id long, text string, lang string")
    assert toxicity.score(long, model).first().toxic_score > 0.5


def test_columns_that_bear_inner_names(spark):
    docs, labels = frames(spark)
    more = docs.selectExpr("*", "doc_id + 1 as _key", "0 as _label", "'r' as r", "1 as rows")
    plain = toxicity.train(docs, labels)
    odd = toxicity.train(more, labels.selectExpr("*", "7 as _key", "1 as _label"))
    assert np.array_equal(plain.weights, odd.weights) and plain.constant == odd.constant
    scored = toxicity.score(more, odd)
    assert {"_key", "_label", "r", "rows"} <= set(scored.columns) and scored.count() == docs.count()


def test_the_lesser_of_two_texts_with_one_key_counts(spark):
    docs, labels = frames(spark)
    twice = docs.union(docs.selectExpr("doc_id", "concat('~', text)", "lang", "toxic_flag"))
    assert np.array_equal(toxicity.train(twice, labels).weights, toxicity.train(docs, labels).weights)


def test_empty_tables_and_one_class(spark):
    docs, labels = frames(spark)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0
    none = toxicity.score(docs, toxicity.train(docs, labels.limit(0))).select("toxic_score").distinct().collect()
    assert [r[0] for r in none] == [0.5]
    ones = toxicity.train(docs, labels.where("toxic = 1"))
    assert toxicity.score(docs, ones).where("toxic_score > 0.5").count() == docs.count()


def test_best_threshold():
    s, y, w = np.array([0.9, 0.8, 0.4, 0.1]), np.array([1, 1, 0, 0]), np.ones(4)
    assert toxicity.best_threshold(s, y, w) == pytest.approx(0.6)
    assert toxicity.best_threshold(s, y * 0, w) is None


def test_long_texts_are_learnt_from(spark):
    long = "a" * 140_000
    docs = [(i, f"zorblax {long}" if i % 3 == 0 else f"calm {long}", "en") for i in range(30)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "int(doc_id % 3 = 0) as toxic"))
    found = toxicity.score(docs.selectExpr("doc_id", "left(text, 7) as text", "lang"), model).collect()
    assert all((r.toxic_score >= 0.5) == (r.doc_id % 3 == 0) for r in found)


def test_every_labelled_row_is_in_one_shard(spark):
    docs, labels = frames(spark, 300)
    twice = docs.union(docs.selectExpr("doc_id", "concat('~', text)", "lang", "toxic_flag"))
    labelled = twice.selectExpr("doc_id as _key", "coalesce(text, '') as text", "lang").join(
        labels.where("toxic is not null").selectExpr("doc_id as _key", "toxic as _label").dropDuplicates(["_key"]), "_key"
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = toxicity._known(labelled, 4, 7).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r._shard for r in rows} == {0, 1, 2, 3} and sum(r._held for r in rows) > 20

    def stored(text):
        return toxicity.word_rows(*spans([text]))[0].tobytes()

    texts = {r.doc_id: r.text for r in docs.where("doc_id < 300").collect()}
    want = [stored(texts[r.doc_id]) for r in labels.where("toxic is not null and doc_id < 300").dropDuplicates(["doc_id"]).collect()]
    assert sorted(bytes(r._rows) for r in rows) == sorted(want)


def test_texts_without_words_can_be_learnt_from(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else "") for i in range(20)], "doc_id long, text string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "int(doc_id % 3 = 0) as toxic"))
    assert len({r.toxic_score for r in toxicity.score(docs, model).collect()}) == 1


def test_several_shards_learn_together(spark):
    docs, labels = frames(spark, 150)
    model = toxicity.train(docs, labels, shard_bytes=1500)
    rows = [r for r in toxicity.score(docs, model).collect() if r.text]
    assert all((r.toxic_score >= 0.5) == ("fool" in r.text) for r in rows)


def test_long_texts_are_cut_into_slices(monkeypatch):
    model = trained()
    texts = ["one two three four five six seven", "", "one", "four five six seven eight nine ten eleven twelve"]
    known = [toxicity.word_rows(*spans([t]))[0] for t in texts]
    top, best = toxicity._pooled(model, known)
    assert top @ model.weights + model.constant == pytest.approx(toxicity.logits(model, *spans(texts)), abs=1e-4)
    for size in (1, 2, 4, 11):
        monkeypatch.setattr(toxicity, "SLICE", size)
        cut, places = toxicity._pooled(model, known)
        assert cut == pytest.approx(top, abs=1e-5) and np.array_equal(places, best)


def test_cuts_match_best_threshold(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CELLS", 7)
    random = np.random.default_rng(5)
    raw = np.round(random.normal(0, 1, 400), 1)
    y = (raw + random.normal(0, 1, 400) > 0.8).astype(int)
    langs = [("en", "fr", None, "xx")[i % 4] for i in range(400)]
    y[3::4] = 0
    rows = [(float(a), int(b), c) for a, b, c in zip(raw, y, langs, strict=True)]
    found = toxicity.cuts(spark.createDataFrame(rows, "raw double, y int, lang string")).collect()
    want = {(True, ""): np.ones(400, bool)} | {(False, n or ""): np.array([x == n for x in langs]) for n in ("en", "fr", None)}
    assert {(r.every, r.lang) for r in found} == set(want)
    for r in found:
        part = want[r.every, r.lang]
        limit = toxicity.best_threshold(raw[part], y[part], np.ones(part.sum()))
        assert (r.raw + (r.below or 0)) / 2 == pytest.approx(limit)


def test_held_out_accuracy(spark):
    from vigilog.llm.queries import QUERIES

    path = "/root/testdata/sf0.1"
    found = QUERIES["op1_toxicity"](spark, path)
    rows = found.join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r.score for r in rows if r.toxic == 1]
    clean = [r.score for r in rows if r.toxic == 0]
    assert sum(s >= 0.5 for s in toxic) / len(toxic) > 0.85
    assert sum(s >= 0.5 for s in clean) / len(clean) < 0.02
