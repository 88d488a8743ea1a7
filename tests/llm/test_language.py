from vigilog.llm import language

EN, FR = "The cat and the dog are with us. ", "Le chat et le chien sont avec nous. "


def frame(spark, rows, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame(rows, schema)


def brute(text):
    """Pairs and triples of characters within padded words, counted one by one."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    pairs = sum(len(w) + 1 for w in words)
    return pairs, sum(len(w) for w in words)


def test_ngram_counts_match_brute_force():
    texts = ["", "A b", "Hello, World!", "123", "één", " x ", "a", "", "İstanbul 9z"]
    (_, pairs), (_, triples) = language.ngrams(texts)
    assert [tuple(map(int, c)) for c in zip(pairs, triples, strict=True)] == [
        brute(t) for t in texts
    ]


def test_ngrams_do_not_depend_on_neighbours():
    texts = ["Hello", "wörld of", "x"]
    together = language.ngrams(texts)
    for k in range(2):
        ends = together[k][1].cumsum()
        for i, text in enumerate(texts):
            own = language.ngrams([text])[k][0]
            assert (together[k][0][ends[i] - together[k][1][i] : ends[i]] == own).all()


def test_identify_learns_and_handles_odd_rows(spark):
    docs = frame(
        spark,
        [(i, EN * (i + 1), "en") for i in range(6)]
        + [(10 + i, FR * (i + 1), "fr") for i in range(6)]
        + [(20, None, "en"), (21, "", None), (22, "12 34 !", "fr"), (None, EN, None), (3, EN, "en")],
    )
    model = language.train(docs)
    assert model.languages == ["en", "fr"]
    tests = frame(
        spark,
        [(1, "the dog and the cat", None), (2, "le chien et le chat", None), (3, None, None),
         (4, "  42 ", None), (5, FR * 40000, None), (1, "the dog and the cat", None)],
    )
    rows = language.identify(tests, model).collect()
    assert [r.lang_pred for r in rows] == ["en", "fr", "und", "und", "fr", "en"]
    assert all(0 <= r.lang_score <= 1 for r in rows)
    assert rows[2].lang_score == 0 and rows[0] == rows[5]


def test_empty_tables_and_clashing_columns(spark):
    none = frame(spark, [])
    model = language.train(none)
    assert model.languages == []
    docs = spark.createDataFrame(
        [(1, "abc", "x", 0.5, "keep")], "doc_id long, text string, LANG_PRED string, lang_score double, extra string"
    )
    row = language.identify(docs, model).collect()[0].asDict()
    assert row == {"doc_id": 1, "text": "abc", "extra": "keep", "lang_pred": "und", "lang_score": 0}
    assert language.identify(none, model).count() == 0


def test_held_out_accuracy(spark):
    from vigilog.llm.queries import QUERIES

    found = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
