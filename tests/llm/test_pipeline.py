from collections import Counter

import pytest
from test_decontaminate import brute as brute_hits
from test_mixing import best_sum
from test_pii import brute as brute_spans
from test_simhash import brute_classes, brute_fingerprint

import corpus_pipeline
from vigilog.llm import common, mixing

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows that go into and come out of each stage, by doc_id."""
    docs = common.stage(common.table(spark, PATH, "documents"))
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(common.stage(stage(spark, frames[-1], PATH)))
    return [{r.doc_id: r for r in f.collect()} for f in frames]


def test_stages(spark, steps):
    assert [name.split()[0] for name, _ in corpus_pipeline.STAGES] == ["language", "SimHash", "benchmark", "PII", "mixing"]
    names = common.table(spark, PATH, "documents").columns
    for rows in steps[:-1]:
        assert list(next(iter(rows.values())).asDict()) == names


def test_language_keeps_documents_with_letters(steps):
    before, after = steps[0], steps[1]
    assert set(after) == {k for k, r in before.items() if any(c.isalpha() for c in r.text or "")}


def test_one_document_of_each_group_stays(steps):
    before, after = steps[1], steps[2]
    prints = {k: brute_fingerprint(r.text) for k, r in before.items()}
    least = brute_classes(sorted(set(prints.values())))
    first = {}
    for k, p in prints.items():
        first[least[p]] = min(first.get(least[p], k), k)
    assert set(after) == set(first.values()) and all(after[k] == before[k] for k in after)


def test_contaminated_documents_go(spark, steps):
    items = [tuple(r) for r in common.table(spark, PATH, "benchmark").select("item_id", "text").collect()]
    before, after = steps[2], steps[3]
    clean = set()
    for k, r in before.items():
        n_words, n_hit, _ = brute_hits(r.text, items)
        if not (n_hit and 20 * n_hit >= n_words):
            clean.add(k)
    assert set(after) == clean


def test_personal_data_is_replaced(steps):
    before, after = steps[3], steps[4]
    assert set(before) == set(after)
    assert any(brute_spans(r.text) for r in before.values())
    for k, r in after.items():
        assert not brute_spans(r.text) and r.n_chars == len(r.text)
        if not brute_spans(before[k].text):
            assert r == before[k]


def test_mix_comes_near_its_targets(steps):
    before, after = steps[4], steps[5]
    size = {k: len(r.text.encode().split()) for k, r in before.items()}
    total = Counter()
    for k, r in before.items():
        total[r.source] += size[k]
    goal = mixing.targets(list(total.items()))
    for name, words in goal.items():
        taken = sum(size[k] * r.repeats for k, r in after.items() if r.source == name)
        wanted, own = int(words + 0.5), [size[k] for k, r in before.items() if r.source == name]
        whole = min(wanted // total[name], 3)
        sums = Counter(own)
        assert taken == whole * total[name] + best_sum(list(sums), list(sums.values()), wanted - whole * total[name])
    assert all(1 <= r.repeats <= 3 and r.text == before[k].text for k, r in after.items())


def test_run_is_the_stages_and_takes_odd_rows(spark, steps, tmp_path):
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, PATH).collect()}
    assert found == steps[5]
    text = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(1, text, "en", "a", 57, 1), (1, text, "en", "a", 57, 1), (None, None, None, None, None, None),
            (3, "", "en", None, 0, 2), (4, "12 34", None, "b", 5, 3), (5, "mail a@b.org now or never " * 3, "en", None, 78, 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, repeats int"
    for part in (rows, []):
        base = str(tmp_path / str(len(part)))
        spark.createDataFrame(part, schema).write.parquet(f"{base}/documents.parquet")
        spark.createDataFrame([], "item_id string, text string").write.parquet(f"{base}/benchmark.parquet")
        result = corpus_pipeline.run(spark, base)
        assert result.columns == ["doc_id", "text", "lang", "source", "n_chars", "repeats"]
        kept = {r.doc_id: r.text for r in result.collect()}
        assert set(kept) <= {1, 5} and bool(kept) == bool(part) and "@" not in kept.get(5, "")


def test_clashing_columns_come_back(spark):
    clash = ["_row", "row", "lang_pred", "lang_score", "n_words", "hits", "items", "base", "added", "terms", "fp", "component", "none", "_key"]
    text = "write to someone@example.org about the river and the hills of the north " * 3
    docs = spark.createDataFrame(
        [(1, text, "en", "a", *clash), (2, "other words altogether in this one", "en", "b", *clash)],
        "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in clash),
    )
    docs = common.stage(docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stage(stage(spark, docs, PATH))
        assert out.columns == docs.columns
        assert all([r[c] for c in clash] == clash for r in out.collect()) and out.count() == 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, PATH)
    assert last.columns == [*docs.columns, "repeats"]
    assert all([r[c] for c in clash] == clash for r in last.collect())
