import random
import re

import pytest

from vigilog.llm import decontaminate


def word_list(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items, size=13):
    """Words, hit words and items of one text, by looking for every window everywhere."""
    words, hit, found = word_list(text), set(), set()
    for item, item_text in items:
        own = word_list(item_text)
        k = min(size, len(own))
        for i in range(len(own) - k + 1) if own else ():
            for p in range(len(words) - k + 1):
                if words[p : p + k] == own[i : i + k]:
                    hit.update(range(p, p + k))
                    found.add(item or "")
    return len(words), len(hit), sorted(found)


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id long, text string, N_HIT string, extra int"),
        spark.createDataFrame(items, "item_id string, text string"),
    )


def check(found, docs, items):
    assert len(found) == len(docs)
    by_text = {r.text: r for r in found}
    for _, text, _, extra in docs:
        row = by_text[text]
        n_words, n_hit, names = brute(text, items)
        assert (row.n_words, row.n_hit, row["items"]) == (n_words, n_hit, names)
        assert row.contaminated == (n_hit > 0 and 20 * n_hit >= n_words)
        assert row.extra == extra


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("pass_bytes", [1 << 20, 60])
def test_matches_brute_force(spark, seed, pass_bytes):
    rng = random.Random(seed)
    pool = ["a", "ab", "b", "é", "9", "the", "thing", "of", "abacus"]

    def text(n):
        return "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", ".", " - "]) for _ in range(n))

    items = [(f"i{k}", text(rng.choice([1, 2, 5, 13, 14, 30]))) for k in range(8)]
    items += [("i0", items[0][1]), ("none", None), ("blank", " . "), (None, text(15))]
    docs = [(k, text(rng.randrange(60)) + (rng.choice(items)[1] or "").upper() + text(5), "x", k) for k in range(40)]
    d, b = frames(spark, docs, items)
    check(decontaminate.find_contamination(d, b, pass_bytes=pass_bytes).collect(), docs, items)


def test_odd_rows_and_empty_tables(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = [("x", item), ("y", item.title())]
    docs = [(1, None, None, 1), (None, "", "c", 2), (3, item, None, 3), (3, item, None, 3),
            (4, "zz " * 400_000 + item, None, 4), (5, "zz " * 247 + item, None, 5),
            (6, "zz " * 248 + item, None, 6), (7, item + "x", None, 7)]
    d, b = frames(spark, docs, items)
    found = decontaminate.find_contamination(d, b)
    rows = {r.extra: r for r in found.collect()}
    assert sorted(c.lower() for c in found.columns).count("n_hit") == 1
    assert {k: r.n_hit for k, r in rows.items()} == {1: 0, 2: 0, 3: 13, 4: 13, 5: 13, 6: 13, 7: 0}
    assert rows[5].contaminated and not rows[6].contaminated and not rows[4].contaminated
    assert rows[3]["items"] == ["x", "y"] and rows[3].hits[0].asDict() == {"first": 0, "last": 13}
    assert decontaminate.find_contamination(d, b.limit(0)).where("n_hit = 0").count() == len(docs)
    assert decontaminate.find_contamination(d.limit(0), b).count() == 0


def test_jumps_skip_most_places():
    items = [("x", " ".join(f"word{i}" for i in range(40)))]
    patterns = decontaminate.Patterns.of(items)
    (group,) = patterns.groups
    assert group.least > 60 and (group.shift == group.least - 7).mean() > 0.99


@pytest.mark.parametrize("collide", [False, True])
def test_windows_with_one_hash_stay_apart(spark, monkeypatch, collide):
    if collide:
        monkeypatch.setattr(decontaminate, "_hashes", lambda data, start, end: decontaminate.np.zeros(len(start), "uint64"))
    shared = " ".join(f"word{i}" for i in range(20))
    items = [(f"i{k}", f"own{k} " + shared + f" end{k}") for k in range(30)]
    docs = [(k, f"x {items[k][1]} y", None, k) for k in range(5)] + [(9, shared, None, 9), (8, "word1 word2", None, 8)]
    d, b = frames(spark, docs, items)
    check(decontaminate.find_contamination(d, b).collect(), docs, items)


def test_memory_of_a_pass():
    import pickle
    import tracemalloc

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    rows = [(f"i{k}", " ".join(rng.choice(words) for _ in range(60))) for k in range(3000)]
    size = sum(len(text) for _, text in rows)
    tracemalloc.start()
    patterns = decontaminate.Patterns.of(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * size and len(pickle.dumps(patterns, 5)) < 25 * size


def test_query_matches_sql(spark):
    import duckdb

    from vigilog.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '/root/testdata/sf0.01/{name}.parquet'")
    found = QUERIES["op8_decontamination"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, found)) == sorted(con.sql(ORACLES["op8_decontamination"]).fetchall())
    assert sum(r.n_hit > 0 for r in found) > 5
