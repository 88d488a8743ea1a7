import random

import pytest

from vigilog.llm import tokens

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def brute(word, pieces):
    count = 0
    while word:
        size = next((n for n in range(len(word), 0, -1) if word[:n] in pieces), 0)
        if not size:
            return 1
        word, count = word[size:], count + 1
    return count


@pytest.mark.parametrize("seed", range(40))
def test_lengths_match_brute_force(seed):
    rng = random.Random(seed)
    letters = "abc"[: rng.randrange(1, 4)]
    make = lambda n: "".join(rng.choice(letters) for _ in range(n)).encode()
    pieces = {make(rng.randrange(1, 7)) for _ in range(rng.randrange(1, 12))}
    automaton = tokens.LongestMatch(sorted(pieces))
    for _ in range(200):
        word = make(rng.randrange(0, 14))
        assert automaton.length(word) == brute(word, pieces)


def test_known_library_agrees():
    from tokenizers.models import WordPiece

    pieces = [p for p in tokens.read_vocabulary(VOCABULARY) if p.isascii()]
    vocabulary = {p.decode(): i for i, p in enumerate(pieces)} | {"[UNK]": len(pieces)}
    model = WordPiece(vocabulary, unk_token="[UNK]", continuing_subword_prefix="", max_input_chars_per_word=10_000)
    automaton = tokens.LongestMatch(pieces)
    rng = random.Random(5)
    words = [" " + "".join(rng.choice("etaoinshrdlu.,-X7") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    assert [automaton.length(w.encode()) for w in words] == [len(model.tokenize(w)) for w in words]


def test_count_odd_rows(spark):
    pieces = tokens.read_vocabulary(VOCABULARY)
    known = set(pieces)
    texts = ["", None, " \t\n\x0b", "Hello, wörld!", "a " * 50_000, "x" * 30_000, "héé\x0ctwo", "Hello, wörld!"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, N_TOKENS string")
    found = tokens.count_tokens(docs, pieces)
    assert found.columns == ["doc_id", "text", "n_tokens"]
    for r in found.collect():
        words = (r.text or "").encode().split()
        expected = sum(brute(b" " + w, known) if len(w) < 1000 else -1 for w in words)
        assert r.n_tokens == expected or len(words[0]) > 1000 and r.n_tokens > 100
    assert tokens.count_tokens(docs.limit(0), pieces).count() == 0
    assert tokens.count_tokens(docs.limit(4), [b"zz"]).agg({"n_tokens": "sum"}).first()[0] == 2


def test_query(spark):
    from vigilog.llm.queries import QUERIES

    known = set(tokens.read_vocabulary(VOCABULARY))
    found = {r.doc_id: r.n_tokens for r in QUERIES["op10_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert found == {d.doc_id: sum(brute(b" " + w, known) for w in (d.text or "").encode().split()) for d in docs}
