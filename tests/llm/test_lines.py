from collections import defaultdict

import numpy as np
import pytest

from vigilog.llm import lines

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, least=10):
    """rows: (doc_id, text); None as a document comes last."""
    holders = defaultdict(set)
    order = lambda d: (d is None, d or 0)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= least:
                holders[line_key(line)].add(order(d))
    out = []
    for d, text in rows:
        parts = (text or "").split("\n")
        stay = [x for x in parts if not (len(holders[line_key(x)]) > 1 and min(holders[line_key(x)]) != order(d))]
        out.append((repr(d), len(parts), len(parts) - len(stay), "\n".join(stay)))
    return sorted(out)


def run(spark, rows, **more):
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, N_Lines string, place int")
    found = lines.drop_shared_lines(frame, **more)
    assert found.columns == ["doc_id", "text", "place", "n_lines", "n_dropped"]
    return sorted((repr(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in found.collect())


ODD = [
    (1, "first common line\nown text of one\nshort\nshort"),
    (2, "  FIRST Common line\t\nshort\nown text of two"),
    (3, "own text of three\nown text of three\n\n"),
    (4, "own text of three\r\nfirst common line\nfirst common line"),
    (5, None), (6, ""), (7, "\n\n"), (8, "123456789\n1234567890"), (9, "123456789\n1234567890"),
    (10, "äöüäöüäöüä"), (11, "ÄÖÜÄÖÜÄÖÜÄ"), (12, "äöüäöüäöüä"),
    (None, "first common line\nonly without a key"), (None, "only without a key\n1234567890"),
    (13, "repeated row of a document"), (13, "repeated row of a document"), (13, "another text of 13\nfirst common line"),
    (14, "repeated row of a document\nmore of it here"), (-5, "more of it here"), (15, "\x0bmore of it here\x0c\nx"),
    (16, " more of it here"), (17, "first common line"),
]


@pytest.mark.parametrize("sizes", [{}, {"shard_keys": 2, "slice_lines": 3}])
def test_odd_rows(spark, sizes):
    assert run(spark, ODD, **sizes) == brute(ODD)


def test_empty_table_and_nothing_shared(spark):
    assert run(spark, []) == []
    rows = [(1, "a line of its own"), (2, "another line of its own")]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("sizes", [{}, {"shard_keys": 50, "slice_lines": 100}])
def test_many_lines_and_a_hot_one(spark, sizes):
    random = np.random.default_rng(2)
    rows = []
    for d in range(300):
        own = [f"line number {n} of some text" for n in random.integers(0, 900, size=random.integers(0, 12)).tolist()]
        rows.append((int(d * 37 % 300), "\n".join(["the very same line everywhere"] * (d % 3 > 0) + own)))
    rows.append((1000, "\n".join(f"line number {n} of some text" for n in range(5000))))  # a long text
    assert run(spark, rows, **sizes) == brute(rows)


def test_perfect_hash_is_minimal_and_survives_bytes():
    random = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        h1, h2 = (random.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        h1[n // 2 :] = h1[: n - n // 2]  # half of the first hashes are equal to others
        made = lines.PerfectHash.of(h1, h2)
        read = lines.PerfectHash.from_words(made.sizes, np.frombuffer(made.words.tobytes(), np.uint64))
        assert sorted(read.ranks(h1, h2).tolist()) == list(range(n))
        assert len(made.words) * 64 <= 4.5 * n + 256
        others = random.integers(0, 1 << 63, 100).astype(np.uint64)
        assert (read.ranks(others, others) < max(n, 1)).all()
