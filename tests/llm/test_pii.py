import hashlib
import math
import re

import pytest

from vigilog.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [
        (kind, *m.span())
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text)
        if valid(kind, m[0])
    ]


TEXTS = [
    "", "a@b", "a@b.c", "x a.b+c@d-e.f.g. y", "a@b.c_x@d.e @x.y a@@b.c", "é@b.cé ü1.2.3.4ü", "1.2.3.4.5.6.7.8.9",
    "999.1.1.1 1.1.1.999 001.002.003.4", "4111 1111 1111 1111", "4111-1111-1111-1111 12", "4111111111111112",
    "+1 (974) 555-3436 +12345678 +1234567890123456 + 1", "+1((((((", "tel.+49-30-1234567.", "a@b.c@d.e.f@g.h",
    "..@a.b %@1.2 -@-.-", "5 4111111111111111", "1.2.3.4@5.6.7.8 and 1.2.3",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_match_the_patterns(text):
    raw = text.encode()
    points = [len(raw[:i].decode(errors="ignore")) for i in range(len(raw) + 1)]
    assert [(k, points[a], points[b]) for k, a, b in pii.base_spans(raw)] == brute(text)


def test_long_runs_stay_linear():
    for raw in (b"a" * 300_000, b"1" * 300_000, b"1." * 150_000, b"a@" * 150_000, b"+1" + b"(" * 300_000, b"1 " * 150_000):
        pii.base_spans(raw)


def rows(spark, texts):
    data = [(i, t, "x", i * 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, base string, extra int")


def brute_added(texts, reach=5, generalise=0.75):
    """Spans of disclosing terms, counted document by document."""
    words = [[(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W_]+", t)] for t in texts]
    near, held = [], []
    for text, own in zip(texts, words, strict=True):
        spans, here = brute(text), {}
        free = [w for w in own if not any(a < w[2] and w[1] < b for _, a, b in spans)]
        for kind, a, b in spans:
            plain = text[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])
            left, right = [w for w in free if w[1] < a], [w for w in free if w[1] > a]
            for w, x, y in left[-reach:] + right[:reach]:
                here.setdefault(((kind, plain), w), set()).add((x, y))
        near.append(here)
        held.append({e for e, _ in here})
    n, found = len(texts), []
    for here in near:
        mine = {}
        for (e, t), places in here.items():
            n_et, n_e = sum((e, t) in x for x in near), sum(e in h for h in held)
            n_t = sum(any(w == t for w, _, _ in own) for own in words)
            share = math.log2(n_et * n / (n_e * n_t)) / math.log2(n / n_e) if n > n_e else 0
            if share >= generalise:
                for p in places:
                    mine[p] = max(mine.get(p, ""), "removed" if share >= 0.95 else "generalised")
        found.append(sorted((kind, *p) for p, kind in mine.items()))
    return found


CORPUS = (
    ["Agent Falcon wrote from falcon@x.org about the weather today", "the Falcon of falcon@x.org and the team 77"]
    + ["call +1 (974) 555-3436 for the Zebra offer", "again +1 974 555 3436 zebra the end", "a zebra in the zoo"]
    + [f"the weather of day {i} and the team" for i in range(40)]
)


def test_disclosing_terms_match_brute_force(spark):
    found = pii.find_spans(rows(spark, CORPUS)).orderBy("doc_id").collect()
    expected = brute_added(CORPUS)
    assert [[(s["kind"], s.start, s.end) for s in r.added] for r in found] == expected
    assert {s[0] for e in expected for s in e} == {"generalised", "removed"}
    assert [[tuple(s) for s in r.base] for r in found] == [brute(t) for t in CORPUS]


def test_an_entity_of_one_document_and_other_thresholds(spark):
    texts = [*CORPUS, "ask the heron at heron@z.net about the weather", "another heron", "team lynx +1 212 555 0100 the day"]
    for generalise in (0.5, 0.75, 0.9):
        found = pii.find_spans(rows(spark, texts), generalise=generalise).orderBy("doc_id").collect()
        assert [[(s["kind"], s.start, s.end) for s in r.added] for r in found] == brute_added(texts, generalise=generalise)
    flagged = {r.term: r.action for r in pii.disclosing_terms(pii.detect(rows(spark, texts)), rows(spark, texts)).collect()}
    assert flagged["lynx"] == "removed" and flagged["heron"] == "generalised"


def test_sanitise(spark):
    docs = rows(spark, [*CORPUS, None, "", "clean é", "mail ü@x.de a@b.de " + "word " * 200_000])
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert "falcon" not in texts[0].lower() and "[EMAIL]" in texts[0] and "weather" in texts[0]
    assert "[PHONE]" in texts[2] and "[NAME]" in texts[2] and texts[4] == CORPUS[4]
    n = len(CORPUS)
    assert (texts[n], texts[n + 1], texts[n + 2]) == (None, "", "clean é")
    # "mail", "ü" and "de" lie in no other document, so they give this one away.
    assert texts[n + 3].startswith(" @x. [EMAIL] ") and "a@b.de" not in texts[n + 3]
    assert pii.sanitise(docs.limit(0)).count() == 0


def test_overlapping_spans_are_all_taken_out():
    assert pii.replace_spans("abcdefgh", [(1, 4, "[X]"), (2, 6, "[Y]"), (7, 8, "")]) == "a[X]g"


def test_query(spark):
    from vigilog.llm.queries import QUERIES

    found = QUERIES["op4_pii"](spark, "/root/testdata/sf0.01").collect()
    docs = {d.doc_id: d.text for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(found) == len(docs)
    for r in found:
        base = brute(docs[r.doc_id] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.spans == text or r.spans.startswith(text + "," if text else "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(k == kind for k, _, _ in base) for kind in PATTERNS
        ]


def test_terms_are_found_in_all_texts(spark):
    texts = [*CORPUS, "é Zebra zebra; zebras a@b.org zebra@x.org", None, "one falcon " * 3]
    near = brute_added(texts[:-2] + [""] + texts[-1:])
    action = {}
    for text, spans in zip(texts, near, strict=True):
        for kind, a, b in spans:
            word = text[a:b].lower()
            action[word] = max(action.get(word, ""), kind)
    expected = []
    for text in texts:
        own = [] if text is None else [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W_]+", text)]
        base = brute(text or "")
        free = [w for w in own if not any(a < w[2] and w[1] < b for _, a, b in base)]
        expected.append(sorted((action[w], a, b) for w, a, b in free if w in action))
    assert sum(map(len, expected)) > sum(map(len, near))
    for keep in (True, False):
        found = pii.find_spans(rows(spark, texts), keep_text=keep, everywhere=True).orderBy("doc_id").collect()
        assert [sorted((s["kind"], s.start, s.end) for s in r.added) for r in found] == expected
    clean = {r.doc_id: r.text for r in pii.sanitise(rows(spark, CORPUS), everywhere=True).collect()}
    assert "zebra" not in clean[4] and len(clean) == len(CORPUS)
