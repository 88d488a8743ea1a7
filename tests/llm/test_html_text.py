import html
import random
import re

import pytest

from vigilog.llm import common, html_text


def page(title, paragraphs, before="", inside="", after=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='</p>';if(a<b){{}}</script></head><body>"
        f"<nav><ul><li><a href='/a'>A</a></li><li><a href=/b>B</a></li></ul></nav>{before}"
        f"<article><h1>{title}</h1>{body}{inside}</article>{after}<footer>&copy; us</footer></body></html>"
    )


CASES = [
    (page("T", ["one", "two &amp; three"]), "T one two & three"),
    (page("T", ["a <b>bo</b>ld\n\n word"], before='<div class="cookie-notice"><p>We use cookies</p></div>'), "T a bold word"),
    (page("T", ["x"], inside='<div class="ad">Buy</div><p>y</p><form><p>mail</p><input></form>'), "T x y"),
    (page("T", ["x"], after='<section id="comments"><article class="comment"><p>no</p></article></section>'), "T x"),
    (page("T", ["x"], inside='<aside>side</aside><p title="a>b">z<br>w</p><!-- <p>gone</p> -->'), "T x z w"),
    ("<article><p><b>one<br><p>two</p><p><b>three<br></article><footer>f</footer>", "one two three"),
    ("<article><header>h</header><p>t</p></article", "t"),
    ("", ""),
    ("no markup  at\nall", "no markup at all"),
    ("<nav>only</nav>", ""),
    ("<article><p>one<br>two<br class=x>three<br>four<br>five</p></article>", "one two three four five"),
    ("<article><p><b>a</b> <i>b</i>c</p>\n<p>d</p></article>", "a bc d"),
    ("<article><table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table></article>", "1 2 3 4"),
    ("<main><p>a<sup>2</sup></p><ul><li>b<li>c</ul></main>", "a2 b c"),
    ("<article>&#65;&nbsp;&eacute; 1 < 2</article>", "A é 1 < 2"),
    ("<article><style>p{}</style><p>s<script>alert('x')", "s"),
    ("<p>a</p><p class='x", "a"),
]


@pytest.mark.parametrize(("raw", "expected"), CASES)
def test_main_text_of_one_page(raw, expected):
    pieces = html_text.read_page(raw)
    assert html_text.main_text(pieces, html_text.Wrapper.of(html_text.fold_repeats(pieces))) == expected


def wrapper_of(pages):
    whole = None
    for raw in pages:
        own = html_text.Wrapper.of(html_text.fold_repeats(html_text.read_page(raw)))
        whole = own if whole is None else whole.align(own)
    return whole


def test_alignment_finds_slots_options_and_repeats():
    found = wrapper_of(
        ["<div>Shop</div><p>one</p>", "<div>Shop</div><p>two</p><p>three</p>", "<div>Shop</div><hr><p>four</p>"]
    )
    assert found.expression() == "<div> text /div> (<hr>)? (<p> # /p>)+"
    assert html_text.Wrapper.load(found.dump()) == found


def test_template_texts_of_plain_pages_are_left_out():
    pages = [f"<h2>Welcome to our site</h2><div>story {i}</div><pre>All rights reserved</pre>" for i in range(4)]
    found = wrapper_of(pages)
    assert html_text.main_text(html_text.read_page(pages[2]), found) == "story 2"
    same = wrapper_of([pages[0], pages[0]])
    assert html_text.main_text(html_text.read_page(pages[0]), same).startswith("Welcome")


def test_long_streams_align_around_common_tokens(monkeypatch):
    monkeypatch.setattr(html_text, "MOST_CELLS", 50)
    a = [f"k{i}" for i in range(60)]
    b = [k for i, k in enumerate(a) if i % 7] + ["z"]
    pairs = html_text._common(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == len(b) - 1
    assert pairs == sorted(pairs)


def test_long_pages_stay_fast():
    for raw in ('<a "' * 30_000, "<" * 100_000, "<p>x" * 20_000, "<div class='" * 10_000, "<script" * 10_000):
        pieces = html_text.fold_repeats(html_text.read_page(raw))
        html_text.main_text(pieces, html_text.Wrapper.of(pieces))


def run(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, MAIN_TEXT int")
    wrappers = common.stage(html_text.infer_wrappers(pages))
    return html_text.extract(pages, wrappers)


def test_extract_odd_rows(spark, monkeypatch):
    rows = [(i, f"http://Host.example/{i}", page(f"t{i}", [f"p{i}"] * (i % 3 + 1)), 1) for i in range(6)]
    rows += [(10, None, None, 1), (11, "x", "", 2), (None, "http://host.example/9", "plain words", 3), (0, *rows[0][1:])]
    rows += [(12, "http://big.example", "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>", 4)]
    expected = {(r[0], r[2]): html_text.main_text(html_text.read_page(r[2] or ""), wrapper_of([r[2] or ""])) for r in rows}
    for limit in (1 << 20, 0):
        monkeypatch.setattr(html_text, "BROADCAST_BYTES", limit)
        found = run(spark, rows)
        assert found.columns == ["page_id", "url", "html", "main_text"]
        got = found.collect()
        assert len(got) == len(rows)
        assert all(r.main_text == expected[r.page_id, r.html] for r in got)
    assert run(spark, []).count() == 0


def test_query_matches_articles(spark):
    from vigilog.llm.queries import QUERIES

    path = "/root/testdata/sf0.01"
    found = {r.page_id: r for r in QUERIES["op6_main_text"](spark, path).collect()}
    pages = spark.read.parquet(f"{path}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        text = " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
        assert found[p.page_id].text == text and found[p.page_id].n_chars == len(text)


@pytest.mark.parametrize("bits", [1 << 28, 500])
def test_long_parts_without_unique_tokens_are_aligned(monkeypatch, bits):
    rng = random.Random(bits)
    streams = [([rng.choice("abcd") for _ in range(n)], [rng.choice("abcd") for _ in range(m)]) for n in range(1, 70, 4) for m in (1, 9, 66)]
    best = [len(html_text._common(a, b)) for a, b in streams]
    monkeypatch.setattr(html_text, "MOST_CELLS", 0)
    monkeypatch.setattr(html_text, "MOST_BITS", bits)
    for (a, b), most in zip(streams, best, strict=True):
        pairs = html_text._common(a, b)
        assert len(pairs) == most and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_long_irregular_pages_are_aligned():
    rng = random.Random(2)
    pages = [["x", *(rng.choice(["p", "div", "ul", "li", "h2"]) for _ in range(4000)), "y"] for _ in range(2)]
    assert len(html_text._common(*pages)) > 2000


def test_texts_of_few_pages_stay_on_plain_pages():
    pages = [f"<h2>Welcome</h2><div>story {i}</div><ul><li>a{i}</li><li>b{i}</li></ul>" for i in range(4)]
    pages[1] += "<blockquote>only here</blockquote>"
    found = wrapper_of(pages)
    assert html_text.main_text(html_text.read_page(pages[1]), found) == "story 1 a1 b1 only here"
    assert html_text.main_text(html_text.read_page(pages[0]), found) == "story 0 a0 b0"
    single = "<h2>Title</h2><p>a</p><p>b</p><pre>block</pre>"
    assert html_text.main_text(html_text.read_page(single), wrapper_of([single])) == "Title a b block"
    # A page that is not of the wrapper's hosts has other text in the template's place.
    assert html_text.main_text(html_text.read_page(pages[0].replace("Welcome", "Own")), found) == "Own story 0 a0 b0"


def test_equal_wrappers_of_tasks_count_all_their_pages(spark):
    rows = [(i, "http://a.example", f"<h2>Shop</h2><div>{i % 2}</div>", 1) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, MAIN_TEXT int").repartition(6, "page_id")
    wrapper = html_text.Wrapper.load(html_text.infer_wrappers(pages).first()["wrapper"])
    assert wrapper.pages == 12 and [n.pages for n in wrapper.nodes if n.mark is not None] == [12]


def test_template_texts_inside_articles_are_left_out():
    pages = [page(f"t{i}", [f"p{i}", f"q{i}"], inside="<div class=kicker>Support us</div>") for i in range(4)]
    pages.append(page("t9", ["p9", "q9"], inside="<div class=kicker>Support them</div>"))
    found = wrapper_of(pages[:4])
    assert html_text.main_text(html_text.read_page(pages[1]), found) == "t1 p1 q1"
    assert html_text.main_text(html_text.read_page(pages[4]), found) == "t9 p9 q9 Support them"
    # Copies of one article are not a template, also if another page lacks one of its texts.
    copies = wrapper_of([pages[0]] * 5 + [page("t5", ["p5", "q5"])])
    assert html_text.main_text(html_text.read_page(pages[0]), copies) == "t0 p0 q0 Support us"


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("<div class='with-sidebar'><article><p>own text</p><div class=ad>x</div></article></div>", "own text"),
        ("<div class=with-sidebar><nav><article>no</article></nav><p>a</p></div>", ""),
        ("<div>the real story</div><section id=comments><article>me too</article></section>", "the real story"),
        ("<article>a</article><div id=comments><article><p>long comment</p></article></div>", "a"),
        ("<article><p>a</p><div class=comments><article>b</article></div></article>", "a"),
    ],
)
def test_a_word_of_an_ancestor_does_not_empty_an_article(raw, expected):
    assert html_text.main_text(html_text.read_page(raw), wrapper_of([raw])) == expected
