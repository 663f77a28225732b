"""WARC salvage, site style trees and chat trees."""

from __future__ import annotations

import gzip
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seasonspark.llm import chat, components, style_tree, warc
from seasonspark.llm.scratch import Scratch

PAGES = "page_id long, url string, html string, host string"


def written(spark, rows):
    folder = Scratch(spark, "test").path("warc")
    return warc.write_pages(spark.createDataFrame(rows, PAGES).repartition(3), folder)


def test_revisits(spark):
    big, small = "é" * 60, "x" * 99
    rows = [(5, "http://a/ b", big, "h"), (2, None, big, "h"), (9, "u", big, "h"), (2, None, big, "h"), (None, "u", big, "h"), (1, "u", small, "h"), (3, "u", small, "h"), (4, "u", None, "h"), (6, "u", "", "h")]
    got = warc.read_archives(written(spark, rows)).collect()
    assert {r.kind for r in got} == {"record"}
    seen = sorted((r.record_id, r.type, r.refers_to, r.entity_length) for r in got)
    urn = lambda i: f"<urn:page:{i}>"
    assert seen == sorted([
        (urn(5), "revisit", urn(2), 120), (urn(2), "response", None, 120), (urn(2), "response", None, 120), (urn(9), "revisit", urn(2), 120), (urn("null"), "revisit", urn(2), 120),
        (urn(1), "response", None, 99), (urn(3), "response", None, 99), (urn(4), "response", None, 0), (urn(6), "response", None, 0),
    ])
    for r in got:
        if r.type == "response":
            assert r.payload_digest == "sha256:" + hashlib.sha256(r.payload).hexdigest() and len(r.payload) == r.entity_length
        else:
            assert r.payload == b"" and r.payload_digest == "sha256:" + hashlib.sha256(big.encode()).hexdigest()
    assert warc.read_archives(written(spark, [])).count() == 0


def records(n):
    return [warc.record("response", f"<urn:page:{i}>", "http://h/", hashlib.sha256(b"%d" % i * i).hexdigest(), len(b"%d" % i * i), b"%d" % i * i, None, "2024-01-01T00:00:00Z") for i in range(n)]


def salvage(path):
    s = warc.Salvager(f"file://{path}")
    found = list(s)
    s.close()
    return found


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("chunk", [64, 1 << 18])
def test_damage_is_quarantined_and_the_rest_recovered(tmp_path, monkeypatch, plain, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    parts = [gzip.decompress(r) for r in records(30)] if plain else records(30)
    parts[3] = b"garbage \x1f\x8b\x08 WARC/1. more " * 9
    parts[7] = parts[7][: len(parts[7]) // 2]
    parts[11] = parts[11][:-8] + bytes([parts[11][-8] ^ 255]) + parts[11][-7:]
    parts[29] = parts[29][:-20]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    found = salvage(tmp_path / "a.warc")
    ids = [f.headers["warc-record-id"] for f in found if f.headers]
    assert ids == [f"<urn:page:{i}>" for i in range(30) if i not in (3, 7, 11, 29)]
    assert [f.offset for f in found] == [0, *(f.offset + f.length for f in found[:-1])]
    assert found[-1].offset + found[-1].length == sum(map(len, parts))
    assert sum(f.headers is None for f in found) == 4


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_any_single_damage_costs_few_records(tmp_path_factory, seed):
    rng, data = random.Random(seed), bytearray(b"".join(records(12)))
    at = rng.randrange(len(data))
    data[at] ^= 1 << rng.randrange(8)
    path = tmp_path_factory.mktemp("w") / "a.warc.gz"
    path.write_bytes(bytes(data))
    found = salvage(path)
    assert sum(f.headers is not None for f in found) >= 11
    assert sum(f.length for f in found) == len(data)


def test_salvage_reads_gaps_as_rows(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"junk" + records(1)[0])
    (tmp_path / "empty.warc").write_bytes(b"")
    df = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("a.warc.gz", "empty.warc")], "uri string")
    got = sorted((r.kind, r.offset, r.length) for r in warc.read_archives(df).collect())
    assert got[0] == ("gap", 0, 4) and len(got) == 2


FRAME = '<html><head><title>T</title><style>a</style><script>var x="</p><p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></ul></nav>{}<footer>&copy; us</footer>'


@pytest.mark.parametrize(("html", "want"), [
    (None, ""), ("", ""), ("just text &amp; more", "just text & more"),
    (FRAME.format("<article><h1>A  B</h1><p><b>One.<br><p>T<i>w</i>o&nbsp;x &am</p></article>"), "A B One. Two x &am"),
    (FRAME.format('<div class="ad">buy</div><main><p>x &lt; y</p><aside>s</aside><div id="comments"><p>c</p></div><form>f<input></form></main>'), "x < y"),
    (FRAME.format('<div class="story"><p>Text <!-- no --> here</p></div><div class="cookie-notice">ok</div><div class="side-bar">s</div>'), "Text here"),
    (FRAME.format("<header>site</header><article><header><h1>Title</h1></header><p>p</p><footer>f</footer></article>"), "Title p"),
    ("<article><p>a < b and 1<2</p><p>cut<a hre", "a < b and 1<2 cut"),
    ("<ARTICLE><TABLE><tr><td>1<td>2<tr><td>3</TABLE></ARTICLE>", "1 2 3"),
    ("<article>&#65;&#x42;&copy &notit; &#0;</article>", "AB© ¬it; \ufffd"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
])
def test_main_text(html, want):
    assert style_tree.main_text(html or "") == want


@pytest.mark.parametrize(("attributes", "kept"), [
    ('class="sidebar"', False), ("id=cookie-notice", False), ("hidden", False), ("role='navigation'", False), ('class="story"', True),
    ('data-x="hidden class=ad"', True),
])
def test_long_attributes_are_read(attributes, kept):
    for page in ('<article><p>Text</p><div style="{0}" {1} data-y="{0}"><p>aside</p></div></article>', '<p>Text</p><div {1} srcset="{0}">aside</div>'):
        got = style_tree.main_text(page.format("overflow:hidden;" * 60, attributes))
        assert got == ("Text aside" if kept else "Text")


def test_low_importance_branches_go(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    body = lambda: " ".join(word() for _ in range(20))
    texts = [body() for _ in range(40)]
    rows = [(i, f"http://h.example/{i}", f"<body><div class=top><p>Welcome to us</p></div><div class=text><p>{t}</p></div><div class=last><span>All the same</span></div></body>", "x") for i, t in enumerate(texts)]
    rows += [(100, "http://other.example/", "<div class=top><p>Welcome to us</p></div>", "x"), (101, None, None, "x"), (102, "no url", "<p>a</p>", "x"), (100, "http://other.example/", "<p>b</p>", "x")]
    df = spark.createDataFrame(rows, PAGES)
    for limit in (100_000, 0):
        got = sorted((r.page_id, r.url, r.text) for r in style_tree.extract(df, broadcast_paths=limit).collect() if r.url is not None)
        assert [t for i, _, t in got if i < 40] == texts
        assert [t for i, _, t in got if i >= 100] == ["Welcome to us", "b", "a"]
    assert style_tree.extract(df).where("page_id = 101").first().text == ""
    assert style_tree.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_text_beside_an_article_is_judged_by_the_tree(spark):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20)) for _ in range(20)]
    articles = ["", '<article><img src="a.png"></article>', "<article><p>Teaser</p></article>", "<main></main>"]
    rows = [(i, f"http://h.example/{i}", f"<div class=top><p>Welcome to us</p></div>{articles[i % 4]}<div class=text><p>{t}</p></div>", "x") for i, t in enumerate(texts)]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: ("Teaser " if i % 4 == 2 else "") + t for i, t in enumerate(texts)}


def sentence(rng, n=20):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def by_tree_and_by_name(spark, pages):
    rows = [(i, f"http://h.example/{i}", p, "x") for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, PAGES)).collect()}
    return [got[i] for i in range(len(pages))], [style_tree.main_text(p) for p in pages]


def test_the_tree_decides_within_articles(spark):
    rng = random.Random(2)
    texts, notes = [sentence(rng) for _ in range(30)], [sentence(rng, 5) for _ in range(30)]
    pages = [f'<article><h1>Daily news</h1><p>{t}</p><div class="x1">Read us every day</div><p class="notice">{n}</p><div class="search-results">Hits <i>here</i></div></article>' for t, n in zip(texts, notes, strict=True)]
    tree, names = by_tree_and_by_name(spark, pages)
    assert tree == [f"Daily news {t} {n}" for t, n in zip(texts, notes, strict=True)]
    assert names == [f"Daily news {t} Read us every day {n} Hits here" for t, n in zip(texts, notes, strict=True)]


def test_copies_of_an_article_are_no_template(spark):
    rng = random.Random(3)
    page = lambda t: f"<nav><a href=/>{sentence(rng, 3)}</a></nav><div class=top>Welcome</div><article><h1>T</h1><section><p>{t}</p></section></article>"
    same = sentence(rng)
    tree, _ = by_tree_and_by_name(spark, [page(same) for _ in range(25)] + [page(sentence(rng)) for _ in range(5)])
    assert tree[:25] == [f"T {same}"] * 25 and all(t.startswith("T ") for t in tree[25:])
    tree, _ = by_tree_and_by_name(spark, ["<body><div><p>All the same</p></div></body>"] * 30)
    assert tree == ["All the same"] * 30


def test_names_do_not_decide_alone(spark):
    rng = random.Random(4)
    texts = [sentence(rng, 60) for _ in range(30)]
    tree, names = by_tree_and_by_name(spark, [f'<div class="social"><p>{t}</p></div><div class="promo"><p>{sentence(rng, 4)}</p></div>' for t in texts])
    assert tree == texts and set(names) == {""}  # a named block that holds most of the text
    links = "".join(f"<li><a href=/{k}>{{}}</a></li>" for k in range(4))
    tree, names = by_tree_and_by_name(spark, [f"<ul class=all>{links.format(*(sentence(rng, 2) for _ in range(4)))}</ul><div class=story><p>{t}</p></div>" for t in texts])
    assert tree == texts and all(len(n) > len(t) for n, t in zip(names, texts, strict=True))  # an unnamed menu that varies


@pytest.mark.parametrize(("html", "want"), [
    ('<p><a title="x > y">link</a> t</p>', "link t"), ("<p class=a title='b > c' d>it's</p><p don't>q</p>", "it's q"), ('<p x="unclosed>text</p>', "text"),
    ('<article><p>Teaser</p></article><div class="story">Story</div>', "Teaser Story"), ("<!-->x<!-- y --!>z", "xz"), ("a</>b</ c>d<!doctype x>", "abd"), ("x<!-- cut <p>y", "x"),
])
def test_markup_is_told_from_text(html, want):
    assert style_tree.main_text(html) == want


def test_odd_markup_takes_linear_time():
    for html in ("<a <b " * 100_000, '<p x="y' * 100_000, "<!-- " * 100_000, "<div>" * 100_000 + "x", "<" * 100_000, "<p a='" * 50_000):
        assert len(style_tree.nodes(html)) <= 100_001


def test_pages_with_other_columns(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, None, None, "x"), (None, "u", "<p>" + "long " * 200_000, "x")]
    wide = spark.createDataFrame(rows, PAGES).select("*", *(F.lit("x").alias(n) for n in "text path paths salt id body digest first n uri kind prior".split()))
    assert sorted((r.page_id or 0, r.url, len(r.text)) for r in style_tree.extract(wide).collect() if r.url) == [(0, "u", 999_999), (1, "u", 1)]
    got = warc.read_archives(warc.write_pages(wide, Scratch(spark, "test").path("warc"))).collect()
    assert sorted(len(r.payload) for r in got) == [0, 8, 1_000_003]


@pytest.mark.parametrize("bound", [300_000, 0])
def test_shared_payloads_beyond_the_broadcast(spark, monkeypatch, bound):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(components, "HOT_ROWS", 20)
    rows = [(i, "u", f"{'hot' if i % 3 else i % 50} " * 60, "x") for i in range(300)]
    got = warc.read_archives(written(spark, rows)).collect()
    first = {}
    for i, _, body, _ in rows:
        first.setdefault(body, i)
    want = {(f"<urn:page:{i}>", None if first[b] == i else f"<urn:page:{first[b]}>") for i, _, b, _ in rows}
    assert {(r.record_id, r.refers_to) for r in got} == want and len(got) == 300


def test_damage_is_an_error_where_the_number_of_records_is_known(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(records(3)))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(records(2)) + b"junk")
    of = lambda name, n: warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/{name}", n)], "uri string, records long"), expected=F.col("records"))
    assert of("a.warc.gz", 3).count() == 3
    for name, n in (("a.warc.gz", 4), ("b.warc.gz", 2)):
        with pytest.raises(Exception, match="were written"):
            of(name, n).collect()


def test_headers_of_any_length(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 1 << 12)
    made = [warc.record("response", f"<urn:page:{i}>", "http://h/" + "x" * n, "d", 1, b"a", None, "2024-01-01T00:00:00Z") for i, n in enumerate((10, 2_500_000, 10))]
    (tmp_path / "a.warc").write_bytes(b"".join(map(gzip.decompress, made)))
    assert [f.headers["warc-record-id"] for f in salvage(tmp_path / "a.warc")] == [f"<urn:page:{i}>" for i in range(3)]


TEXTS = st.lists(st.sampled_from(["\\", "#", "###", "</turn>", "\n", "### User: ", "a", "é", ":", "<", "/turn>"]), max_size=12).map("".join) | st.text(max_size=20)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "User", "tool", "", "a:b\n", "=x", "%3A"]), TEXTS), max_size=6))
def test_formatting_is_reversible(turns):
    made, spans = chat.render(turns)
    assert chat.parse(made) == turns
    assert "".join(chat.unescape(made[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")
    body = [chat.escape(t) for _, t in turns]
    assert all("</turn>" not in b.replace("\\</turn>", "") for b in body)


TREE = "tree string, node long, parent long, role string, text string, score double"


def formatted(spark, rows, **options):
    df = spark.createDataFrame(rows, TREE)
    made = chat.format_trees(df, tree=F.col("tree"), node=F.col("node"), parent=F.col("parent"), role=F.col("role"), text=F.col("text"), score=F.col("score"), **options)
    return sorted((r.tree, r["rank"], [t.text for t in r.turns]) for r in chat.read_back(made).collect())


def test_best_branches(spark):
    rows = [
        ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "low", 1.0), ("t", 3, 1, "assistant", "high", 5.0), ("t", 4, 3, "user", "next", 2.0), ("t", 5, 3, "user", "other", 2.0),
        ("u", 1, 77, "user", "orphan", None), ("v", 1, 2, "user", "cycle", 1.0), ("v", 2, 1, "user", "cycle", 1.0), ("w", 1, None, None, None, 1.0), (None, 1, None, "user", "x", 1.0),
    ]
    assert formatted(spark, rows) == [("null", 1, ["x"]), ("t", 1, ["q", "high", "next"]), ("u", 1, ["orphan"]), ("w", 1, [""])]
    every = [r for r in formatted(spark, rows, best=None) if r[0] == "t"]
    assert every == [("t", 1, ["q", "high", "next"]), ("t", 2, ["q", "high", "other"]), ("t", 3, ["q", "low"])]
    assert formatted(spark, []) == []


def test_long_chain_and_repeats(spark):
    rows = [("t", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(130)] + [("t", 5, 4, "user", "5b", 0.0)]
    got = formatted(spark, rows)
    assert got == [("t", 1, [*(str(i) for i in range(6)), "5b", *(str(i) for i in range(6, 130))])]


def test_chain_of_any_length_and_cycles_beside_it(spark):
    n = 140_000
    chain = spark.range(n).selectExpr("'t' AS tree", "id AS node", "CASE WHEN id > 0 THEN id - 1 END AS parent", "0.0D AS score")
    loop = spark.createDataFrame([("t", n + 1, n + 2, 9.0), ("t", n + 2, n + 1, 9.0), ("t", n + 3, n + 1, 9.0), ("u", 1, 2, 0.0), ("u", 2, 1, 0.0), ("u", 3, 2, 0.0)], "tree string, node long, parent long, score double")
    got = chat.branches(chain.unionByName(loop), Scratch(spark, "test"), best=None)
    assert got.agg(F.count("*"), F.countDistinct("node"), F.max("back"), F.min("leaf"), F.max("leaf")).first() == (n, n, n - 1, n - 1, n - 1)


def test_chat_rows_with_other_columns_and_a_long_text(spark):
    rows = [("t", 1, None, "user", "x" * 2_000_000, 0.0), ("t", 2, 1, "assistant", "</turn>" * 1000, 0.0)]
    df = spark.createDataFrame(rows, TREE).select("*", *(F.lit(1).alias(n) for n in ("up", "leaf", "back", "rank", "turns", "jumps")))
    made = chat.format_trees(df, tree=F.col("tree"), node=F.col("node"), parent=F.col("parent"), role=F.col("role"), text=F.col("text"))
    assert [[len(t.text) for t in r.turns] for r in chat.read_back(made).collect()] == [[2_000_000, 7000]]
