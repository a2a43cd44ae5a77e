"""Page extraction, tokens, quality rules, toxicity and language."""

from __future__ import annotations

import hashlib
import random
import re
import time

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.llm import language_id, queries, site_style_tree, toxicity
from quillmesh.llm.bpe import PairIndexBPE, bpe_encode_decode
from quillmesh.llm.quality_rules import quality_rules

SPEC = queries.tokenizer_spec()


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_str(SPEC)


@pytest.fixture(scope="module")
def model():
    return PairIndexBPE(SPEC)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85 　'srtvemld<|endoftext|>aaaa19²"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_bpe_equals_the_library(library, model, text):
    ids = model.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert model.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_special_tokens_and_runs(library, model):
    for text in ("", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" * 3000, " " * 500 + "x", "\n\n \n", "ab" * 999):
        assert model.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_rows(library, edge, edge_rows, empty):
    got = sorted((tuple(r) for r in bpe_encode_decode(edge, SPEC).collect()), key=str)
    want = []
    for i, t, *_ in edge_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe_encode_decode(empty, SPEC).count() == 0
    whole = bpe_encode_decode(edge, SPEC, with_ids=True, with_text=True).where("doc_id = 14").first()
    assert whole.decoded == edge_rows[13][1] and len(whole.ids) == whole.n_tokens


def test_bpe_forgets_without_changing(library, monkeypatch):
    from quillmesh.llm import bpe

    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 3)
    own = bpe.PairIndexBPE(SPEC)
    for text in ("one two three four five", "six seven one two", "one"):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_quality_counts(edge, edge_rows, empty):
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules(edge).collect())
    assert got == sorted(brute.quality(t) for _, t, *_ in edge_rows)
    assert quality_rules(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_quality_counts_on_repetitive_texts(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["a", "b", " ", "  ", "\n", "#", "\t"]) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules(df).collect()}
    assert got == {i: brute.quality(t) for i, t in enumerate(texts)}


def test_quality_verdict(spark):
    clean = " ".join(["The river of stones was in the valley and a tree by the water"] + [f"grows{k} up{k} and out{k} to sea{k}" for k in range(30)])
    rows = [(1, clean), (2, "too short"), (3, " ".join(["same words again"] * 40)), (4, " ".join(f"w{k}%%%" for k in range(80))), (5, None)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, False), 5: (True, False)}


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header>No</header><nav><ul><li>No</li></ul></nav><!-- <p>no</p> --><div class="cookie-banner">No</div><div id='sidebar'>No</div>
<article><h1>A &amp; B</h1><p>one <b>two</b>three<p>four&nbsp;&#228;
 five<br>six<ul><li>x<li>y</ul><div class="share-buttons">No</div><table><tr><td>c<td>d</table><form>No <input></form></article>
<section id="comments"><p>No</p></section><aside>No</aside><div style="display: none">No</div><footer>No</footer>"""


def test_page_text():
    assert site_style_tree.main_text(PAGE) == "A & B one twothree four ä five six x y c d"


def test_layout_names_are_not_furniture():
    page = '<body class="has-sidebar"><div class="layout no-sidebar with-comments"><p>kept</p><div class="sidebar">gone</div></div>'
    assert site_style_tree.main_text(page) == "kept"
    assert site_style_tree.main_text('<div class="widget"><p>all there is</p><nav>x</nav></div>') == "all there is"


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("plain a<b text", "plain a"), ("<p>un<b>closed<p>next", "unclosed next"), ("<div>a</div>b<script>never closed", "a b"), ("<![CDATA[x]]>", "x"), ("a < b > c", "a < b > c"), ("<p a='>'>t</p>", "t"), ("</p></div>t", "t")])
def test_odd_pages(page, text):
    assert site_style_tree.main_text(page) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-ab \"'=pdivtr&;[]", max_size=120))
def test_any_page_is_read(page):
    site_style_tree.main_text(page)
    site_style_tree.style_nodes(page)


def test_long_hostile_pages_are_linear():
    """A megabyte of markup that invites rescanning is read within seconds, each way."""
    for page in ('<a "<a ' * 150_000, "<a <a " * 160_000, "<a b='" * 160_000, "<div>" * 200_000 + "x", "<b>" * 150_000 + "</i>" * 150_000, "<script/>" * 110_000, "<p><b>" * 160_000, "<!-" * 330_000):
        began = time.process_time()
        site_style_tree.main_text(page)
        site_style_tree.style_nodes(page)
        assert time.process_time() - began < 30
    deep = "<div>" * 100_000 + "text" + "</div>" * 100_000 + "<p>after"
    assert site_style_tree.main_text(deep) == "text after"
    assert site_style_tree.main_text("<article><p>" + "word " * 300_000 + "</article>") == ("word " * 300_000).strip()


def test_copies_of_a_page_carry_no_weight(spark):
    """Most pages of a host are copies of one article; the bodies of the others stay."""
    page = lambda k: f"<html><body><article><h1>title {k}</h1><div class=body>body {k}</div></article></body></html>"
    pages = [(k, "http://a.example/x", page(k if k < 24 else 24)) for k in range(120)]
    got = site_style_tree.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).collect()
    assert {r.page_id: r.text for r in got} == {k: f"title {min(k, 24)} body {min(k, 24)}" for k in range(120)}


def test_low_importance_branches_go(spark):
    rng = random.Random(1)
    body = lambda: " ".join(str(rng.random()) for _ in range(12))
    pages = [(k, "http://User@Site.org:80/p", f"<body><div class=teaser><p>Same words on every page</p></div><div class=main><p>{b}</p></div></body>") for k, b in enumerate([body() for _ in range(24)])]
    pages += [(50 + k, "http://copies.org/", "<body><div class=x><p>All alike</p></div></body>") for k in range(8)] + [(90, None, "<p>t</p>"), (91, "x", None), (90, None, "<p>t</p>")]
    got = site_style_tree.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))).collect()
    assert len(got) == len(pages)
    text = {r.page_id: r.text for r in got}
    assert all("Same" not in text[k] and len(text[k]) > 50 for k in range(24))
    assert text[50] == "All alike" and text[90] == "t" and text[91] == "" and {r.n_chars for r in got if r.page_id == 90} == {1}
    assert site_style_tree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_importance_decides_on_declared_furniture(spark):
    """An aside more varied than the content branch stays; a menu of the same shape on every page goes."""
    rng = random.Random(2)
    some = lambda tag: "".join(f"<{tag}>{rng.random()}</{tag}>" + rng.choice(["", "<hr>", f"<b>{rng.random()}</b>", f"<i>{rng.random()}</i>"]) for _ in range(rng.randint(2, 9)))
    pages = [(k, "http://site.org/", f"<body><nav><ul><li>{rng.random()}</li></ul></nav><aside>{some('p')}</aside><div><p>{rng.random()}</p></div></body>") for k in range(40)]
    got = {r.page_id: r.text for r in site_style_tree.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k, _, html in pages:
        nav, rest = html.split("</nav>")
        assert got[k] == " ".join(plain_text(rest)) and plain_text(nav)[0] not in got[k]


def plain_text(html):
    return [x for x in re.sub(r"<[^>]*>", " ", html).split() if x]


def test_pages_against_a_plain_dom_walk(spark, monkeypatch):
    """The driver's pages against the standard library's parser, and what the style tree does there."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r.html for r in pages.collect()}
    want = {i: brute.article(h) for i, h in rows.items()}
    assert {r.page_id: r.text for r in site_style_tree.extract(pages).collect()} == want
    # Without a content branch to compare with, no furniture is unimportant: the tree is off.
    monkeypatch.setattr(site_style_tree, "low_bar", lambda: F.lit(-2.0))
    off = {r.page_id: r.text for r in site_style_tree.extract(pages).collect()}
    assert all(off[i] != t for i, t in want.items())


def test_hosts(spark):
    urls = ["http://A.b:8/x", "//c.d/y", "https://u:p@E.f?q", "none", None, "http://"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(site_style_tree.host_of(F.col("url"))).collect()]
    assert got == ["a.b", "c.d", "e.f", "", "", ""]


def _toxic_corpus(n=400):
    rng = random.Random(3)
    usual = ["".join(rng.choice(["ba", "lo", "ter", "min", "ka", "ru"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    bad = ["scoundrel", "vermin", "worthlessly", "numbskull"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(usual) for _ in range(rng.randint(30, 90))]
        toxic = int(i % 5 == 0)
        for _ in range(4 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, edge, empty):
    rows, labels = _toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    table = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, table)
    got = {r.doc_id: r for r in toxicity.classify(docs, model).collect()}
    held = [i for i, _, _ in labels if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 50 and np.mean([got[i].predicted == (i % 5 == 0) for i in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    on_edge = toxicity.classify(edge, model).collect()
    assert len(on_edge) == edge.count() and toxicity.classify(empty, model).count() == 0
    assert {r.doc_id for r in toxicity.keep_clean(docs, model).collect()} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.keep_clean(edge, model).columns == edge.columns
    nobody = toxicity.train(docs, table.where("toxic = 0"))
    assert nobody is None and {r.score for r in toxicity.classify(docs, nobody).collect()} == {0.0}


def test_language_on_held_out_rows(spark, edge, empty):
    rng = random.Random(4)
    parts = {"aa": ["the", "and", "ing", "wh"], "bb": ["der", "sch", "ung", "ü"], "cc": ["ción", "os", "ll", "que"]}
    rows = []
    for i in range(360):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randint(5, 90))), lang, "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    net = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, net).collect()}
    held = [r for r in rows if __import__("zlib").crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 50 and np.mean([got[r[0]].lang_pred == r[2] for r in held]) >= 0.97
    for r in language_id.predict(edge, net).collect():
        assert 0 <= r.score <= 1.0 and (r.lang_pred in parts or r.lang_pred == "und")
        if r.doc_id in (4, 5, 6, 18):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert language_id.predict(empty, net).count() == 0
    assert language_id.train(empty) is None and {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


def test_long_texts_are_labelled_whole():
    net = language_id.fit(["abab " * 40, "zxzx " * 40], ["a", "z"], steps=60)
    p = language_id.probabilities(net, [b"abab " * 3000, b"abab " * 1500 + b"zxzx " * 1500, b"q"])
    assert p[0, 0] > 0.9 and 0.4 < p[1, 0] < 0.6 and abs(p.sum(axis=1) - 1).max() < 1e-3


def test_backpropagation_matches_differences():
    rng = np.random.default_rng(0)
    h = language_id.HIDDEN
    p = {"table": rng.normal(0, 0.5, (2, 257, 3 * h)), "recur": rng.normal(0, 0.5, (2, h, 3 * h)), "out": rng.normal(0, 0.5, (2 * h, 3)), "bias": rng.normal(size=3)}
    codes, label = rng.integers(97, 105, (9, 4)), np.array([0, 2, 1, 1])
    codes[6:, 1] = 256
    _, grad = language_id.gradients(p, codes, label)
    for name, v in p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in v.shape)
            if name == "table":
                at = (at[0], int(codes[rng.integers(0, 6), 0]), at[2])
            keep, side = v[at], []
            for step in (1e-6, -1e-6):
                v[at] = keep + step
                side.append(language_id.gradients(p, codes, label)[0])
            v[at] = keep
            assert grad[name][at] == pytest.approx((side[0] - side[1]) / 2e-6, abs=1e-7), name


def test_forward_against_a_plain_network():
    """Pooled probabilities of short and long texts against a network that reads one byte at a time."""
    net = language_id.fit(["abab " * 40, "zxzx " * 40, "qqw " * 40], ["a", "z", "q"], steps=30)
    for raw in (b"a", b"abzx qq", b"zxzx " * 30):
        assert np.allclose(language_id.probabilities(net, [raw])[0], brute.language(net, raw), atol=1e-4)
    long = b"abab " * 100 + b"qqw " * 100  # several windows, each with a warm-up
    assert np.allclose(language_id.probabilities(net, [long])[0], brute.language(net, long), atol=0.02)


def test_seventy_languages_are_taught(spark):
    """All languages there are, whatever one id or one language holds."""
    rows = [(k, f"text{k % 70} " * 5, f"l{k % 70:02}", "s") for k in range(700)] + [(5000, f"flood {k} of rows", "aa", "s") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taught = []
    language_id_fit = language_id.fit
    try:
        language_id.fit = lambda texts, langs: taught.extend(zip(texts, langs)) or language_id_fit(texts, langs, steps=2)
        net = language_id.train(docs)
    finally:
        language_id.fit = language_id_fit
    assert net.languages == ["aa", *[f"l{k:02}" for k in range(70)]] and sum(g == "aa" for _, g in taught) <= language_id.CUTS


def test_toxicity_against_a_plain_scorer(spark):
    """Scores of the operator against one that compresses every word of a text afresh, and repeated ids in the labels."""
    rows, labels = _toxic_corpus(300)
    docs = spark.createDataFrame([*rows, (0, "another text of the first id", "en", "s")], "doc_id long, text string, lang string, source string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.doc_id, r.score) for r in toxicity.classify(docs, model).collect()}
    want = [(r.doc_id, brute.toxic_score(model, r.text)) for r in docs.collect()]
    assert len(got) == len(want) and all(any(i == j and abs(a - b) < 1e-9 for j, b in got) for i, a in want)


def test_toxic_words_behind_a_long_text_teach(spark):
    """Whole texts teach: the telling words stand behind 30,000 characters."""
    rows, labels = _toxic_corpus(300)
    rows = [(i, "ba lo ter " * 3000 + t, g, s) for i, t, g, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert b"numbskull" in model.toxic
    got = {r.doc_id: r.predicted for r in toxicity.classify(docs, model).collect()}
    assert np.mean([got[i] == x for i, _, x in labels]) >= 0.97


def test_quality_counts_when_hashes_collide(spark, monkeypatch):
    """With all hashes alike every window is a suspect, and only equal words count."""
    from quillmesh.llm import quality_rules as module

    real = F.xxhash64
    monkeypatch.setattr(module.F, "xxhash64", lambda *a: real(F.lit(1)))
    texts = ["a b c d a b c", "a b c a b d a b c a b d", "x y z w", "", "p q p q p q p", "a b c d e f g h i"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in module.figures(df).select("doc_id", "n_repeat_words").collect()}
    assert got == {i: brute.quality(t)[4] for i, t in enumerate(texts)}
