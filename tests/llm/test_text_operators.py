import hashlib
import random
import zlib
from array import array

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loglathe.llm import html_extract, sentencepiece_bpe, toxicity
from loglathe.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = sentencepiece_bpe.load(PATH)


# ---- sentencepiece


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_encodes_as_the_library_does(text):
    ids = list(array("i", MODEL.encode(text)))
    assert ids == SP.encode(text)
    assert MODEL.decode(ids) == SP.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(3, 258)), max_size=12))
def test_any_ids_decode_as_the_library_does(ids):
    assert MODEL.decode(ids) == SP.decode(ids)


def test_long_runs_encode_as_the_library_does():
    text = " " * 3000 + "a" * 20000 + "é" * 300 + "=" * 5000
    assert list(array("i", MODEL.encode(text))) == SP.encode(text)


def test_memos_are_bounded():
    memo = sentencepiece_bpe._Memo(lambda k: k * 2, 10)
    assert [memo[i] for i in range(100)] == [i * 2 for i in range(100)]
    assert len(memo) <= 10 and len(memo.old) <= 10


def test_encode_covers_hard_rows(spark, docs):
    out = sentencepiece_bpe.encode(docs.withColumn("Token_IDS".lower(), F.lit(1)), "text").collect()
    assert len(out) == 8
    for r in out:
        ids = SP.encode(r.text or "")
        assert r.token_ids == ids and r.decoded == SP.decode(ids)
    assert sentencepiece_bpe.encode(docs.limit(0), "text").count() == 0


def test_op1_equals_the_library(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op1_sentencepiece"](spark, sf).collect():
        ids = SP.encode(texts.pop(r.doc_id))
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(SP.decode(ids).encode()).hexdigest()
    assert not texts


# ---- html


PAGES = {
    "": "",
    "<p>a": "a",
    "text only &amp; <b>bo</b>ld": "text only & bold",
    '<div class="comments"><p>x</p></div><main><p>A<br>B</p><ul><li>1<li>2</ul><aside>no</aside></main>': "A B 1 2",
    "<div><p>x<table><tr><td>a<td>b</table>": "x a b",
    "<p>a<!-- b": "a",
    '<a href="x>y">t</a> 1 < 2 <p': "t 1 < 2",
    "<article><header><h1>T</h1></header><p>x</p><footer>f</footer></article>": "T x",
    '<script>var a="</p>";</script>z': "z",
    '<body class="has-sidebar"><div id="cookie-notice">c</div><p hidden>q</p>ok': "ok",
    "<nav>m</nav><article><p>&eacute;&#233;&nbsp;  x\n y</p><form><input><label>no</label></form></article>after": "éé x y",
    "</div></p></b>stray": "stray",
}


@pytest.mark.parametrize("page,text", PAGES.items())
def test_pages_by_presentation(page, text):
    assert html_extract.main_text(*html_extract.Parser().parse(page)) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div", ">", "<", "a", '"', "'", "<!--", "-->", "<b>", "</b>", "&amp;", "<li>", "</ul>", "<script>", " "]), max_size=30))
def test_broken_markup_never_fails(pieces):
    html_extract.main_text(*html_extract.Parser().parse("".join(pieces)))


def test_style_tree_drops_what_a_host_repeats(spark):
    rows = [(i, f"http://h.example/{i}", f"<div><div class=x>Subscribe to us<span>now</span></div><div class=y>Story number {i} about {'abc'[i % 3] * i}</div></div>") for i in range(12)]
    rows += [(90, None, None), (91, "http://small.example/", "<div><div class=x>Subscribe to us<span>now</span></div></div>"), (92, "http://h.example/0", rows[0][2])]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "Story number 3 about aaa" and out[92] == out[0]
    assert out[90] == "" and out[91] == ""  # by the shared tree
    empty = spark.createDataFrame([], "page_id long, url string, html string, site long")
    assert html_extract.extract(empty).count() == 0


def test_style_tree_decides_inside_and_beside_articles(spark):
    def page(i, host):
        return f"<article><p>Story {i} of {host}</p><div class=x>Read our offers</div></article><div class=y>Lead {i} of {host}</div><div class=z>The same for all</div>all"

    rows = [(i, f"http://h.example/{i}", page(i, "h")) for i in range(12)] + [(20 + i, f"http://few.example/{i}", page(i, "few")) for i in range(4)]
    rows += [(40 + i, f"http://one.example/{i}", f"<article><p>One story</p></article><nav>{i}</nav>") for i in range(8)]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Story {i} of h Lead {i} of h" for i in range(12))
    assert all(out[20 + i] == f"Story {i} of few Lead {i} of few" for i in range(4))
    assert all(out[40 + i] == "One story" for i in range(8))


NEUTRAL = [f"Tale {i} of the {w} and the {v}" for i in range(15) for w, v in [("abcdefghijklmno"[i] * 9, "xyz"[i % 3] * (i + 3))]]


def neutral(i):
    """A page without an article, whose names say nothing, or the wrong thing."""
    return (
        "<div class=a1><div class=b>Home<div>News</div></div></div>"
        f"<div class='content form-guide'><h1 class=page-header>Head {i}</h1><p>{NEUTRAL[i]}</p><section class=related-work><p>Work {i}</p></section></div>"
        f"<div class=box-{i}><p>We value your privacy</p></div><div class=c>All rights are ours</div>"
    )


def test_only_the_tree_can_tell(spark, monkeypatch):
    rows = [(i, f"http://n.example/{i}", neutral(i)) for i in range(15)] + [(50, "http://other.example/", neutral(0).replace("Tale 0", "Tale 50"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("__host", F.lit("clash")).withColumn("site", F.lit(2))
    want = {i: f"Head {i} {NEUTRAL[i]} Work {i}" for i in range(15)} | {50: f"Head 0 {NEUTRAL[0]} Work 0".replace("Tale 0", "Tale 50")}
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want
    # the same where the verdicts don't fit a broadcast
    monkeypatch.setattr(html_extract, "BROADCAST_NODES", 0)
    monkeypatch.setattr(html_extract, "HOST_PAGES", 4)
    again = html_extract.extract(df)
    assert {r.page_id: r.text for r in again.collect()} == want and sorted(again.columns) == sorted(df.columns)
    # without a tree nothing tells the blocks apart
    assert "We value" in html_extract.main_text(*html_extract.Parser().parse(neutral(3)))


def test_misleading_names(spark):
    rows = [(i, f"http://t.example/{i}", f"<div class=story><p>{x} with a <span class=notice-period>notice</span> inside</p></div><article class=teaser>Read the other one</article>") for i, x in enumerate(NEUTRAL)]
    rows += [(50 + i, f"http://f.example/{i}", f"<form id=aspnet><div class=menu>m</div><p>{x} once more</p></form>") for i, x in enumerate(NEUTRAL)]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, x in enumerate(NEUTRAL):
        assert out[i] == f"{x} with a notice inside"
        assert out[50 + i] == f"{x} once more"


def test_unclosed_raw_elements_do_not_swallow_the_page():
    for page in ("<svg/><p>a", "<svg><p>a", "<iframe src=x><p>a", "<noscript><p>a", "<template><p>a</p>"):
        text = html_extract.main_text(*html_extract.Parser().parse(page))
        assert text == "a", page
    assert html_extract.main_text(*html_extract.Parser().parse("b<script>x<p>a")) == "b"


def test_very_long_pages(spark):
    page = "<p>" + "word " * 400_000 + "</p>" + "<svg>" * 2000 + "<div>" * 3000 + "deep"
    df = spark.createDataFrame([(1, "http://l.example/", page), (2, "http://l.example/2", "")], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert out[1] == " ".join(["word"] * 400_000 + ["deep"]) and out[2] == ""


def test_op2_gives_every_article(spark, sf):
    import html as h
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op2_html_extract"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        blocks = [" ".join(h.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == " ".join(x for x in blocks if x) and r.n_chars == len(r.text)


# ---- toxicity


def test_folding():
    assert toxicity.fold("Stup1d! Ідіот ｌ0ser").split() == ["stupid", "idiot", "ioser"]
    assert toxicity.without_diacritics(toxicity.fold("ÏDIÓT")).split() == ["idiot"]


@given(st.text(max_size=50))
def test_places_stay_the_same_without_diacritics(text):
    folded = toxicity.fold(text)
    assert len(toxicity.without_diacritics(folded)) == len(folded)


def test_hits_exceptions_and_length():
    m = toxicity.Matcher(toxicity.Lexicon(toxicity.default_entries(), toxicity.EXCEPTIONS))
    assert m.x("you 1d10t") == m.x("you idiot") > 0
    assert m.x("the trash can") == 0 < m.x("the trash heap")
    assert m.x("stupidity") == 0 and m.x("") == 0
    assert m.x("idiot " + "word " * 2000) < m.x("idiot word")


def test_closed_entries_keep_the_longest_form():
    assert toxicity.closed({" tra": (5.0, 10), " trash": (5.0, 10), " trash ": (5.0, 10), " vequ": (5.0, 50), " vequx": (5.2, 5)}) == {" trash ": 5.0, " vequ": 5.0}


def labelled(spark, n=600):
    rng = random.Random(5)
    words = ["the", "of", "and", "river", "house", "green", "walk", "stone"]
    rows = []
    for i in range(n):
        bad = i % 5 == 1
        body = [rng.choice(words) + rng.choice("abcdefgh") for _ in range(30)]
        if bad:
            body[7] = "zorgl" + rng.choice("abcdefgh")
        rows.append((i, " ".join(body), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_lexicon_is_learned_and_held_out_rows_are_right(spark):
    docs, labels = labelled(spark)
    rows = toxicity.scored(docs.withColumn("score", F.lit("x")), labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(held) > 80
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)


def test_scores_of_hard_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.scored(docs, none).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert toxicity.scored(docs.limit(0), none).count() == 0


def test_contradicting_labels_and_shared_ids(spark):
    docs, labels = labelled(spark, 300)
    other = labels.where("toxic = 1").select("doc_id", F.lit(0).alias("toxic"))
    again = docs.unionByName(docs.limit(10)).unionByName(spark.createDataFrame([(1, None), (None, "x")], "doc_id long, text string"))
    one = {(r.doc_id, r.text): r.score for r in toxicity.scored(docs, labels).collect()}
    two = toxicity.scored(again, labels.unionByName(other).unionByName(labels.limit(50))).collect()
    assert len(two) == 312 and all(0 <= r.score <= 1 for r in two)
    assert sum(abs(one[r.doc_id, r.text] - r.score) < 0.2 for r in two if (r.doc_id, r.text) in one) >= 300


def test_op9_on_the_given_labels(spark, sf):
    folder = sf.replace("sf0.001", "sf0.1")
    rows = QUERIES["op9_toxicity"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    hits = sum(p and t for p, t in held)
    assert len(held) > 500 and hits >= 0.9 * sum(t for _, t in held) and hits >= 0.9 * sum(p for p, _ in held)
