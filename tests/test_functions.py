"""Literal rows for the text, URL, HTML and JSON-LD functions."""

import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from answerscope.functions import core as C
from answerscope.functions import html as H
from answerscope.functions import jsonld as J
from answerscope.functions import text as T
from answerscope.functions import urls as U
from answerscope.operators.readiness import EMAIL, count_figures

L = F.lit


@pytest.mark.parametrize("raw, folded", [
    ("Ünïcode Café", "unicode cafe"), ("ﬁne ½", "fine 1⁄2"), ("a b", "a b"), ("é", "e"), ("𝐀b", "ab"), ("", ""),
])
def test_normalise(one, raw, folded):
    assert one(T.normalise(L(raw))) == folded


def test_name_variants(one):
    v = one(T.name_variants(L("Harbour Roofing"), F.array(L("HR Ltd"), L("x")), L("www.harbour-roofing.example")))
    assert v == ["Harbour Roofing", "HR Ltd", "www.harbour-roofing.example", "harbour-roofing", "Harbour"]
    assert one(T.name_variants(L("Best Tools"), F.array().cast("array<string>"), L("ab.io"))) == ["Best Tools", "ab.io"]


def test_sentences_and_sentence_at(one):
    text = "Try Node.js 4.5 today. It works!  Really?\nNew line here"
    assert one(T.sentences(L(text))) == ["Try Node.js 4.5 today.", "It works!", "Really?", "New line here"]
    for word, want in [("Node", "Try Node.js 4.5 today."), ("works", "It works!"), ("line", "New line here")]:
        assert one(T.sentence_at(L(text), L(text.index(word)))) == want


@pytest.mark.parametrize("sentence, role", [
    ("Acme is the best of them", "recommended"), ("Not the best choice is Acme", "dismissed"),
    ("Good alternatives to Acme exist", "dismissed"), ("Unlike Acme, Beta is the best", "dismissed"),
    ("We avoid Acme", "dismissed"), ("Acme exists", "listed"), ("", "referenced"),
    ("Unlike many things one could name at length here, Acme", "listed"),
])
def test_role(one, sentence, role):
    assert one(T.classify_role(L(sentence), L("Acme"), L(True))) == role


def test_role_outside_lists_is_referenced(one):
    assert one(T.classify_role(L("Acme exists"), L("Acme"), L(False))) == "referenced"


@pytest.mark.parametrize("line, sentence, inside", [
    ("1. Acme", "1. Acme", True), (" 12) Acme", "Acme", True), ("- Acme", "Acme", True), ("• Acme", "Acme", True),
    ("x", "Options include Acme", True), ("x", "Acme, Beta and Gamma", True), ("x", "Acme, Beta, Gamma", True),
    ("x", "Acme, über alles", False), ("x", "Acme or Beta", False), ("x", "Anbieter sind Acme", True),
])
def test_list_context(one, line, sentence, inside):
    assert one(T.in_list_context(L(line), L(sentence))) is inside


def test_sentiment(one):
    assert one(T.score_sentiment(L("great and reliable"))) == pytest.approx(2 / 3)
    assert one(T.score_sentiment(L("unreliable"))) == 0.0  # contains 'reliable' as well
    assert one(T.score_sentiment(L("best top great strong"))) == 1.0


@pytest.mark.parametrize("value, want", [(-0.0005, 0.0), (0.0005, 0.001), (1 / 3, 0.333), (2.5, 2.5)])
def test_round(one, value, want):
    assert one(C.round_half_up(L(value))) == want


def test_words_and_capsule(one):
    assert one(T.word_count(L(" a b\n c "))) == 3
    assert one(T.word_count(L("   "))) == 0
    direct = "A heat pump moves warmth from outside air into a home. It needs power and regular care each year."
    assert one(T.is_answer_capsule(L(direct))) is True
    assert one(T.is_answer_capsule(L("Welcome to " + direct))) is False
    assert one(T.is_answer_capsule(L("Too short."))) is False


@pytest.mark.parametrize("url, host", [
    ("https://www.Shop.example/a", "shop.example"), ("http://shop.example:80/", "shop.example"),
    ("http://shop.example:8080/", "shop.example:8080"), ("https://u:p@shop.example/x", "shop.example"),
    ("shop.example/x", ""), ("mailto:a@b.example", ""), ("https://", ""), ("https://a b.example", ""), (None, ""),
])
def test_host_of(one, url, host):
    assert one(U.host_of(L(url).cast("string"))) == host


@pytest.mark.parametrize("href, want", [
    ("/x?y=1", "https://a.example/x?y=1"), ("x", "https://a.example/d/x"), ("../x", "https://a.example/x"),
    ("//B.example", "https://b.example/"), ("?q", "https://a.example/d/p?q"), ("http://c.example", "http://c.example/"),
    ("./é", "https://a.example/d/%C3%A9"),
])
def test_resolve(one, href, want):
    assert one(U.resolve_url(L(href), L("https://a.example/d/p?z#t"))) == want


def test_extract_urls(one):
    text = 'See [x](https://a.example/p?q=1). Also http://b.example:80/../z, not ("https://no.example") https://a.example/p?q=1'
    assert one(U.extract_urls(L(text))) == ["https://a.example/p?q=1", "http://b.example/z"]
    assert one(U.extract_urls(L("no links"))) == []


def test_html_text(one):
    page = ("<!-- c --><style>x</style><h1>Title</h1><p>a&nbsp;b &amp;lt; &#233; &#x1F600; &zz; &#0;</p>"
            "<noscript>n</noscript>c<br/>d   e<template><p>t</p></template>")
    assert one(H.to_text(L(page))) == "Title\n a b &lt; é 😀 &zz; &#0;\n c\nd e"


def test_html_parts(one):
    page = """<title>A &amp;amp; B</title><meta property="og:description" content="og"><meta name='Author' content="x">
    <h2>How <b>so</b>?</h2><h3> </h3><a href="p#f">f</a><a href="/q?a=1&amp;b">q</a><a href="tel:1">t</a>
    <header><p>one two three four five six seven eight</p></header><main><p>short</p><p>alpha beta gamma delta epsilon zeta eta theta</p></main>"""
    assert one(H.title(L(page))) == "A & B"
    assert one(H.description(L(page))) == "og"
    assert one(H.meta(L(page), "author")) == "x"
    assert [tuple(h) for h in one(H.headings(L(page)))] == [(2, "How so ?")]
    assert one(H.links(L(page), L("https://a.example/"))) == ["https://a.example/q?a=1&b"]
    assert one(H.lead_copy(L(page), 3)) == "alpha beta gamma"


LD = '<script type="application/ld+json">%s</script>'


def test_jsonld(one):
    page = (LD % '[{"@type":"A"},{"@type":["http://schema.org/B","C"],"offers":{}}]'
            + LD % '{"@context":"x","@type":"W","@graph":[{"@type":"G1"},{"@graph":[{"@type":"G2","sameAs":["u"]}]}]}'
            + LD % '{"@type":"T",}' + LD % "{bad" + LD % '<![CDATA[{"@type":"D","price":0}]]>' + LD % '"text"')
    assert one(J.schema_types(J.nodes(L(page)))) == ["A", "B", "C", "W", "G1", "G2", "T", "D"]
    facts = one(J.node_facts(J.nodes(L(page))))
    assert [f["priced"] for f in facts] == [False, True, False, False, False, False, False]
    assert [f["has_same_as"] for f in facts] == [False, False, False, False, True, False, False]


def test_slug_hash_grade(one):
    assert one(C.slug(L("My Shop.example/"))) == "my-shop-example"
    assert one(C.hash_id(L("x"), 8)) == "2d711642"
    assert [one(C.grade_for(L(v).cast("double"))) for v in (0.85, 0.7, 0.55, 0.4, 0.1, None)] == ["A", "B", "C", "D", "F", "N/A"]


def quickly(spark, value, column, seconds=4.0):
    """The column over one long text, which must not take time that grows faster than it."""
    df = spark.createDataFrame([(value,)], "html string")
    df = df.select(column.alias("x"))
    df.collect()
    start = time.perf_counter()
    got = df.collect()[0]["x"]
    assert time.perf_counter() - start < seconds
    return got


@pytest.mark.parametrize("text,n", [
    ("1,234", 1), ("1,234,abc", 1), ("1,2,3", 0), ("1,23,456 x 7,890", 2), ("1,1,1,234,5,6", 1), ("12345,12,345", 1), ("1234,567,890", 1), ("1,,234", 0), ("1,234y", 0), ("1,234x", 1), ("1,234,567x", 2),
    ("a1,23,456", 1), ("1.5,2,300", 1), ("$1,1,1,234", 1), ("5% 3.5% 10x $2 million 1,000", 5), ("1,23%", 1), ("1,2345,678", 0), ("1,234567,890", 0), ("1,22,333,4,555,66", 1), ("111,222", 1)])
def test_figures(spark, text, n):
    """Counts of the pattern with a repeated group of any width, worked out by hand."""
    plain = re.compile(r"(?i)(?<![A-Za-z0-9_])\d{1,3}(?:\.\d+)?%|(?<![A-Za-z0-9_])(?:\d{1,3},)+\d{3}(?![A-Za-z0-9_])|\$\s?\d[\d,.]*(?:\s?(?:k|m|bn|billion|million))?\b|(?<![A-Za-z0-9_])\d+x(?![A-Za-z0-9_])")
    assert len(plain.findall(text)) == n
    assert spark.createDataFrame([(text,)], "t string").select(count_figures("t").alias("n")).first()["n"] == n


def test_figures_of_random_numbers(spark):
    plain, rng = re.compile(r"(?<![A-Za-z0-9_])(?:\d{1,3},)+\d{3}(?![A-Za-z0-9_])"), random.Random(6)
    texts = ["".join(rng.choice(["1", "22", "333", "4444", ",", ",", ",", " ", "a"]) for _ in range(14)) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", count_figures("t").alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == {t: len(plain.findall(t)) for t in texts}


def test_long_pages_take_time_in_proportion(spark):
    assert quickly(spark, "1," * 200_000, count_figures("html")) == 0
    assert quickly(spark, "1," * 200_000 + "234", count_figures("html")) == 1
    assert quickly(spark, "x" * 1_000_000, F.col("html").rlike(EMAIL)) is False
    for tag in ("svg", "script"):
        assert quickly(spark, f"a <{tag} " * 20_000, F.length(H.to_text("html"))) > 0
        assert quickly(spark, f"a <{tag}>b" * 20_000, H.to_text("html")).split() == ["a", "ba"] + ["ba"] * 19_998 + ["b"]
    assert quickly(spark, "a < " * 20_000, F.length(H.to_text("html"))) > 0
    assert quickly(spark, "<h2>a" * 20_000, F.size(H.headings("html"))) == 0
    assert quickly(spark, "<h2>a" * 20_000 + "</h2>", F.size(H.headings("html"))) == 1
    assert quickly(spark, "<p>a" * 20_000, F.length(H.lead_copy("html"))) > 0


@pytest.mark.parametrize("page", [
    "<svg>a</svg>b<svg>c", "<svg <svg>a</svg>b", "<script>x</style>y</script>z<style>", "a<!-- b --> c <!-- d", "<svg></script><script></svg>t</script>u",
    "<SVG a=1>x</svg>y</SVG><svg>", "x</svg><svg>a", "<script </script>a</script>b", "1 < 2 <b>c</b> 3 <", "<template><svg></template>a</svg>b"])
def test_marked_start_tags_change_nothing(one, page):
    """Against the plain patterns."""
    s = re.sub(r"(?s)<!--.*?-->", " ", page)
    s = re.sub(r"(?is)<(script|style|noscript|svg|template)(?![A-Za-z0-9_])[^>]*>.*?</\1>", " ", s)
    s = re.sub("<[^>]+>", " ", s)
    assert one(H.to_text(F.lit(page))).split() == s.split()


@pytest.mark.parametrize("depth", range(1, 9))
def test_nested_json_ld(spark, depth):
    body = "[" * depth + '{"@type":"A"},{"@graph":[[{"@type":"B"}],{"@graph":[{"@type":"C"}]}]}' + "]" * depth
    page = f'<script type="application/ld+json">{body}</script><script type="application/ld+json">[]</script>'
    got = spark.createDataFrame([(page,)], "h string").select(F.transform(J.nodes("h"), lambda n: F.to_json(n)).alias("x")).first()["x"]
    assert got == ['{"@type":"A"}', '{"@type":"B"}', '{"@type":"C"}']


def test_every_character_folds_as_nfkd(spark):
    points = [cp for cp in range(1, 0x110000) if not 0xD800 <= cp <= 0xDFFF]
    texts = [(k, "".join(map(chr, points[k:k + 400]))) for k in range(0, len(points), 400)]
    # a dot before each character, so that marks are not put in order beside one another
    spaced = [(k, "".join("." + c for c in t)) for k, t in texts]
    got = dict(spark.createDataFrame(spaced, "k int, t string").select("k", T.normalise("t")).collect())
    lower = dict(spark.createDataFrame([(k, "".join("." + x for c in t for x in [unfolded(c)])) for k, t in texts], "k int, t string").select("k", F.lower("t")).collect())
    assert got == lower


def unfolded(c):
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F)


def test_hangul_is_found_in_either_spelling(one):
    assert one(T.normalise(L("한국어 각 카페"))) == unicodedata.normalize("NFKD", "한국어 각 카페") == one(T.normalise(L(unicodedata.normalize("NFD", "한국어 각 카페"))))


@pytest.mark.parametrize("host", [
    "bücher.example", "BÜCHER.example", "bu\u0308cher.example", "münchen.de", "日本語.jp", "пример.рф", "faß.de", "xn--bcher-kva.example", "a.b:8080",
    "ｅｘａｍｐｌｅ.com", "ñandú.ñ.com", "मेहंदी.भारत", "한국.kr", "ü" * 40 + ".x", "a" * 70 + "ü.x", "他们为什么不说中文.cn", "ליהמהבלתי.il", "", "\U0001F600.la"])
def test_hosts_in_ascii(one, host):
    name = unicodedata.normalize("NFKC", host.lower())
    want = ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in name.split("."))
    assert one(U.ascii_host(L(host))) == want
    assert one(U.same_host(U.ascii_host(L(host)), U.ascii_host(L(want)))) is True


@pytest.mark.parametrize("url, want", [
    ("https://www.Bücher.example/ä?ü#ö", "https://www.xn--bcher-kva.example/ä?ü#ö"), ("http://u:p@bücher.example:81", "http://u:p@xn--bcher-kva.example:81"),
    ("https://a.example/ü", "https://a.example/ü"), ("no url ü", "no url ü"), ("", ""), ("https://ü。com/x", "https://xn--tda.com/x")])
def test_urls_with_ascii_hosts(one, url, want):
    assert one(U.ascii_url(L(url))) == want
    assert one(U.ascii_url(U.ascii_url(L(url)))) == want


def test_site_origin_of_international_names(one):
    assert one(U.site_origin(L("www.Bücher.example/x"))) == "https://www.xn--bcher-kva.example"
