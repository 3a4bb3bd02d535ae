"""Contact details across pages against one text of all pages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from answerscope.operators import contact as C
from answerscope.operators import readiness as I

PHONE = re.compile(r"\+?\d[\d\s().-]{7,}\d")
STREET = re.compile(r"\b\d{1,5}\s+[A-Z][a-zA-Z]+\s+(street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|suite|ste)\b", re.I | re.A)
PIECES = ["", "", " ", "12", "1", "123456", "Main", "Street", "street.", "Main Road", "12 Main", "at 7 Old", "x7 Old", "+41 44", "(0) 12-3", "call 04", "5 or so", "12 34 5", "ab", "St", "st x", "Lane 4", "-", "...", "7"]


def found(texts):
    whole, split = "\n".join(texts), (PHONE, STREET)
    return tuple(bool(p.search(whole)) for p in split), tuple(any(p.search(t) for t in texts) for p in split)


@pytest.mark.parametrize("size", [4096, 2])
def test_details_across_pages(spark, monkeypatch, size):
    monkeypatch.setattr(C, "RANGE", size)
    monkeypatch.setattr(C.H, "to_text", lambda c: F.col(c))
    rng = random.Random(size)
    hosts = {f"h{k}": [rng.choice(PIECES) for _ in range(rng.randint(1, 6))] for k in range(700)}
    rows = [(h, 3 * k, f"u{k}", t) for h, ts in hosts.items() for k, t in enumerate(ts)]
    rng.shuffle(rows)
    got = {r["host"]: (r["phone"], r["street"]) for r in C.across_pages(spark.createDataFrame(rows, "host string, page_ord int, url string, html string")).collect()}
    seen = [0, 0]
    for h, texts in hosts.items():
        whole, alone = found(texts)
        for k in range(2):
            # what a page holds by itself is the other half of the check
            assert (got[h][k] or alone[k]) == whole[k], (texts, k)
            seen[k] += whole[k] and not alone[k]
    assert min(seen) > 20


def test_very_long_pages(spark, monkeypatch):
    monkeypatch.setattr(C.H, "to_text", lambda c: F.col(c))
    long = ["7 " * 500_000, " " * 500_000 + "a", "1 a " * 300_000, "12" + " " * 500_000, None, "Main" + "n" * 500_000, "Road"]
    rows = [("h", k, "u", t) for k, t in enumerate(long)] + [("g", 0, "u", "x 7" + " " * 500_000), ("g", 1, "u", "1")]
    got = C.across_pages(spark.createDataFrame(rows, "host string, page_ord int, url string, html string")).collect()
    assert sorted(tuple(r) for r in got) == [("g", True, False), ("h", False, True)]


def test_the_check_reads_across_pages(spark):
    pages = spark.createDataFrame([
        ("a", 0, "https://a/1", 200, 10, "<html><body><p>Call us at +41 44</p></body></html>"), ("a", 1, "https://a/2", 200, 10, "<html><body><p>123 45 67 or visit 12</p></body></html>"),
        ("a", 2, "https://a/3", 200, 10, "<html><body><p>Main Street, any day</p></body></html>"), ("b", 0, "https://b/1", 200, 10, "<html><body><p>Call us at +41 44</p></body></html>")],
        "host string, page_ord int, url string, status int, latency_ms int, html string")
    sites = spark.createDataFrame([(h, f"https://{h}", None, None, []) for h in "ab"], "host string, origin string, robots_txt string, llms_txt string, sitemap_urls array<string>")
    brands = spark.createDataFrame([], "host string, name string, category_text string, location string")
    got = {r["host"]: r["score"] for r in I.run_checks(sites, pages, brands, only=["contact-signals"]).collect()}
    assert got["a"] == pytest.approx(2 / 3) and got["b"] == 0
