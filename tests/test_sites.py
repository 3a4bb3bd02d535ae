"""robots.txt, sitemaps, page choice and readiness checks on literal sites."""

import duckdb
import pytest
from pyspark.sql import functions as F

from answerscope.functions.core import as_col
from answerscope.operators import pages as P
from answerscope.operators import readiness as I
from answerscope.operators import robots as R
from catalog import ORACLES, QUERIES, html_queries

BOTS = ["GPTBot", "ClaudeBot"]


def verdicts(spark, txt, paths=("/",), agents=BOTS):
    sites = spark.createDataFrame([("h", txt)], "host string, robots_txt string")
    targets = spark.createDataFrame([("h", p) for p in paths], "host string, path string")
    rows = R.is_allowed(targets, R.parse_robots(sites), agents).collect()
    return {(r["ua"], r["path"]): r["allowed"] for r in rows}


@pytest.mark.parametrize("txt, gpt, claude", [
    (None, True, True), ("", True, True), ("User-agent: *\nDisallow: /", False, False),
    ("User-agent: GPTBot\nDisallow: /\n\nUser-agent: *\nAllow: /", False, True),
    ("User-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /", False, False),
    ("User-agent: GPTBot\nCrawl-delay: 3\nUser-agent: ClaudeBot\nDisallow: /", True, False),
    ("User-agent: *\nDisallow:", True, True), ("Disallow: /", True, True),
    ("User-agent: gpt\nDisallow: /", False, True), ("User-agent: *\nDisallow: / # all\nAllow: /$", False, False),
    ("User-agent:\nDisallow: /", False, False), ("User-agent: *\nAllow: /\nUser-agent: *\nDisallow: /", True, True),
])
def test_root_access(spark, txt, gpt, claude):
    v = verdicts(spark, txt)
    # '/$' has two characters and matches the root exactly, so the longer allow wins
    if txt and "/$" in txt:
        gpt = claude = True
    assert (v["GPTBot", "/"], v["ClaudeBot", "/"]) == (gpt, claude)


def test_paths(spark):
    txt = "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\nDisallow: /x*y\nAllow: /a.b"
    v = verdicts(spark, txt, ["/a", "/a/b/c", "/f.pdf", "/f.pdf?x", "/x-y-z", "/xz", "/a.b", "/aXb"], ["GPTBot"])
    assert {p: ok for (_, p), ok in v.items()} == {
        "/a": False, "/a/b/c": True, "/f.pdf": False, "/f.pdf?x": True, "/x-y-z": False, "/xz": True, "/a.b": True, "/aXb": False}


def test_access_audit(spark):
    sites = spark.createDataFrame([("h", "User-agent: CCBot\nDisallow: /")], "host string, robots_txt string")
    rows = {r["ua"]: r for r in R.audit_ai_access(sites).collect()}
    assert len(rows) == 11 and not rows["CCBot"]["allowed"] and rows["CCBot"]["explicit"] and rows["GPTBot"]["allowed"]


def test_permission(spark):
    sites = spark.createDataFrame([("h", "User-agent: *\nDisallow: /p"), ("k", None)], "host string, robots_txt string")
    urls = spark.createDataFrame([("h", "https://h/p/1"), ("h", "https://h"), ("k", "https://k/p")], "host string, url string")
    out = R.permission_summary(R.crawl_permission(urls, sites, "Me")).collect()
    assert {r["host"]: (r["kept"], r["skipped"], r["site_blocked"]) for r in out} == {"h": (1, 1, False), "k": (1, 0, False)}


def test_sitemaps(spark):
    sites = spark.createDataFrame([("h", "https://h", "Sitemap: https://h/s.xml\nsitemap: https://h/t.xml\nSitemap: https://h/u.xml")],
                                  "host string, origin string, robots_txt string")
    index = "<SitemapIndex>" + "".join(f"<loc>https://h/c{i}.xml</loc>" for i in range(5))
    bodies = [("h", "https://h/sitemap.xml", index), ("h", "https://h/s.xml", "<loc> https://h/1 </loc><loc>https://h/2</loc>"),
              ("h", "https://h/u.xml", "<loc>https://h/late</loc>")]
    bodies += [("h", f"https://h/c{i}.xml", f"<loc>https://h/k{i}</loc><loc>https://h/1</loc>") for i in range(5)]
    got = P.sitemap_urls(sites, spark.createDataFrame(bodies, "host string, url string, body string")).collect()
    # the fifth candidate and the fourth child are not read
    assert {r["url"] for r in got} == {"https://h/1", "https://h/2", "https://h/k0", "https://h/k1", "https://h/k2"}


def test_sitemap_bodies_are_bounded(spark, tmp_path):
    # one host with 40,000 pages: no body holds more than its share of the ids, and no URL is lost
    rows = spark.range(40_000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://hot.example/p/"), F.col("id").cast("string")).alias("url"), F.lit("").alias("html"))
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    bodies = html_queries._sitemap_bodies(spark, str(tmp_path)).withColumn("n", F.regexp_count("body", F.lit("<url>")))
    assert 0 < bodies.agg(F.max("n")).first()[0] <= html_queries.BODY_IDS / 2
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(ORACLES["a08_sitemap_urls"]).fetchall()
    got = [tuple(r) for r in QUERIES["a08_sitemap_urls"](spark, str(tmp_path)).collect()]
    assert len(want) > 13_000 and sorted(got) == sorted(want)


def test_select_pages(spark):
    sites = spark.createDataFrame([("h.example", "https://h.example")], "host string, origin string")
    urls = ["https://h.example/blog/deep/x", "https://h.example/file.pdf", "https://other.example/", "https://www.h.example/pricing?x=1",
            "https://h.example/b", "https://h.example/a", "https://h.example/", "https://h.example/a#top"]
    found = spark.createDataFrame([("h.example", i, u) for i, u in enumerate(urls)], "host string, ord int, url string")
    pinned = spark.createDataFrame([("h.example", 0, "https://h.example/key/")], "host string, ord int, url string")
    rows = sorted(P.select_pages(sites, found, pinned, limit=6).collect(), key=lambda r: r["pick"])
    assert [r["url"] for r in rows] == [
        "https://h.example", "https://h.example/key", "https://www.h.example/pricing", "https://h.example/blog/deep/x",
        "https://h.example/b", "https://h.example/a"]


GOOD = """<html><head><title>Harbour roof repair vs replacement</title><link rel="canonical" href="https://good.example/">
<meta name="description" content="Harbour repairs slate and tile roofs in Bristol with a written guarantee on every job.">
<meta name="author" content="Kim"><script type="application/ld+json">{"@type":["Organization","FAQPage","Service"],"sameAs":
["https://www.linkedin.com/x","https://g2.com/x","https://x.com/x","https://reddit.com/x","https://yelp.com/x"],"mainEntity":[1,2,3],
"offers":{"a":1},"author":"Kim","dateModified":"2024-03-01","telephone":"1","address":"a"}</script></head><body><main><h1>Roofs</h1>
<p>Harbour repairs slate and tile roofs across Bristol and answers within two working hours on weekdays. It is a roof repair company.</p>
<h2>How much is it?</h2><h2>What is covered?</h2><h2>Why now?</h2><h2>Who comes?</h2><h2>When?</h2><h2>Where?</h2>
<p>45% of 1,200 jobs cost $3,000 or less. Mail a@good.example now. """ + "word " * 820 + "</p></main></body></html>"
BAD = '<html><body><div id="root"></div><script>1</script><script>2</script><script>3</script></body></html>'


def crawl(spark):
    sites = spark.createDataFrame([
        ("good.example", "https://good.example", "User-agent: *\nAllow: /\nSitemap: https://good.example/s.xml",
         "# Good\n[a](/a) [b](/b) [c](/c)", [f"https://good.example/compare/{i}" for i in range(20)], True, False, None),
        ("bad.example", "http://bad.example", "User-agent: *\nDisallow: /\nUser-agent: Me\nAllow: /", None, [], True, False, None),
        ("gone.example", "https://gone.example", None, None, [], False, False, "HTTP 403")],
        "host string, origin string, robots_txt string, llms_txt string, sitemap_urls array<string>, reachable boolean, robots_blocked boolean, error string")
    pages = spark.createDataFrame([
        ("good.example", 0, "https://good.example/", 200, GOOD, 200), ("good.example", 1, "https://good.example/faq", 200, GOOD, 300),
        ("bad.example", 0, "http://bad.example/", 200, BAD, 4200), ("gone.example", 0, "https://gone.example/", 403, "", 10)],
        "host string, page_ord int, url string, status int, html string, latency_ms int")
    brands = spark.createDataFrame([("good.example", "Harbour", "roof repair", "Bristol, UK"), ("bad.example", "Nobody", "nothing", "Nowhere")],
                                   "host string, name string, category_text string, location string")
    return sites, pages, brands


def test_good_and_bad_sites(spark):
    sites, pages, brands = crawl(spark)
    checks = I.run_checks(sites, pages, brands, F.lit("2024-03-31").cast("timestamp")).cache()
    assert checks.count() == 3 * 26
    rows = {(r["host"], r["check_id"]): r for r in checks.collect()}
    weak = {k[1]: r["score"] for k, r in rows.items() if k[0] == "good.example" and r["score"] < 0.8}
    assert weak == {}
    assert all(r["fix_id"] is None for k, r in rows.items() if k[0] == "good.example")
    assert sum(r["status"] == "fail" for k, r in rows.items() if k[0] == "bad.example") > 15
    ready = {r["host"]: r for r in I.assess_readiness(sites, checks).collect()}
    assert ready["good.example"]["overall"] > 0.9 and ready["bad.example"]["overall"] < 0.25
    assert ready["gone.example"]["overall"] is None and ready["gone.example"]["blocked_reason"] == "HTTP 403"
    assert ready["gone.example"]["n_total"] == 0


def test_one_check_equals_the_suite(spark):
    sites, pages, brands = crawl(spark)
    when = F.lit("2024-03-31").cast("timestamp")
    suite = {(r["host"], r["check_id"]): tuple(r) for r in I.run_checks(sites, pages, brands, when).collect()}
    for cid in ("content-depth", "comparison-content", "third-party-signals", "entity-clarity", "ai-crawler-access"):
        for r in I.run_checks(sites, pages, brands, when, only=[cid]).collect():
            assert suite[r["host"], cid] == tuple(r)


def test_upper_median(spark):
    hist = spark.createDataFrame([(c, v) for v, c in [(5, 3), (9, 1), (2, 2), (7, 2)]], "n long, v int")
    arr = hist.agg(F.collect_list(F.struct(F.lpad(F.col("v").cast("string"), 10, "0").alias("value"), "n")).alias("h"))
    values = sorted([5] * 3 + [9] + [2] * 2 + [7] * 2)
    for half in range(len(values)):
        assert arr.select(I._median(as_col("h"), F.lit(half)).alias("m")).collect()[0]["m"] == values[half]


@pytest.mark.parametrize("text, day", [
    ("2024-01-05", "2024-01-05"), ("2024-01", "2024-01-01"), ("2024-01-05T08:00:00Z", "2024-01-05"),
    ("2024-01-05T23:30:00-02:00", "2024-01-06"), ("Fri, 05 Jan 2024 10:00:00 GMT", "2024-01-05"), ("soon", None), ("", None)])
def test_dates(one, text, day):
    d = one(F.to_date(I.parse_date(F.lit(text))))
    assert (str(d) if d else None) == day
