"""Evidence of the checks on hand-made sites: nothing to show gives no row, lists are distinct, in order and short."""

from answerscope.operators import evidence as E

HOME = '<html><head><title>Home</title><script type="application/ld+json">[{"@type":"Organization","sameAs":["https://x.example/a","https://www.linkedin.com/c"]},{"@type":["Thing","Thing"]}]</script></head>' \
       '<body><main><p>One two three four five six seven eight nine ten words stand here today.</p><a href="https://www.g2.com/p">g</a><a href="https://eu.g2.com/q">g</a></main></body></html>'
OTHER = '<html><body><time datetime="2024-02-03">x</time><script type="application/ld+json">{"@type":"Article","datePublished":"2023-01-01"}</script></body></html>'


def site(spark, host, robots=None, llms=None, urls=()):
    return spark.createDataFrame([(host, f"https://{host}", robots, llms, list(urls))], "host string, origin string, robots_txt string, llms_txt string, sitemap_urls array<string>")


def told(spark, sites, pages):
    rows = spark.createDataFrame(pages, "host string, page_ord int, url string, status int, latency_ms int, html string")
    return {(r["host"], r["check_id"]): r["evidence"] for r in E.evidence(sites, rows).collect()}


def test_evidence(spark):
    sites = site(spark, "a.example", "User-agent: GPTBot\r\nDisallow: /", "# T\n[a](/a) [b](/b)", [f"https://a.example/x-vs-y/{k}" for k in range(9)]).unionByName(site(spark, "b.example"))
    got = told(spark, sites, [
        ("a.example", 0, "https://a.example/", 200, 100, HOME), ("a.example", 3, "https://a.example/best-tools-for-us", 200, 201, OTHER), ("a.example", 1, "https://a.example/x-vs-y/4", 404, 900, OTHER),
        ("b.example", 0, "https://b.example/", 500, 0, "")])
    assert got["a.example", "robots-txt"] == ["lines 2"] and got["a.example", "llms-txt"] == ["lines 2", "links 2"]
    assert got["a.example", "sitemap"] == ["urls 9"] and got["a.example", "https"] == ["https://a.example"] and len(got["a.example", "ai-crawler-access"]) == 1
    assert got["a.example", "jsonld-present"] == ["Organization", "Thing", "Article"] and got["a.example", "entity-schema"] == ["Organization"]
    assert got["a.example", "comparison-content"] == ["https://a.example/x-vs-y/4", "https://a.example/best-tools-for-us", *[f"https://a.example/x-vs-y/{k}" for k in range(4)]]
    assert got["a.example", "third-party-signals"] == ["g2.com", "x.example", "linkedin.com"]
    assert got["a.example", "response-speed"] == ["ms 151", "pages 2"]  # half up
    assert got["a.example", "freshness"] == ["newest 2024-02-03", "dates 4"]
    assert got["a.example", "content-depth"][1] == "under 300 2" and got["a.example", "entity-clarity"][0].startswith("One two three")
    assert {c for h, c in got if h == "b.example"} == {"https"}


def test_evidence_of_nothing(spark):
    none = site(spark, "a").where("false")
    assert told(spark, none, [("z", 0, "u", 500, 0, None)]) == {}
