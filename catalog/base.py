"""Registry and the views that turn the driver tables into this library's inputs.

``VIEWS`` hold SQL that both Spark and DuckDB run unchanged; rows grow with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# columns each table is read with; Parquet pruning does the rest
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "pages", "benchmark", "labels", "conversations"]

HOST = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www[.]', '')"

_LD = """CASE p.page_id % 9
  WHEN 0 THEN '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Organization","name":"N","sameAs":["https://www.linkedin.com/company/n","https://social.example/n"]}</script>'
  WHEN 1 THEN '<script type="application/ld+json">[{"@type":"Product","offers":{"price":5}},{"@type":["Service","Thing"]}]</script>'
  WHEN 2 THEN '<script id="x" type = "application/ld+json">{"@context":"c","name":"wrap","@graph":[{"@type":"FAQPage","mainEntity":[1,2,3]},{"@type":"Article","author":"A","dateModified":"2023-11-05"}]}</script>'
  WHEN 3 THEN '<script type="application/ld+json">{"@type":"http://schema.org/LocalBusiness","telephone":"123","address":{"x":1},}</script>'
  WHEN 4 THEN '<script type="application/ld+json">{oops</script>'
  WHEN 5 THEN '<script type="application/ld+json"><![CDATA[{"@type":"QAPage","mainEntity":[1,2],"datePublished":"2024-01-10T08:00:00Z"}]]></script>'
  WHEN 6 THEN '<script type="application/ld+json">{"@graph":[{"@type":"Dentist","sameAs":"","offers":0}]}</script>'
  ELSE '' END"""

_HEAD = """CASE p.page_id % 4
  WHEN 0 THEN '<meta name="description" content="Page ' || CAST(p.page_id AS STRING) || ' of ' || p.host || ' with a summary that is long enough &amp; clear">'
  WHEN 1 THEN '<meta content="short" name="description">'
  WHEN 2 THEN '<meta property="og:description" content="Shared summary of this page, long enough to pass the sixty character bar">'
  ELSE '' END || CASE WHEN p.page_id % 3 <> 1 THEN '<link href="' || p.url || '" rel="canonical">' ELSE '' END
  || CASE WHEN p.page_id % 10 = 6 THEN '<meta name="author" content="Ann Author">' ELSE '' END"""

_BODY = """CASE p.page_id % 7
  WHEN 0 THEN '<h2>How does it work?</h2><h2>Plans &amp; <i>prices</i></h2><h3>Why us</h3>'
  WHEN 1 THEN '<h2>Overview</h2><div id="root"></div><script>a</script><script>b</script>'
  WHEN 2 THEN '<main><p>Alpha beta gamma delta epsilon zeta eta theta iota kappa.</p></main>'
  WHEN 3 THEN '<p>Grew 45% to 1,200 users for $3.5 million, a 10x rise.</p><time class="t" datetime="2024-01-' || CAST(10 + p.page_id % 20 AS STRING) || '">x</time>'
  WHEN 4 THEN '<p>Call +1 (555) 123-4567 or mail a.b@c.example, by Jane Doe, 12 Main Street</p>'
  WHEN 5 THEN '<a href="https://www.g2.com/p">x</a><a href="//Reddit.com/r/q">y</a><a href="sub/page?x=1&amp;y=2">z</a><a href="../up">u</a><a href="/top#frag">t</a><a href="mailto:q@r.example">m</a>'
  ELSE '<h4>One?</h4><h4>Two?</h4><h4>Three?</h4><h2>Four?</h2><h2>Five?</h2><h2>Six?</h2>' END"""

VIEWS: dict[str, str] = {
    # pages with their host; home page = lowest id of a host
    "v_hosts": f"""SELECT host, min(page_id) AS first_id, count(*) AS n_pages
        FROM (SELECT page_id, {HOST} AS host FROM pages) t GROUP BY host""",
    "v_pages": f"""SELECT page_id, url, html, {HOST} AS host FROM pages""",
    # the crawl as the library sees it: head, structured data and body parts added by rule
    "v_rich": f"""SELECT p.page_id, p.url, p.host, p.page_id - h.first_id AS page_ord,
        CASE WHEN p.page_id % 29 = 7 THEN 404 ELSE 200 END AS status, (p.page_id % 40) * 100 AS latency_ms,
        replace(replace(replace(p.html, '</head>', {_HEAD} || {_LD} || '</head>'),
          '</article>', {_BODY} || '</article>'),
          '<title>', CASE WHEN p.page_id % 11 = 0 THEN '<title>Best tools for work ' ELSE '<title>' END) AS html
        FROM v_pages p JOIN v_hosts h ON p.host = h.host""",
    "v_sites": """SELECT host, first_id,
        CASE WHEN length(host) % 5 = 0 THEN 'http://' ELSE 'https://' END || host AS origin,
        CASE length(host) % 7
          WHEN 0 THEN NULL
          WHEN 1 THEN 'User-agent: *' || chr(10) || 'Disallow: /private' || chr(10) || 'Sitemap: https://' || host || '/map.xml'
          WHEN 2 THEN '# note' || chr(10) || 'User-agent: GPTBot' || chr(10) || 'User-agent: ClaudeBot' || chr(10) || 'Disallow: /' || chr(10) || chr(10) || 'User-agent: *' || chr(10) || 'Allow: /'
          WHEN 3 THEN 'Disallow: /lost' || chr(10) || 'User-Agent: Google' || chr(10) || 'Crawl-delay: 5' || chr(10) || 'User-agent: *' || chr(13) || chr(10) || 'Disallow: /en/ # half' || chr(10) || 'Allow: /en/1*' || chr(10) || 'Disallow:'
          WHEN 4 THEN 'user-agent:' || chr(10) || 'disallow: /*/2' || chr(10) || 'User-agent: CCBot' || chr(10) || 'Disallow: /*$' || chr(10) || 'nonsense line'
          WHEN 5 THEN 'User-agent: *' || chr(10) || 'Disallow: /' || chr(10) || 'User-agent: *' || chr(10) || 'Allow: /'
          ELSE 'User-agent: perplexitybot-extra' || chr(10) || 'Disallow: /' || chr(10) || 'User-agent: a' || chr(10) || 'Allow: /' END AS robots_txt,
        CASE length(host) % 4
          WHEN 0 THEN NULL WHEN 1 THEN '# ' || host || chr(10) || '- [a](/a)' || chr(10) || '- [b](/b)' || chr(10) || '- [c](/c)'
          WHEN 2 THEN 'plain text [a](/a)' ELSE '#no' || chr(10) || '[a](/a) [b](/b) [c](/c)' END AS llms_txt,
        (length(host) * 7) % 20 AS n_sitemap,
        length(host) % 11 <> 3 AS reachable, length(host) % 13 = 4 AS robots_blocked
        FROM v_hosts""",
    # every host audited by a run of its own: outcomes are dealt over the pages' hosts
    "v_host_runs": """SELECT o.ord, p.host AS run_id, 'b' || CAST(s.first_id % 3 AS STRING) AS brand_key
        FROM (SELECT ord, ord % (SELECT count(*) FROM pages) AS page_id FROM v_outcomes) o
        JOIN v_pages p ON p.page_id = o.page_id JOIN v_sites s ON s.host = p.host""",
    # documents as captured answers, one brand per source
    "v_docs": """SELECT 'run-' || lang AS run_id, source AS brand_key, 'e' || CAST(doc_id % 4 AS STRING) AS engine,
        CAST(doc_id % 4 AS INT) AS engine_ord, CAST(doc_id % 40 AS STRING) AS prompt_id,
        CAST(floor(doc_id / 40) AS INT) AS sample, doc_id AS ord,
        CASE WHEN doc_id % 23 = 0 THEN 'error' ELSE 'answered' END AS status,
        CASE WHEN doc_id % 23 = 0 THEN 'HTTP ' || CAST(500 + doc_id % 5 AS STRING) END AS error,
        text,
        CASE doc_id % 6 WHEN 0 THEN 'https://www.reddit.com/r/x https://own.example/a'
          WHEN 1 THEN 'https://g2.com/p https://g2.com/q' WHEN 2 THEN 'https://en.wikipedia.org/wiki/X http://rival.example:8080/b'
          WHEN 3 THEN '' WHEN 4 THEN 'nonsense https://WWW.Rival.example/b https://medium.com/' || CAST(doc_id AS STRING)
          ELSE 'https://news.site' || CAST(doc_id % 9 AS STRING) || '.example/z https://own.example' END AS cites
        FROM documents""",
    "v_brand_keys": "SELECT DISTINCT source AS brand_key FROM documents",
    "v_entities": """SELECT brand_key, 0 AS entity_ord, 'From' AS name, 'own.example' AS domain, '' AS alias, true AS is_brand FROM v_brand_keys
        UNION ALL SELECT brand_key, 1, 'With', 'www.rival.example', '', false FROM v_brand_keys
        UNION ALL SELECT brand_key, 2, 'Ther', '', 'Thre', false FROM v_brand_keys""",
    "v_prompts": """SELECT DISTINCT source AS brand_key, CAST(doc_id % 40 AS STRING) AS prompt_id,
        'Question ' || CAST(doc_id % 40 AS STRING) AS text,
        CASE (doc_id % 40) % 7 WHEN 0 THEN 'commercial_investigation' WHEN 1 THEN 'comparison' WHEN 2 THEN 'alternative'
          WHEN 3 THEN 'local' WHEN 4 THEN 'pricing' WHEN 5 THEN 'problem' ELSE 'branded' END AS intent,
        CASE (doc_id % 40) % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS lang,
        CASE (doc_id % 40) % 7 WHEN 0 THEN CAST(1.0 AS DOUBLE) WHEN 1 THEN CAST(0.9 AS DOUBLE) WHEN 2 THEN CAST(0.85 AS DOUBLE)
          WHEN 3 THEN CAST(0.85 AS DOUBLE) WHEN 4 THEN CAST(0.7 AS DOUBLE) WHEN 5 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.35 AS DOUBLE) END AS weight
        FROM documents""",
    # events as outcomes whose mentions are already known
    "v_outcomes": """SELECT event_id AS ord, 'r' || CAST(user_id % 3 AS STRING) AS run_id, 'b' || CAST(user_id % 3 AS STRING) AS brand_key,
        'e' || CAST(user_id % 4 AS STRING) AS engine, CAST(event_id % 37 AS STRING) AS prompt_id,
        'Question ' || CAST(event_id % 37 AS STRING) AS prompt_text,
        CASE (event_id % 37) % 7 WHEN 0 THEN 'commercial_investigation' WHEN 1 THEN 'comparison' WHEN 2 THEN 'alternative'
          WHEN 3 THEN 'local' WHEN 4 THEN 'pricing' WHEN 5 THEN 'problem' ELSE 'branded' END AS intent,
        CASE WHEN user_id % 3 = 2 THEN 'en' WHEN event_id % 3 = 0 THEN 'en' WHEN event_id % 3 = 1 THEN 'de' ELSE 'fr' END AS lang,
        CASE (event_id % 37) % 7 WHEN 0 THEN CAST(1.0 AS DOUBLE) WHEN 1 THEN CAST(0.9 AS DOUBLE) WHEN 2 THEN CAST(0.85 AS DOUBLE)
          WHEN 3 THEN CAST(0.85 AS DOUBLE) WHEN 4 THEN CAST(0.7 AS DOUBLE) WHEN 5 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.35 AS DOUBLE) END AS weight,
        CASE WHEN event_type = 'error' THEN 'error' ELSE 'answered' END AS status,
        CASE WHEN event_type = 'error' THEN 'HTTP ' || CAST(500 + event_id % 7 AS STRING) END AS error,
        event_id % 5 = 0 AS own_cited, ts,
        CASE event_id % 12 WHEN 0 THEN 'https://www.reddit.com/r/x' WHEN 1 THEN 'https://g2.com/p https://g2.com/q'
          WHEN 2 THEN 'https://en.wikipedia.org/wiki/X' WHEN 3 THEN 'https://www.linkedin.com/in/x https://medium.com/x'
          WHEN 4 THEN 'https://github.com/x' WHEN 5 THEN 'https://own.example/a https://www.own.example/b'
          WHEN 6 THEN 'https://www.rival.example/b' WHEN 7 THEN 'https://reddit.com/r/y https://own.example/a' WHEN 8 THEN 'not a url'
          WHEN 9 THEN '' ELSE 'https://site' || CAST(event_id % 53 AS STRING) || '.example/p?q=1' END AS cites
        FROM events""",
    "v_mentions": """SELECT ord, run_id, brand_key, engine, prompt_id, status, entity_ord, name, entity_ord = 0 AS is_brand,
        status <> 'error' AND (ord * 7 + entity_ord * 3) % 5 < 2 AS mentioned,
        CAST((ord * 31 + entity_ord * 17) % 101 AS INT) AS first_index,
        CASE (ord + entity_ord) % 4 WHEN 0 THEN 'recommended' WHEN 1 THEN 'listed' WHEN 2 THEN 'referenced' ELSE 'dismissed' END AS raw_role,
        CAST((ord + entity_ord) % 7 - 3 AS DOUBLE) / 3 AS raw_sentiment
        FROM v_outcomes CROSS JOIN (SELECT 0 AS entity_ord, 'Alpha' AS name UNION ALL SELECT 1, 'Beta' UNION ALL SELECT 2, 'Gamma') x""",
    "v_runs": """SELECT 'run' || CAST(event_id AS STRING) AS run_id, 'b' || CAST(user_id % 97 AS STRING) AS brand_key, ts AS created_at,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) % 100 AS DOUBLE) / 100 END AS composite,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST((event_id * 13) % 1000 AS DOUBLE) / 1000 END AS readiness,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST((event_id * 17) % 1000 AS DOUBLE) / 1000 END AS visibility,
        CAST((event_id * 19) % 100 AS DOUBLE) / 100 AS mention_rate, event_id % 31 = 0 AS blocked, event_id
        FROM events""",
}
VIEWS |= {
    # brand profiles as JSON lines, one per customer, with every shape the reader must accept or refuse
    "v_profiles": """SELECT c_custkey AS k, CASE WHEN c_custkey % 29 = 5 THEN '{broken' ELSE '{'
        || CASE WHEN c_custkey % 13 = 5 THEN '' ELSE '"name":" ' || c_name || ' ",' END
        || CASE WHEN c_custkey % 17 = 5 THEN '"domain":7,' ELSE '"domain":" https://www.' || lower(c_mktsegment) || CAST(c_custkey AS STRING) || '.example/home",' END
        || '"category":' || CASE WHEN c_custkey % 19 = 5 THEN '""' WHEN c_custkey % 23 = 5 THEN '{"en":" "}'
           WHEN c_custkey % 3 = 0 THEN '"' || lower(c_mktsegment) || ' tools "' WHEN c_custkey % 3 = 1 THEN '{"de":"Werkzeug","en":""}' ELSE '{"it":"Attrezzi","fr":"Outils"}' END
        || ',"competitors":' || CASE c_custkey % 4 WHEN 0 THEN '["Rival A",{"name":"Rival B","domain":"https://www.b.example/x","aliases":["RB"]}]'
           WHEN 1 THEN '[]' WHEN 2 THEN '[{"domain":"x.example"},"Solo"]' ELSE '["C1","C2","C3","C4","C5"]' END
        || CASE WHEN c_custkey % 5 = 0 THEN ',"languages":["DE ","en"]' ELSE '' END
        || CASE WHEN c_custkey % 2 = 0 THEN ',"location":"Paris"' ELSE '' END
        || CASE WHEN c_custkey % 6 = 0 THEN ',"audience":"teams"' ELSE '' END
        || CASE WHEN c_custkey % 7 = 0 THEN ',"extraPrompts":["My own  question?","WHO ist ' || c_name || '?","Wer ist ' || c_name || '?"]' ELSE '' END
        || ',"aliases":["c' || CAST(c_custkey AS STRING) || '"]}' END AS line, c_name, c_mktsegment FROM customer""",
    # one visibility summary per audited host
    "v_vis": """SELECT host AS run_id, first_id % 9 AS prompts_answered, first_id % 5 AS gap_count, CAST(first_id % 10 AS DOUBLE) / 20 AS citation_rate,
        CAST(first_id % 11 AS DOUBLE) / 10 AS mention_rate, CAST(first_id % 7 AS DOUBLE) / 10 AS influence_ratio, first_id % 3 AS dismissed_count,
        first_id % 8 AS total_citations, CAST(first_id % 10 AS DOUBLE) / 10 AS off_site_share, CASE WHEN first_id % 4 = 0 THEN NULL ELSE CAST(first_id % 6 AS DOUBLE) / 5 END AS branded_rate,
        CAST(first_id % 13 AS DOUBLE) / 13 AS brand_share, first_id % 2 = 0 AS leader_is_brand, first_id % 12 <> 0 AS visibility_run FROM v_hosts""",
}
NEEDS = {"v_host_runs": ["v_outcomes", "v_pages", "v_sites"], "v_vis": ["v_hosts"], "v_rich": ["v_pages", "v_hosts"], "v_sites": ["v_hosts"], "v_entities": ["v_brand_keys"],
         "v_mentions": ["v_outcomes"]}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for d in [*_closure(NEEDS.get(n, [])), n]:
            if d not in out:
                out.append(d)
    return out


SPREAD_TABLES = ("documents", "pages", "conversations", "customer", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  On one machine a table with work per row is spread over the cores, as
    one small file is one split; on a cluster the reader's splits are used as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in SPREAD_TABLES and spark.sparkContext.master.startswith("local["):
        return df.repartition(spark.sparkContext.defaultParallelism, df.columns[0])
    return df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` over the tables of ``sf_dir``."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    for n in _closure([name]):
        for t in TABLES:
            if f"FROM {t}" in VIEWS[n]:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        spark.sql(VIEWS[n]).createOrReplaceTempView(n)
    return spark.table(name)


def with_views(sql: str) -> str:
    """DuckDB text: the views a query mentions, as CTEs ahead of it."""
    wanted = _closure([n for n in VIEWS if n in sql])
    if not wanted:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None, ints: str = "", longs: str = ""):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its oracle.

    ``ints`` / ``longs`` name oracle columns whose SQL type is wider than the Spark column.
    """
    casts = [f'CAST("{c}" AS INTEGER) AS "{c}"' for c in ints.split()] + [
        f'CAST("{c}" AS BIGINT) AS "{c}"' for c in longs.split()]

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            full = with_views(sql)
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({full}) q" if casts else full
        return fn
    return register


# --- inputs in the library's own shapes ---------------------------------------------------


def split_words(col: str) -> Column:
    return F.filter(F.split(col, " "), lambda s: s != "")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_docs").withColumn("citations", split_words("cites")).drop("cites")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_entities").withColumn(
        "aliases", F.when(F.col("alias") == "", F.array().cast("array<string>")).otherwise(F.array("alias"))).drop("alias")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event outcomes with the mentions array built inside each row."""
    from answerscope.operators.mentions import brand_of, outcome_score, ranked

    o = view(spark, sf_dir, "v_outcomes")

    def mention(e: int, name: str) -> Column:
        ord_ = F.col("ord")
        named = (F.col("status") != "error") & ((ord_ * 7 + e * 3) % 5 < 2)
        role = F.array(*map(F.lit, ["recommended", "listed", "referenced", "dismissed"]))[((ord_ + e) % 4).cast("int")]
        return F.struct(
            F.lit(e).alias("entity_ord"), F.lit(name).alias("name"), F.lit(e == 0).alias("is_brand"),
            named.alias("mentioned"), ((ord_ * 31 + e * 17) % 101).cast("int").alias("first_index"),
            F.when(named, role).otherwise("referenced").alias("role"),
            F.when(named, ((ord_ + e) % 7 - 3).cast("double") / 3).otherwise(0.0).alias("sentiment"))

    arr = F.array(*[mention(i, n) for i, n in enumerate(["Alpha", "Beta", "Gamma"])])
    wide = o.withColumn("mentions", ranked(arr)).withColumn("brand", brand_of(F.col("mentions")))
    return wide.withColumns({
        "score": outcome_score(F.col("status"), F.col("brand"), F.col("own_cited")),
        "citations": split_words("cites")}).drop("cites")


def outcome_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity dimension that fits ``outcomes``: one profile per brand key."""
    keys = view(spark, sf_dir, "v_outcomes").select("brand_key").distinct()
    rows = F.array(*[F.struct(
        F.lit(i).alias("entity_ord"), F.lit(n).alias("name"), F.lit(d).alias("domain"), F.lit(i == 0).alias("is_brand"))
        for i, (n, d) in enumerate([("Alpha", "own.example"), ("Beta", "www.rival.example"), ("Gamma", None)])])
    return keys.select("brand_key", F.inline(rows))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_sites").withColumns({
        "sitemap_urls": F.when(F.col("n_sitemap") == 0, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.col("n_sitemap").cast("int")), lambda i: F.concat(
                F.col("origin"), F.when(i % 8 == 5, "/compare/").otherwise("/p/"), i.cast("string")))),
        "error": F.when(~F.col("reachable"), "HTTP 403").cast("string")})


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_rich")


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand facts per host for the clarity check."""
    return view(spark, sf_dir, "v_hosts").select(
        "host", F.concat(F.lit("The "), F.substring_index("host", ".", 1)).alias("name"),
        F.lit("Page summary and reports").alias("category_text"),
        F.when(F.length("host") % 2 == 0, F.lit("There, Onto")).alias("location"))


AS_OF = "2024-03-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")
