"""A6-A8, C, D6-D7: pages, sitemaps, page selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerscope import fixed
from answerscope.functions import html as H
from answerscope.functions import jsonld as J
from answerscope.functions.urls import host_of
from answerscope.operators import pages as P
from answerscope.operators import robots as R
from catalog.base import pages, query, sites, view

BLOCKS = fixed.BLOCK_TAGS


def text_sql(e: str) -> str:
    """Readable text of an HTML expression in RE2: one replacement per dropped tag."""
    s = f"regexp_replace({e}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "noscript", "svg", "template"):
        s = f"regexp_replace({s}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    s = f"regexp_replace({s}, '(?i)</({BLOCKS})\\s*>', chr(10), 'g')"
    s = f"regexp_replace({s}, '(?i)<br\\s*/?>', chr(10), 'g')"
    s = decode_sql(f"regexp_replace({s}, '<[^>]+>', ' ', 'g')")
    s = f"regexp_replace({s}, '[ \\t\\x{{a0}}]+', ' ', 'g')"
    s = f"regexp_replace({s}, '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g')"
    return f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


def decode_sql(e: str) -> str:
    for name, char in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("copy", "©"), ("mdash", "—"), ("amp", "&")]:
        e = f"regexp_replace({e}, '(?i)&{name};', '{char}', 'g')"
    return e


TEXT = text_sql("html")
TITLE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))".format(
    decode_sql(text_sql("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")))


def meta_sql(key: str) -> str:
    return decode_sql(
        f"trim(regexp_extract(regexp_extract(html, '(?i)<meta\\b[^>]*(?:name|property|http-equiv)\\s*=\\s*[\"'']{key}[\"''][^>]*>'), "
        "'(?is)content\\s*=\\s*[\"''](.*?)[\"'']', 1))")


DESCRIPTION = f"coalesce(nullif({meta_sql('description')}, ''), {meta_sql('og:description')})"
# headings, one row each; the closing tag of every level is spelled out instead of a backreference
HEADINGS = """hraw AS (SELECT page_id, host, status, unnest(regexp_extract_all(html, '{}')) AS h FROM v_rich),
 heads AS (SELECT page_id, host, status, CAST(substr(h, 3, 1) AS INTEGER) AS level, regexp_replace(trim({}), '\\s+', ' ', 'g') AS text FROM hraw)""".format(
    "(?is)" + "|".join(f"<h{i}\\b[^>]*>.*?</h{i}>" for i in range(1, 7)),
    text_sql("regexp_replace(h, '(?is)^<h[1-6]\\b[^>]*>|</h[1-6]>$', '', 'g')"))
LINKS = r"""lraw AS (SELECT page_id, host, url, unnest(x) AS raw, generate_subscripts(x, 1) AS i FROM
   (SELECT page_id, host, url, regexp_extract_all(html, '(?i)<a\b[^>]*href\s*=\s*["'']([^"''#]+)["'']', 1) AS x FROM v_rich) t),
 ldec AS (SELECT *, trim(replace(raw, '&amp;', '&')) AS href, regexp_extract(url, '^(https?://[^/?#]*)') AS origin,
   regexp_extract(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '^.*/') AS folder FROM lraw),
 labs AS (SELECT page_id, host, i, CASE WHEN href LIKE 'http%://%' THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^https?:') || href
   WHEN href LIKE '/%' THEN origin || href
   WHEN href LIKE '../%' THEN origin || regexp_replace(folder, '[^/]+/$', '') || substr(href, 4) ELSE origin || folder || href END AS a
   FROM ldec WHERE NOT regexp_matches(href, '(?i)^(javascript|mailto|tel|data):') AND href <> ''),
 links AS (SELECT page_id, host, min(i) AS i, u FROM (SELECT page_id, host, i,
   lower(regexp_extract(a, '^https?://[^/?#]*')) || CASE WHEN regexp_matches(a, '^https?://[^/?#]*$') THEN '/' ELSE regexp_replace(a, '^https?://[^/?#]*', '') END AS u FROM labs) z GROUP BY page_id, host, u)"""


PERCENT = "url_encode(u)"
for _c in "/?&=:,.;+@!()'*$%#~":
    PERCENT = f"replace({PERCENT}, '%{ord(_c):02X}', '{_c if _c != chr(39) else chr(39) * 2}')"


@query("a06_read_pages", "SELECT page_id, host, page_ord, status FROM v_rich WHERE status > 0 AND status < 400 OR page_ord = 0")
def a06(spark, d):
    return P.kept_pages(pages(spark, d)).select("page_id", "host", "page_ord", "status")


@query("a07_plain_body", "SELECT page_id, CASE WHEN page_id % 5 <> 0 AND page_id % 3 = 1 THEN substr(html, 30) END AS body FROM pages")
def a07(spark, d):
    k = F.col("page_id")
    body = F.when(k % 3 == 1, F.substr("html", F.lit(30))).otherwise(F.col("html"))
    return view(spark, d, "pages").select("page_id", P.plain_body(k % 5 != 0, body).alias("body"))


#: page ids a body of a sitemap covers at most
BODY_IDS = 10_000


def _sitemap_bodies(spark, d):
    """Sitemap files of every host, built from its pages: an index with children, or URLs.

    A file has one body per ``BODY_IDS`` page ids, so that no row holds all URLs of a host.
    """
    p = view(spark, d, "v_pages").select("host", "page_id", "url")
    loc = F.concat(F.lit("<url><loc> "), F.col("url"), F.lit(" </loc></url>"))
    own = p.groupBy("host", (F.col("page_id") % 3).alias("part"), F.expr(f"page_id div {BODY_IDS}").alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", loc.alias("x")))), lambda s: s["x"]), "\n").alias("body"))
    s = sites(spark, d).select("host", "origin", F.length("host").alias("n"))
    kids = own.join(s, "host").select("host", F.concat("origin", F.lit("/child"), F.col("part").cast("string"), F.lit(".xml")).alias("url"), "body")
    index = s.where("n % 2 = 0").select("host", F.concat("origin", F.lit("/sitemap.xml")).alias("url"), F.concat(
        F.lit("<SitemapIndex>"), F.array_join(F.transform(F.array(*[F.lit(i) for i in ("2", "0", "9", "1")]), lambda i: F.concat(
            F.lit("<loc>"), F.col("origin"), F.lit("/child"), i, F.lit(".xml</loc>"))), "")).alias("body"))
    flat = own.where("part = 1").join(s.where("n % 2 = 1"), "host").select(
        "host", F.concat("origin", F.lit("/sitemap_index.xml")).alias("url"), "body")
    named = own.where("part = 0").join(s, "host").select(
        "host", F.concat(F.lit("https://"), "host", F.lit("/map.xml")).alias("url"), "body")
    return kids.unionByName(index).unionByName(flat).unionByName(named)


@query("a08_sitemap_urls", """WITH p AS (SELECT v.host, v.page_id, v.url, length(v.host) AS n FROM v_pages v),
x AS (SELECT host, url FROM p WHERE n % 2 = 0 AND page_id % 3 IN (2, 0) UNION SELECT host, url FROM p WHERE n % 2 = 1 AND page_id % 3 = 1
  UNION SELECT host, url FROM p WHERE n % 7 = 1 AND page_id % 3 = 0)
SELECT host, url FROM x""")
def a08(spark, d):
    return P.sitemap_urls(sites(spark, d), _sitemap_bodies(spark, d)).select("host", "url")


@query("c01_to_text", f"SELECT page_id, {TEXT} AS text FROM v_rich")
def c01(spark, d):
    return pages(spark, d).select("page_id", H.to_text("html").alias("text"))


@query("c02_decode_entities", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN html || ' < & é 😀 &bogus; &#0;' WHEN 1 THEN html || ' &lt; — ™ A' ELSE html || '&;' END AS decoded
  FROM (SELECT page_id, {} AS html FROM pages) t""".format(decode_sql("html")))
def c02(spark, d):
    k = F.col("page_id") % 4
    raw = F.concat("html", F.when(k == 0, " &lt; &AMP; &#233; &#x1F600; &bogus; &#0;").when(
        k == 1, " &amp;lt; &mdash; &trade; &#x41;").otherwise("&;"))
    return view(spark, d, "pages").select("page_id", H.decode_entities(raw).alias("decoded"))


@query("c03_title", f"SELECT page_id, {TITLE} AS title FROM v_rich")
def c03(spark, d):
    return pages(spark, d).select("page_id", H.title("html").alias("title"))


@query("c04_meta", f"SELECT page_id, {DESCRIPTION} AS description, {meta_sql('author')} AS author FROM v_rich")
def c04(spark, d):
    return pages(spark, d).select("page_id", H.description("html").alias("description"), H.meta("html", "author").alias("author"))


@query("c05_headings", f"WITH {HEADINGS} SELECT page_id, level, text FROM heads WHERE text <> ''")
def c05(spark, d):
    return pages(spark, d).select("page_id", F.inline(H.headings("html")))


@query("c06_links", f"WITH {LINKS} SELECT page_id, {PERCENT} AS link FROM links")
def c06(spark, d):
    return pages(spark, d).select("page_id", F.explode(H.links("html", "url")).alias("link"))


@query("c07_jsonld_nodes", """SELECT page_id, CASE page_id % 9 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 1 ELSE 0 END AS nodes,
  page_id % 9 = 0 AS same_as, page_id % 9 = 1 AS priced, page_id % 9 = 2 AS questions, page_id % 9 = 3 AS contact, CASE page_id % 9 WHEN 2 THEN '2023-11-05' WHEN 5 THEN '2024-01-10T08:00:00Z' ELSE '' END AS dates FROM pages""")
def c07(spark, d):
    p = pages(spark, d).select("page_id", J.node_facts(J.nodes("html")).alias("n"))
    return p.select(
        "page_id", F.size("n").alias("nodes"), F.exists("n", lambda x: x["has_same_as"]).alias("same_as"),
        F.exists("n", lambda x: x["priced"]).alias("priced"), F.exists("n", lambda x: x["has_questions"]).alias("questions"),
        F.exists("n", lambda x: x["phone"] & x["address"]).alias("contact"),
        F.array_join(F.flatten(F.transform("n", lambda x: x["dates"])), " ").alias("dates"))


_TYPES = """CASE page_id % 9 WHEN 0 THEN 'Organization' WHEN 1 THEN 'Product|Service|Thing' WHEN 2 THEN 'FAQPage|Article'
  WHEN 3 THEN '{}LocalBusiness' WHEN 5 THEN 'QAPage' WHEN 6 THEN 'Dentist' ELSE '' END"""


@query("c08_schema_types", f"SELECT page_id, {_TYPES.format('')} AS types FROM pages")
def c08(spark, d):
    return pages(spark, d).select("page_id", F.array_join(J.schema_types(J.nodes("html")), "|").alias("types"))


@query("c09_count_tag", r"SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<p\b')) AS INTEGER) AS p, CAST(len(regexp_extract_all(html, '(?i)<script\b')) AS INTEGER) AS scripts FROM v_rich")
def c09(spark, d):
    return pages(spark, d).select("page_id", H.count_tag("html", "p").alias("p"), H.count_tag("html", "script").alias("scripts"))


SHELL = rf"""(contains(html, '<div id="root">') AND len(regexp_extract_all(html, '(?i)<script\b')) >= 3 AND length({TEXT}) < 800)"""


@query("c10_client_rendered", f"SELECT page_id, {SHELL} AS shell FROM v_rich")
def c10(spark, d):
    return pages(spark, d).select("page_id", H.looks_client_rendered("html", H.to_text("html")).alias("shell"))


def lead_sql(words: int) -> str:
    body = "html"
    for tag in ("header", "nav", "footer", "aside"):
        body = f"regexp_replace({body}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    return f"""lbody AS (SELECT page_id, host, {body} AS b FROM v_rich),
 lsrc AS (SELECT page_id, host, CASE WHEN strpos(b, '<main>') > 0 AND strpos(b, '<main>') < strpos(b, '<article>') THEN regexp_extract(b, '(?is)<main\\b[^>]*>(.*?)</main>', 1)
   WHEN strpos(b, '<article>') > 0 THEN regexp_extract(b, '(?is)<article\\b[^>]*>(.*?)</article>', 1) ELSE b END AS s FROM lbody),
 lpar AS (SELECT page_id, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM (SELECT page_id, regexp_extract_all(s, '(?is)<p\\b[^>]*>(.*?)</p>', 1) AS x FROM lsrc) t),
 ltxt AS (SELECT page_id, i, {text_sql('p')} AS t FROM lpar),
 ljoin AS (SELECT page_id, string_agg(t, ' ' ORDER BY i) AS t FROM ltxt WHERE len(regexp_split_to_array(t, '\\s+')) >= 8 GROUP BY page_id),
 lead AS (SELECT s.page_id, s.host, array_to_string(list_slice(regexp_split_to_array(coalesce(j.t, {text_sql('s.s')}), '\\s+'), 1, {words}), ' ') AS lead
   FROM lsrc s LEFT JOIN ljoin j ON j.page_id = s.page_id)"""


@query("c11_lead_copy", f"WITH {lead_sql(60)} SELECT page_id, lead FROM lead")
def c11(spark, d):
    return pages(spark, d).select("page_id", H.lead_copy("html", 60).alias("lead"))


@query("c12_page_snapshot", f"""WITH {HEADINGS}, {LINKS}, hc AS (SELECT page_id, count(*) AS n FROM heads WHERE text <> '' GROUP BY ALL), lc AS (SELECT page_id, count(*) AS n FROM links GROUP BY ALL)
SELECT v.page_id, length({TEXT}) AS text_length, {TITLE} AS title, {DESCRIPTION} AS description, coalesce(hc.n, 0) AS headings, coalesce(lc.n, 0) AS links,
 CASE v.page_id % 9 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 1 ELSE 0 END AS jsonld, length(html) AS bytes
FROM v_rich v LEFT JOIN hc ON hc.page_id = v.page_id LEFT JOIN lc ON lc.page_id = v.page_id""", ints="text_length headings links")
def c12(spark, d):
    return P.extract_pages(pages(spark, d)).select(
        "page_id", F.length("text").alias("text_length"), "title", "description", F.size("headings").alias("headings"),
        F.size("links").alias("links"), F.size("jsonld").alias("jsonld"), "bytes")


@query("c13_page_summary", rf"SELECT host, url, {TITLE} AS title, len(regexp_extract_all({TEXT}, '\S+')) AS words, {_TYPES.format('http://schema.org/')} AS schema_types FROM v_rich WHERE status = 200", ints="words")
def c13(spark, d):
    return P.page_summary(pages(spark, d)).withColumn("schema_types", F.array_join("schema_types", "|"))


@query("c14_site_summary", """SELECT s.host, s.origin, s.reachable, coalesce(p.n, 0) AS pages_crawled, s.n_sitemap AS sitemap_urls, s.robots_txt IS NOT NULL AS has_robots_txt,
 s.llms_txt IS NOT NULL AS has_llms_txt, CASE WHEN NOT s.reachable THEN 'HTTP 403' END AS error FROM v_sites s LEFT JOIN (SELECT host, count(*) FILTER (WHERE status = 200) AS n FROM v_rich GROUP BY host) p ON p.host = s.host""", ints="sitemap_urls")
def c14(spark, d):
    return P.site_summary(sites(spark, d), pages(spark, d))


AGENT = "AnswerScope"


@query("d06_crawl_permission", """SELECT p.page_id, CASE length(p.host) % 7
  WHEN 1 THEN NOT starts_with(path, '/private') WHEN 3 THEN NOT starts_with(path, '/en/') OR starts_with(path, '/en/1')
  WHEN 4 THEN NOT regexp_matches(path, '^/.*/2') WHEN 5 THEN false WHEN 6 THEN true ELSE true END AS allowed,
  length(p.host) % 7 = 5 AS site_blocked
FROM (SELECT *, CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) END AS path FROM v_pages) p""")
def d06(spark, d):
    urls = view(spark, d, "v_pages").select("host", "page_id", "url")
    return R.crawl_permission(urls, sites(spark, d), AGENT).select("page_id", "allowed", "site_blocked")


_PRIO = "\n".join(f"WHEN regexp_matches(path, '(?i){rx}') THEN {i}" for i, rx in enumerate(fixed.PRIORITY_PATHS))


@query("d07_select_pages", """WITH disc AS (SELECT host, page_id AS ord, url, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM v_pages),
 pr AS (SELECT host, k, arg_min(url, ord) AS url FROM disc, (VALUES %s) x(k, rx) WHERE regexp_matches(path, '(?i)' || rx) GROUP BY ALL),
 cand AS (SELECT host, origin AS url, 0 AS tier, 0 AS a, 0 AS b, 0 AS c FROM v_sites
  UNION ALL SELECT host, origin || k.path, 1, k.n, 0, 0 FROM v_sites, (VALUES (0, '/key'), (1, '/pricing'), (2, '/b/c'), (3, '/up')) k(n, path)
  UNION ALL SELECT host, url, 2, k, 0, 0 FROM pr
  UNION ALL SELECT host, url, 3, len(list_filter(string_split(path, '/'), lambda s: s <> '')), length(url), ord FROM disc),
 cl AS (SELECT host, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS url, tier, a, b, c FROM cand),
 dd AS (SELECT host, url, min([tier, a, b, c]) AS place FROM cl WHERE NOT regexp_matches(url, '(?i)%s') GROUP BY ALL),
 r AS (SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY place, url) AS pick FROM dd)
SELECT * FROM r WHERE pick <= 12""" % (", ".join(f"({i}, '{rx}')" for i, rx in enumerate(fixed.PRIORITY_PATHS)), fixed.ASSET_PATTERN), ints="pick")
def d07(spark, d):
    s = sites(spark, d).select("host", "origin")
    found = view(spark, d, "v_pages").select("host", F.col("page_id").alias("ord"), "url")
    # spellings of four pages: with a query, relative, with dot segments, capitals and the default port
    pinned = s.select("host", F.posexplode(F.array(
        F.concat("origin", F.lit("/key?x=1")), F.lit(" /pricing"), F.concat("origin", F.lit("/a/../b/./c#top")), F.lit("up/"),
        F.concat(F.upper("origin"), F.when(F.startswith("origin", F.lit("https")), ":443").otherwise(":80"), F.lit("/pricing?again")))).alias("ord", "url"))
    return P.select_pages(s, found, pinned)
