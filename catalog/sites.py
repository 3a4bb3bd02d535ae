"""D1-D5, I: robots.txt, access audit, readiness checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerscope import fixed
from answerscope.operators import evidence as E
from answerscope.operators import readiness as I
from answerscope.operators import robots as R
from catalog.base import AS_OF, as_of, brands, pages, query, sites, view
from catalog.html_queries import DESCRIPTION, HEADINGS, LINKS, SHELL, TEXT, TITLE, lead_sql, meta_sql

# directives of every robots.txt, relationally
ROBOTS = r"""rl AS (SELECT host, unnest(x) AS raw, generate_subscripts(x, 1) - 1 AS line_no FROM (SELECT host, string_split(replace(robots_txt, chr(13), ''), chr(10)) AS x FROM v_sites WHERE robots_txt IS NOT NULL) t),
 rc AS (SELECT host, line_no, trim(regexp_replace(raw, '#.*$', '')) AS line FROM rl),
 rf AS (SELECT host, line_no, lower(trim(split_part(line, ':', 1))) AS field, trim(substr(line, strpos(line, ':') + 1)) AS value FROM rc WHERE strpos(line, ':') > 1),
 rn AS (SELECT *, field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY host ORDER BY line_no), '') <> 'user-agent' AS opens FROM rf),
 rg AS (SELECT *, sum(opens::INT) OVER (PARTITION BY host ORDER BY line_no) AS group_id FROM rn),
 dir AS (SELECT host, group_id, line_no, CASE field WHEN 'user-agent' THEN 'agent' ELSE field END AS kind, CASE field WHEN 'user-agent' THEN lower(value) ELSE value END AS value
   FROM rg WHERE group_id > 0 AND field IN ('user-agent', 'allow', 'disallow'))"""
BOTS = "bots(crawler_ord, ua, label, critical) AS (VALUES {})".format(", ".join(
    f"({i}, '{ua}', '{label}', {str(crit).lower()})" for i, (ua, label, crit) in enumerate(fixed.CRAWLERS)))
GROUPS = """gm AS (SELECT d.host, b.ua, d.group_id, row_number() OVER (PARTITION BY d.host, b.ua ORDER BY CASE WHEN d.value = '*' THEN 0 ELSE length(d.value) END DESC, d.line_no) AS k
   FROM dir d JOIN bots b ON d.kind = 'agent' AND (d.value = '*' OR starts_with(lower(b.ua), d.value) OR starts_with(d.value, lower(b.ua)))),
 g AS (SELECT host, ua, group_id FROM gm WHERE k = 1)"""
# a path pattern as an RE2 regex
PATTERN = r"""'^' || regexp_replace(regexp_replace(regexp_replace(r.value, '\$$', ''), '([.+?^${}()|\[\]\\])', '\\\1', 'g'), '\*', '.*', 'g') || CASE WHEN r.value LIKE '%$' THEN '$' ELSE '' END"""


def verdict_sql(path: str, targets: str) -> str:
    return f"""vr AS (SELECT t.host, t.path, g.ua, r.kind, length(r.value) AS n FROM {targets} t JOIN g ON g.host = t.host JOIN dir r ON r.host = g.host AND r.group_id = g.group_id
   AND r.kind <> 'agent' AND r.value <> '' AND (r.value = '/' OR regexp_matches({path}, {PATTERN}))),
 vv AS (SELECT host, path, ua, max(n * 2 + CASE kind WHEN 'allow' THEN 1 ELSE 0 END) % 2 = 1 AS allowed FROM vr GROUP BY ALL)"""


@query("d01_parse_robots", f"WITH {ROBOTS} SELECT * FROM dir", longs="group_id", ints="line_no")
def d01(spark, d):
    return R.parse_robots(sites(spark, d))


@query("d02_group_for", f"WITH {ROBOTS}, {BOTS}, {GROUPS} SELECT host, ua, group_id FROM g", longs="group_id")
def d02(spark, d):
    return R.group_for(R.parse_robots(sites(spark, d)), R.all_crawlers())


@query("d03_path_matches", f"""WITH {ROBOTS}, paths AS (SELECT DISTINCT host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM v_pages)
SELECT p.host, p.path, count(r.line_no) AS rules, coalesce(string_agg(r.line_no::VARCHAR, ',' ORDER BY r.line_no) FILTER (WHERE CASE WHEN r.value = '' THEN false WHEN r.value = '/' THEN true ELSE regexp_matches(p.path, {PATTERN}) END), '') AS matched
FROM paths p JOIN dir r ON r.host = p.host AND r.kind <> 'agent' GROUP BY p.host, p.path""", ints="rules")
def d03(spark, d):
    # the few rules of a host travel as one array, so paths are not multiplied by them
    rules = R.parse_robots(sites(spark, d)).where("kind <> 'agent'").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("rules"))
    path = F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1)
    paths = view(spark, d, "v_pages").select("host", path.alias("path")).distinct()
    return paths.join(rules, "host").select(
        "host", "path", F.size("rules").alias("rules"), F.array_join(F.transform(F.filter(
            "rules", lambda r: R.path_matches(r["value"], F.col("path"))), lambda r: r["line_no"].cast("string")), ",").alias("matched"))


@query("d04_is_allowed", f"""WITH {ROBOTS}, {BOTS}, {GROUPS}, targets AS (SELECT DISTINCT host, regexp_extract(url || '/', '^https?://[^/?#]*([^?#]*)', 1) AS path FROM v_pages),
 {verdict_sql('t.path', 'targets')}
SELECT t.host, t.path, b.ua, coalesce(v.allowed, true) AS allowed FROM targets t CROSS JOIN bots b LEFT JOIN vv v ON v.host = t.host AND v.path = t.path AND v.ua = b.ua""")
def d04(spark, d):
    path = F.regexp_extract(F.concat("url", F.lit("/")), "^https?://[^/?#]*([^?#]*)", 1)
    targets = view(spark, d, "v_pages").select("host", path.alias("path")).distinct()
    return R.is_allowed(targets, R.parse_robots(sites(spark, d)), R.all_crawlers()).select("host", "path", "ua", "allowed")


ACCESS = f"""{ROBOTS}, {BOTS}, {GROUPS}, roots AS (SELECT host, '/' AS path FROM v_sites), {verdict_sql("'/'", 'roots')},
 acc AS (SELECT s.host, b.crawler_ord, b.ua, b.label, b.critical, coalesce(v.allowed, true) AS allowed,
  EXISTS (SELECT 1 FROM dir d WHERE d.host = s.host AND d.kind = 'agent' AND d.value = lower(b.ua)) AS explicit
  FROM v_sites s CROSS JOIN bots b LEFT JOIN vv v ON v.host = s.host AND v.ua = b.ua)"""


@query("d05_audit_ai_access", f"WITH {ACCESS} SELECT * FROM acc")
def d05(spark, d):
    return R.audit_ai_access(sites(spark, d))


# --- checks: score and fix per host ---------------------------------------------------------

OKP = "(status = 200)"
HOSTS = "h AS (SELECT host FROM v_sites)"


def share(cond: str, none: float) -> str:
    """Share of fetched pages with a property."""
    return f"""coalesce(avg(CASE WHEN {OKP} THEN ({cond})::INT END), {none})"""


def per_page(score: str, extra: str = "", src: str = "v_rich", has: str = f"count(*) FILTER (WHERE {OKP})") -> str:
    ctes = f"{extra}, " if extra else ""
    return f"{ctes}sc AS (SELECT host, {score} AS score, {has} AS n_ok FROM {src} GROUP BY host)"


def steps(v: str, pairs: list[tuple[float, float]], other: float) -> str:
    return "CASE " + " ".join(f"WHEN {v} >= {a} THEN {s}" for a, s in pairs) + f" ELSE {other} END"


NODES = """nd AS (SELECT host, page_id, page_id % 9 AS k, page_id % 7 AS b, status FROM v_rich)"""
COMPARE_RX = r"(?i)\bvs\b|\bversus\b|\balternatives?\b|\bcompare|comparison\b|\bbest\b.{0,40}\b(for|in|of)\b"
FIG_RX = r"(?i)\b\d{1,3}(?:\.\d+)?%|\b(?:\d{1,3},)+\d{3}\b|\$\s?\d[\d,.]*(?:\s?(?:k|m|bn|billion|million))?\b|\b\d+x\b"
Q_RX = r"(?i)^(how|what|why|when|where|who|which|can|do|does|is|are|should|will)\b|\?$"
WORDS = rf"len(regexp_extract_all({TEXT}, '\S+'))"

# check id -> SQL that defines sc(host, score, n_ok); n_ok > 0 lets a fix be raised
CHECK_SQL: dict[str, str] = {
    "ai-crawler-access": f"{ACCESS}, sc AS (SELECT host, avg(allowed::INT) FILTER (WHERE critical) AS score, count(*) FILTER (WHERE NOT allowed) AS n_ok FROM acc GROUP BY host)",
    "robots-txt": "sc AS (SELECT host, CASE WHEN robots_txt IS NULL THEN 0.2 WHEN contains(lower(robots_txt), 'sitemap:') THEN 1 ELSE 0.65 END AS score, 1 AS n_ok FROM v_sites)",
    "llms-txt": "sc AS (SELECT host, CASE length(host) % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 0.6 END AS score, 1 AS n_ok FROM v_sites)",
    "sitemap": "sc AS (SELECT host, CASE WHEN n_sitemap = 0 THEN 0.1 WHEN n_sitemap < 5 THEN 0.5 WHEN n_sitemap < 15 THEN 0.8 ELSE 1 END AS score, 1 AS n_ok FROM v_sites)",
    "https": "sc AS (SELECT host, (origin LIKE 'https%')::INT AS score, 1 AS n_ok FROM v_sites)",
    "server-rendering": per_page(f"coalesce(1 - avg(CASE WHEN {OKP} THEN ({SHELL} OR {WORDS} < 120)::INT END), 0)"),
    "response-speed": f"l AS (SELECT host, avg(latency_ms) FILTER (WHERE {OKP} AND latency_ms > 0) AS ms, count(*) FILTER (WHERE {OKP} AND latency_ms > 0) AS n_ok FROM v_rich GROUP BY host), "
                      "sc AS (SELECT host, CASE WHEN ms IS NULL THEN 0.5 WHEN ms < 600 THEN 1 WHEN ms < 1500 THEN 0.8 WHEN ms < 3000 THEN 0.5 ELSE 0.2 END AS score, n_ok FROM l)",
    "canonical": per_page(share("contains(html, 'rel=\"canonical\"')", 0.5)),
    "jsonld-present": per_page(share("page_id % 9 NOT IN (4, 7, 8)", 0.0), has="1"),
    "entity-schema": f"{NODES}, sc AS (SELECT host, CASE WHEN NOT bool_or(k IN (0, 3, 6)) THEN 0.1 WHEN bool_or(k = 0) THEN 1 ELSE 0.65 END AS score, 1 AS n_ok FROM nd GROUP BY host)",
    "faq-schema": f"{NODES}, sc AS (SELECT host, CASE WHEN NOT bool_or(k IN (2, 5)) THEN 0 WHEN bool_or(k = 2) THEN 1 ELSE 0.7 END AS score, 1 AS n_ok FROM nd GROUP BY host)",
    "offer-schema": f"{NODES}, sc AS (SELECT host, CASE WHEN NOT bool_or(k = 1) THEN 0.15 ELSE 1 END AS score, 1 AS n_ok FROM nd GROUP BY host)",
    "heading-hierarchy": f"{HEADINGS}, pg AS (SELECT page_id, count(*) FILTER (WHERE level = 1) AS h1, count(*) FILTER (WHERE level = 2) AS h2 FROM heads WHERE text <> '' GROUP BY page_id), "
                         f"sc AS (SELECT v.host, coalesce(avg(CASE WHEN {OKP} THEN coalesce(h1 = 1 AND h2 >= 2, false)::INT END), 0.5) AS score, count(*) FILTER (WHERE {OKP}) AS n_ok FROM v_rich v LEFT JOIN pg ON pg.page_id = v.page_id GROUP BY v.host)",
    "question-headings": f"{HEADINGS}, q AS (SELECT host, count(*) FILTER (WHERE level >= 2) AS n, count(*) FILTER (WHERE level >= 2 AND regexp_matches(text, '{Q_RX}')) AS q FROM heads WHERE text <> '' AND {OKP} GROUP BY host), "
                         "sc AS (SELECT h.host, CASE WHEN coalesce(q, 0) = 0 THEN 0.1 WHEN q / n >= 0.25 THEN 1 WHEN q / n >= 0.12 THEN 0.7 ELSE 0.4 END AS score, 1 AS n_ok FROM v_sites h LEFT JOIN q ON q.host = h.host)",
    "semantic-html": per_page(share(r"regexp_matches(html, '(?i)<(main|article)\b')", 0.5)),
    "meta-description": per_page(share(f"length({DESCRIPTION}) >= 60", 0.5)),
    "answer-capsule": f"{lead_sql(60)}, cap AS (SELECT page_id, len(regexp_extract_all(lead, '\\S+')) >= 15 AND NOT regexp_matches(lead, '(?i)^(welcome|we are|we''re|founded in|for over \\d+|since \\d{{4}}|our (team|mission|story)|at [a-z])') "
                      "AND len(regexp_extract_all(regexp_extract(lead, '^[^.!?]*'), '\\S+')) BETWEEN 6 AND 45 AS ok FROM lead), "
                      f"sc AS (SELECT v.host, coalesce(avg(CASE WHEN {OKP} THEN ok::INT END), 0.5) AS score, count(*) FILTER (WHERE {OKP}) AS n_ok FROM v_rich v JOIN cap ON cap.page_id = v.page_id GROUP BY v.host)",
    "comparison-content": f"u AS (SELECT host, url FROM v_rich WHERE regexp_matches(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '{COMPARE_RX}') OR regexp_matches({TITLE}, '{COMPARE_RX}') "
                          "UNION SELECT host, origin || '/compare/' || i FROM (SELECT host, origin, unnest(range(1, n_sitemap + 1)) AS i FROM v_sites) t WHERE i % 8 = 5), "
                          "c AS (SELECT host, count(*) AS n FROM u GROUP BY host), sc AS (SELECT s.host, " + steps("coalesce(n, 0)", [(3, 1), (2, 0.75), (1, 0.45)], 0.05) + " AS score, 1 AS n_ok FROM v_sites s LEFT JOIN c ON c.host = s.host)",
    "faq-content": f"{HEADINGS}, q AS (SELECT host, count(*) AS q FROM heads WHERE {OKP} AND text LIKE '%?' GROUP BY host), f AS (SELECT host, bool_or({OKP} AND regexp_matches(url, '(?i)faq|frequently-asked|questions')) AS f FROM v_rich GROUP BY host), "
                   "sc AS (SELECT f.host, CASE WHEN q >= 6 THEN 1 WHEN q >= 3 THEN 0.75 WHEN f THEN 0.5 WHEN q > 0 THEN 0.35 ELSE 0.05 END AS score, 1 AS n_ok FROM f LEFT JOIN q ON q.host = f.host)",
    "content-depth": f"w AS (SELECT host, {WORDS} AS words FROM v_rich WHERE {OKP}), m AS (SELECT host, list_sort(list(words))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS med, count(*) AS n_ok FROM w GROUP BY host), "
                     "sc AS (SELECT s.host, CASE WHEN med IS NULL THEN 0.5 WHEN med >= 800 THEN 1 WHEN med >= 500 THEN 0.8 WHEN med >= 300 THEN 0.55 ELSE 0.25 END AS score, coalesce(n_ok, 0) AS n_ok FROM v_sites s LEFT JOIN m ON m.host = s.host)",
    "quotable-stats": per_page(share(f"len(regexp_extract_all({TEXT}, '{FIG_RX}')) >= 3", 0.5)),
    "freshness": f"{NODES}, dt AS (SELECT host, max(greatest(CASE k WHEN 2 THEN TIMESTAMP '2023-11-05' WHEN 5 THEN TIMESTAMP '2024-01-10 08:00:00' END, CASE WHEN b = 3 THEN CAST('2024-01-' || CAST(10 + page_id % 20 AS VARCHAR) AS TIMESTAMP) END)) AS newest FROM nd GROUP BY host), "
                 f"ag AS (SELECT host, floor((epoch(TIMESTAMP '{AS_OF}') - epoch(newest)) / 86400) AS days FROM dt), "
                 "sc AS (SELECT host, CASE WHEN days IS NULL THEN 0.15 WHEN days <= 60 THEN 1 WHEN days <= 180 THEN 0.75 WHEN days <= 365 THEN 0.45 ELSE 0.2 END AS score, 1 AS n_ok FROM ag)",
    "third-party-signals": f"{NODES}, {LINKS}, pf AS (SELECT host, 'linkedin.com' AS p FROM nd WHERE k = 0 UNION SELECT host, 'social.example' FROM nd WHERE k = 0 "
                           r"UNION SELECT host, regexp_extract(u, '^https?://(?:www[.])?(?:[^/]*[.])?((?:g2|reddit)[.]com)(?:/|$)', 1) FROM links), "
                           "c AS (SELECT host, count(*) AS n FROM pf WHERE p <> '' GROUP BY host), sc AS (SELECT s.host, " + steps("coalesce(n, 0)", [(5, 1), (3, 0.75), (1, 0.45)], 0.05) + " AS score, 1 AS n_ok FROM v_sites s LEFT JOIN c ON c.host = s.host)",
    "contact-signals": rf"t AS (SELECT host, bool_or(page_id % 9 = 3) AS k, string_agg({TEXT}, chr(10) ORDER BY page_ord, url) AS t FROM v_rich GROUP BY host), c AS (SELECT host, k OR regexp_matches(t, '\+?\d[\d\s().-]{{7,}}\d') AS p, k OR regexp_matches(t, '(?i)\b\d{{1,5}}\s+[A-Z][a-zA-Z]+\s+(street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|suite|ste)\b') AS a, "
                       r"regexp_matches(t, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}') AS e FROM t), sc AS (SELECT host, (p::INT + a::INT + e::INT) / 3 AS score, 1 AS n_ok FROM c)",
    "authorship": rf"t AS (SELECT host, page_id % 9 = 2 AS ld, {meta_sql('author')} <> '' AS m, regexp_matches(substr({TEXT}, 1, 4000), '\bby\s+[A-Z][a-z]+\s+[A-Z][a-z]+') AS b FROM v_rich), "
                  "sc AS (SELECT host, CASE WHEN bool_or(ld) THEN 1 WHEN bool_or(m) THEN 0.7 WHEN bool_or(b) THEN 0.45 ELSE 0.1 END AS score, 1 AS n_ok FROM t GROUP BY host)",
    "entity-clarity": f"{lead_sql(120)}, hm AS (SELECT v.host, v.status, split_part(v.host, '.', 1) AS nm, lower(strip_accents({TITLE} || ' ' || {DESCRIPTION} || ' ' || l.lead)) AS t FROM v_rich v JOIN lead l ON l.page_id = v.page_id WHERE v.page_ord = 0), "
                      "sc AS (SELECT host, CASE WHEN status <> 200 THEN 0.3 ELSE CASE WHEN contains(t, 'the') AND (length(nm) < 3 OR contains(t, nm)) THEN 0.4::DOUBLE ELSE 0::DOUBLE END + (contains(t, 'page')::INT + contains(t, 'summary')::INT + contains(t, 'reports')::INT) / 3.0::DOUBLE * 0.4::DOUBLE "
                      "+ CASE WHEN length(host) % 2 = 1 OR contains(t, 'there') OR contains(t, 'onto') THEN 0.2::DOUBLE ELSE 0::DOUBLE END END AS score, (status = 200)::INT AS n_ok FROM hm)",
}


# fixed values, stated apart from the library's: id, pillar, weight, fix and the score below which it is raised
EXPECTED = [
    ("ai-crawler-access", "technical", 10, "unblock-ai-crawlers", 1.0),
    ("robots-txt", "technical", 3, "ship-robots-txt", 1.0),
    ("llms-txt", "technical", 4, "publish-llms-txt", 1.0),
    ("sitemap", "technical", 3, "ship-sitemap", 0.8),
    ("https", "technical", 3, "enable-https", 1.0),
    ("server-rendering", "technical", 8, "server-render-content", 0.9),
    ("response-speed", "technical", 2, "speed-up-origin", 0.8),
    ("canonical", "technical", 2, "add-canonical", 0.8),
    ("jsonld-present", "structure", 7, "add-jsonld", 0.8),
    ("entity-schema", "structure", 6, "add-entity-schema", 1.0),
    ("faq-schema", "structure", 5, "add-faq-schema", 1.0),
    ("offer-schema", "structure", 4, "add-offer-schema", 1.0),
    ("heading-hierarchy", "structure", 4, "fix-headings", 0.8),
    ("question-headings", "structure", 5, "question-headings", 0.8),
    ("semantic-html", "structure", 2, "semantic-landmarks", 0.8),
    ("meta-description", "structure", 2, "write-meta-descriptions", 0.8),
    ("answer-capsule", "content", 7, "write-answer-capsules", 0.8),
    ("comparison-content", "content", 8, "build-comparison-pages", 0.75),
    ("faq-content", "content", 6, "add-faq-content", 0.75),
    ("content-depth", "content", 4, "deepen-content", 0.8),
    ("quotable-stats", "content", 5, "add-quotable-stats", 0.7),
    ("freshness", "content", 4, "add-freshness-signals", 0.75),
    ("third-party-signals", "authority", 6, "build-third-party-presence", 0.75),
    ("contact-signals", "authority", 4, "publish-nap", 1.0),
    ("authorship", "authority", 3, "add-authorship", 0.7),
    ("entity-clarity", "content", 5, "clarify-entity", 0.8),
]


def check_row(check: tuple) -> str:
    """(host, check_id, score, status, fix_id) of one check from its ``sc``."""
    check_id, _, _, fix, below = check
    raised = f"score < {below} AND n_ok > 0"
    if check_id == "ai-crawler-access":
        raised = "n_ok > 0"
    return f"""SELECT host, '{check_id}' AS check_id, round(greatest(0, least(1, score))::DOUBLE, 9) AS score, CASE WHEN score >= 0.8 THEN 'pass' WHEN score >= 0.45 THEN 'warn' ELSE 'fail' END AS status,
 CASE WHEN {raised} THEN '{fix}' END AS fix_id FROM sc"""


def _register(n: int, check: tuple) -> None:
    @query(f"i{n:02d}_{check[0].replace('-', '_')}", f"WITH {CHECK_SQL[check[0]]} {check_row(check)}")
    def run(spark, d, check_id=check[0]):
        rows = I.run_checks(sites(spark, d), pages(spark, d), brands(spark, d), as_of(), only=[check_id])
        return rows.select("host", "check_id", F.round("score", 9).alias("score"), "status", "fix_id")


# numbered as the inventory numbers them: clarity is 23 there, last in the suite
for _n, _check in enumerate([*EXPECTED[:22], EXPECTED[25], *EXPECTED[22:25]], 1):
    _register(_n, _check)


def _all_checks_sql() -> str:
    parts = [f"SELECT * FROM (WITH {CHECK_SQL[c[0]]} {check_row(c)}) c{i}" for i, c in enumerate(EXPECTED)]
    return " UNION ALL ".join(parts)


SPEC = "spec(check_id, check_ord, pillar, weight) AS (VALUES {})".format(", ".join(
    f"('{c[0]}', {i}, '{c[1]}', {c[2]})" for i, c in enumerate(EXPECTED)))
ALL_CHECKS = f"allc AS ({_all_checks_sql()}), {SPEC}, chk AS (SELECT allc.*, check_ord, pillar, weight FROM allc JOIN spec USING (check_id))"


def all_checks(spark, d):
    return I.run_checks(sites(spark, d), pages(spark, d), brands(spark, d), as_of())


@query("i27_run_checks", f"WITH {ALL_CHECKS} SELECT host, check_ord, check_id, pillar, weight, score, status, fix_id FROM chk")
def i27(spark, d):
    return all_checks(spark, d).withColumn("score", F.round("score", 9))


_FAILS = {
    "canonical": """NOT contains(html, 'rel="canonical"')""", "jsonld-present": "page_id % 9 IN (4, 7, 8)",
    "semantic-html": r"NOT regexp_matches(html, '(?i)<(main|article)\b')", "meta-description": f"length({DESCRIPTION}) < 60",
    "quotable-stats": f"len(regexp_extract_all({TEXT}, '{FIG_RX}')) < 3"}


@query("i27_evidence", "WITH f AS ({}), r AS (SELECT *, row_number() OVER (PARTITION BY host, check_id ORDER BY page_ord, url) AS k FROM f) SELECT host, check_id, string_agg(url, ' ' ORDER BY k) AS evidence FROM r WHERE k <= 5 GROUP BY ALL".format(
    " UNION ALL ".join(f"SELECT host, '{c}' AS check_id, page_ord, url FROM v_rich WHERE {OKP} AND {cond}" for c, cond in _FAILS.items())))
def i27_evidence(spark, d):
    """Which pages fail a check of pages, the first five of each host."""
    return I.failing_pages(pages(spark, d), list(_FAILS)).withColumn("evidence", F.array_join("evidence", " "))


@query("i27_evidence_sites", rf"""WITH {ACCESS}, e AS (
 SELECT host, 'robots-txt' AS check_id, 'lines ' || len(string_split(replace(robots_txt, chr(13), ''), chr(10))) AS evidence FROM v_sites WHERE robots_txt <> ''
 UNION ALL SELECT host, 'llms-txt', 'lines ' || len(string_split(llms_txt, chr(10))) || ' | links ' || len(regexp_extract_all(llms_txt, '\]\(')) FROM v_sites WHERE llms_txt <> ''
 UNION ALL SELECT host, 'sitemap', 'urls ' || n_sitemap FROM v_sites WHERE n_sitemap > 0
 UNION ALL SELECT host, 'https', origin FROM v_sites
 UNION ALL SELECT host, 'ai-crawler-access', string_agg(label, ' | ' ORDER BY crawler_ord) FROM acc WHERE NOT allowed GROUP BY host) SELECT * FROM e""")
def i27_evidence_sites(spark, d):
    return E.site_evidence(sites(spark, d)).withColumn("evidence", F.array_join("evidence", " | "))


_LISTED = rf"""{LINKS}, types(k, nth, t) AS (VALUES (0, 0, 'Organization'), (1, 0, 'Product'), (1, 1, 'Service'), (1, 2, 'Thing'), (2, 0, 'FAQPage'), (2, 1, 'Article'), (3, 0, 'LocalBusiness'), (5, 0, 'QAPage'), (6, 0, 'Dentist')),
 seen AS (SELECT host, 'jsonld-present' AS check_id, t AS value, 0 AS tier, page_ord AS spot, nth FROM v_rich JOIN types ON k = page_id % 9
  UNION ALL SELECT host, 'entity-schema', t, 0, page_ord, nth FROM v_rich JOIN types ON k = page_id % 9 WHERE t IN ('Organization', 'LocalBusiness', 'Dentist')
  UNION ALL SELECT host, 'comparison-content', url, 0, page_ord, 0 FROM v_rich WHERE regexp_matches(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '{COMPARE_RX}')
  UNION ALL SELECT host, 'comparison-content', origin || '/compare/' || i, 1, i, 0 FROM (SELECT host, origin, unnest(range(1, n_sitemap + 1)) AS i FROM v_sites) t WHERE i % 8 = 5
  UNION ALL SELECT l.host, 'third-party-signals', regexp_extract(u, '^https?://(?:www[.])?(?:[^/]*[.])?((?:g2|reddit)[.]com)(?:/|$)', 1), 0, page_ord, i FROM links l JOIN v_rich USING (page_id)
  UNION ALL SELECT host, 'third-party-signals', unnest(['linkedin.com', 'social.example']), 1, page_ord, unnest([0, 1]) FROM v_rich WHERE page_id % 9 = 0),
 once AS (SELECT host, check_id, value, min(tier * 1000000000000 + spot * 100000 + nth) AS place FROM seen WHERE value <> '' GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY host, check_id ORDER BY place) AS k FROM once)"""


@query("i27_evidence_listed", f"WITH {_LISTED} SELECT host, check_id, string_agg(value, ' | ' ORDER BY k) AS evidence FROM r WHERE k <= CASE check_id WHEN 'comparison-content' THEN 6 WHEN 'third-party-signals' THEN 10 ELSE 12 END GROUP BY ALL")
def i27_evidence_listed(spark, d):
    """The first types, comparison URLs and profiles of each host, distinct, in order."""
    return E.listed_evidence(sites(spark, d), pages(spark, d)).withColumn("evidence", F.array_join("evidence", " | "))


@query("i27_evidence_measured", rf"""WITH {lead_sql(25)}, w AS (SELECT host, {WORDS} AS words FROM v_rich WHERE {OKP}),
 dts AS (SELECT host, CASE page_id % 9 WHEN 2 THEN TIMESTAMP '2023-11-05' WHEN 5 THEN TIMESTAMP '2024-01-10 08:00:00' END AS stamp FROM v_rich
  UNION ALL SELECT host, CAST('2024-01-' || CAST(10 + page_id % 20 AS VARCHAR) AS TIMESTAMP) FROM v_rich WHERE page_id % 7 = 3)
 SELECT host, 'response-speed' AS check_id, 'ms ' || floor(avg(latency_ms) + 0.5)::BIGINT || ' | pages ' || count(*) AS evidence FROM v_rich WHERE {OKP} AND latency_ms > 0 GROUP BY host
 UNION ALL SELECT host, 'content-depth', 'median ' || list_sort(list(words))[CAST(floor(count(*) / 2) AS INTEGER) + 1] || ' | under 300 ' || count(*) FILTER (WHERE words < 300) FROM w GROUP BY host
 UNION ALL SELECT host, 'freshness', 'newest ' || strftime(max(stamp), '%Y-%m-%d') || ' | dates ' || count(stamp) FROM dts GROUP BY host HAVING count(stamp) > 0
 UNION ALL SELECT v.host, 'entity-clarity', lead FROM v_rich v JOIN lead l ON l.page_id = v.page_id WHERE v.page_ord = 0 AND {OKP}""")
def i27_evidence_measured(spark, d):
    """Figures behind the scores of each host: response time, depth, dates, the home page's first words."""
    return E.measured_evidence(pages(spark, d)).withColumn("evidence", F.array_join("evidence", " | "))


READY = f"""{ALL_CHECKS}, pil AS (SELECT host, pillar, sum(score * weight) / sum(weight) AS v FROM chk GROUP BY ALL),
 rdy AS (SELECT host, floor(sum(v * CASE pillar WHEN 'technical' THEN 0.3 WHEN 'structure' THEN 0.25 WHEN 'content' THEN 0.3 ELSE 0.15 END) * 1000 + 0.5) / 1000 AS overall,
  floor(max(v) FILTER (WHERE pillar = 'technical') * 1000 + 0.5) / 1000 AS technical, floor(max(v) FILTER (WHERE pillar = 'structure') * 1000 + 0.5) / 1000 AS structure,
  floor(max(v) FILTER (WHERE pillar = 'content') * 1000 + 0.5) / 1000 AS content, floor(max(v) FILTER (WHERE pillar = 'authority') * 1000 + 0.5) / 1000 AS authority FROM pil GROUP BY host),
 cnt AS (SELECT host, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'warn') AS n_warn, count(*) FILTER (WHERE status = 'fail') AS n_fail, count(*) AS n_total FROM chk GROUP BY host)"""


@query("i28_score_readiness", f"WITH {READY} SELECT * FROM rdy JOIN cnt USING (host)")
def i28(spark, d):
    return I.score_readiness(all_checks(spark, d))


ASSESS = f"""{READY}, bl AS (SELECT host, NOT reachable OR robots_blocked AS blocked, robots_blocked, reachable FROM v_sites),
 asmt AS (SELECT b.host, blocked, blocked AND robots_blocked AS robots_blocked, CASE WHEN NOT blocked THEN '' WHEN robots_blocked THEN 'robots' ELSE 'HTTP 403' END AS blocked_reason,
  CASE WHEN NOT blocked THEN overall END AS overall, CASE WHEN NOT blocked THEN technical END AS technical, CASE WHEN NOT blocked THEN structure END AS structure,
  CASE WHEN NOT blocked THEN content END AS content, CASE WHEN NOT blocked THEN authority END AS authority,
  CASE WHEN blocked THEN 0 ELSE n_pass END AS n_pass, CASE WHEN blocked THEN 0 ELSE n_warn END AS n_warn, CASE WHEN blocked THEN 0 ELSE n_fail END AS n_fail, CASE WHEN blocked THEN 0 ELSE n_total END AS n_total
  FROM bl b JOIN rdy USING (host) JOIN cnt USING (host))"""


@query("i29_assess_readiness", f"WITH {ASSESS} SELECT * FROM asmt")
def i29(spark, d):
    return I.assess_readiness(sites(spark, d), all_checks(spark, d))
