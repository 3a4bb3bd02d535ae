"""E5-E7, F, G: aggregates over outcomes and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerscope.operators import metrics as M
from answerscope.operators import surfaces as G
from catalog.base import outcome_entities, outcomes, query, table, view

R3 = "floor(({}) * 1000 + 0.5) / 1000"
R2 = "floor(({}) * 100 + 0.5) / 100"

# brand view of every outcome with rank and score, straight from the long mentions
BRANDED = """men AS (SELECT *, CASE WHEN mentioned THEN raw_role ELSE 'referenced' END AS role,
    CASE WHEN mentioned THEN raw_sentiment ELSE 0 END AS sentiment,
    CASE WHEN mentioned THEN row_number() OVER (PARTITION BY ord ORDER BY CASE WHEN mentioned THEN 0 ELSE 1 END, first_index, entity_ord) ELSE 0 END AS rank
    FROM v_mentions),
 o AS (SELECT v.*, m.mentioned, m.role, m.sentiment, m.rank,
    CASE WHEN v.status <> 'answered' OR NOT m.mentioned OR m.role = 'dismissed' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE,
      0.55::DOUBLE * CASE m.role WHEN 'recommended' THEN 1.0::DOUBLE WHEN 'listed' THEN 0.7::DOUBLE ELSE 0.45::DOUBLE END
      + 0.30::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + 0.35::DOUBLE * (m.rank - 1)))
      + greatest(-0.5::DOUBLE, least(0.5::DOUBLE, m.sentiment)) * 0.2::DOUBLE
      + CASE WHEN v.own_cited THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)) END AS score
    FROM v_outcomes v JOIN men m ON m.ord = v.ord AND m.entity_ord = 0),
 a AS (SELECT * FROM o WHERE status = 'answered')"""


def joined(col: str, name: str):
    return F.array_join(col, "|").alias(name)


@query("e05_job_matrix", """
WITH e AS (SELECT DISTINCT brand_key, engine FROM v_docs), p AS (SELECT brand_key, prompt_id FROM v_prompts),
m AS (SELECT brand_key, engine, prompt_id, unnest(range(3)) AS sample FROM e JOIN p USING (brand_key))
SELECT brand_key, engine, count(*) AS jobs, count(*) FILTER (WHERE ord IS NULL) AS missing
FROM m LEFT JOIN (SELECT brand_key, engine, prompt_id, sample, min(ord) AS ord FROM v_docs GROUP BY ALL) x USING (brand_key, engine, prompt_id, sample)
GROUP BY ALL""")
def e05(spark, d):
    docs = view(spark, d, "v_docs")
    engines = docs.select("brand_key", "engine").distinct()
    prompts = view(spark, d, "v_prompts").select("brand_key", "prompt_id")
    matrix = M.job_matrix(engines, prompts, 3)
    missing = M.missing_jobs(matrix, docs).groupBy("brand_key", "engine").agg(F.count("*").alias("missing"))
    return matrix.groupBy("brand_key", "engine").agg(F.count("*").alias("jobs")).join(
        missing, ["brand_key", "engine"], "left").withColumn("missing", F.coalesce("missing", F.lit(0)))


@query("e06_failures", """
WITH f AS (SELECT run_id, brand_key, error, min(ord) AS o, count(*) AS n FROM v_outcomes WHERE status <> 'answered' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, brand_key ORDER BY o) AS k FROM f)
SELECT run_id, brand_key, sum(n) AS failed, count(*) AS distinct_errors, string_agg(error, '|' ORDER BY k) FILTER (WHERE k <= 3) AS errors FROM r GROUP BY ALL""", longs="failed")
def e06(spark, d):
    return M.failures(outcomes(spark, d)).select("run_id", "brand_key", "failed", "distinct_errors", joined("errors", "errors"))


@query("e07_outcomes_wide", f"""WITH {BRANDED}
SELECT o.ord, o.run_id, o.brand_key, o.engine, o.intent, o.weight, o.prompt_text, o.status, o.mentioned AS brand_mentioned,
  CASE WHEN o.rank > 0 THEN CAST(o.rank AS VARCHAR) ELSE '' END AS brand_rank, o.sentiment AS brand_sentiment, o.own_cited,
  b.mentioned AS mentioned_beta, g.mentioned AS mentioned_gamma, o.cites AS citations
FROM o JOIN men b ON b.ord = o.ord AND b.entity_ord = 1 JOIN men g ON g.ord = o.ord AND g.entity_ord = 2""")
def e07(spark, d):
    # an unparseable citation with spaces was split by the bridge; joining restores the text
    return M.outcomes_wide(outcomes(spark, d), ["Beta", "Gamma"])


@query("f01_summarise", f"""WITH {BRANDED}
SELECT run_id, brand_key, count(*) AS prompts_run, count(*) FILTER (WHERE status = 'answered') AS prompts_answered,
  count(*) FILTER (WHERE status <> 'answered') AS prompts_failed,
  {R3.format("sum(score * weight) FILTER (WHERE status = 'answered') / sum(weight) FILTER (WHERE status = 'answered')")} AS score,
  count(*) FILTER (WHERE mentioned) AS mentions,
  {R3.format("count(*) FILTER (WHERE mentioned) / count(*) FILTER (WHERE status = 'answered')")} AS mention_rate,
  {R3.format("count(*) FILTER (WHERE role = 'recommended') / count(*) FILTER (WHERE status = 'answered')")} AS recommendation_rate,
  {R3.format("count(*) FILTER (WHERE own_cited AND status = 'answered') / count(*) FILTER (WHERE status = 'answered')")} AS citation_rate,
  count(*) FILTER (WHERE role = 'dismissed') AS dismissed_count,
  count(*) FILTER (WHERE mentioned AND role = 'recommended') AS role_recommended, count(*) FILTER (WHERE mentioned AND role = 'listed') AS role_listed,
  count(*) FILTER (WHERE mentioned AND role = 'referenced') AS role_referenced, count(*) FILTER (WHERE mentioned AND role = 'dismissed') AS role_dismissed,
  {R3.format("count(*) FILTER (WHERE role = 'recommended') / count(*) FILTER (WHERE mentioned)")} AS influence_ratio,
  {R2.format("avg(rank) FILTER (WHERE rank > 0)")} AS avg_rank, {R2.format("avg(sentiment) FILTER (WHERE mentioned)")} AS avg_sentiment
FROM o GROUP BY ALL""")
def f01(spark, d):
    return M.summarise(outcomes(spark, d)).drop("margin_of_error")


@query("f02_margin_of_error", f"""WITH {BRANDED}, r AS (SELECT run_id, engine, count(*) AS n, avg(mentioned::INT) AS p FROM a GROUP BY ALL)
SELECT run_id, engine, n, {R3.format("1.96 * sqrt(p * (1 - p) / n)")} AS margin FROM r""")
def f02(spark, d):
    from answerscope.functions.core import round_half_up
    g = M.answered(outcomes(spark, d)).groupBy("run_id", "engine").agg(
        F.count("*").alias("n"), F.avg(F.col("brand.mentioned").cast("int")).alias("p"))
    return g.select("run_id", "engine", "n", round_half_up(M.margin_of_error(F.col("p"), F.col("n"))).alias("margin"))


@query("f03_share_of_voice", f"""WITH c AS (SELECT run_id, brand_key, entity_ord, name, is_brand, count(*) FILTER (WHERE mentioned) AS count FROM v_mentions GROUP BY ALL)
SELECT *, {R3.format("count / sum(count) OVER (PARTITION BY run_id, brand_key)")} AS share FROM c""")
def f03(spark, d):
    return M.share_of_voice(outcomes(spark, d), outcome_entities(spark, d))


_BY = "count(*) AS total, count(*) FILTER (WHERE mentioned) AS mentions, {} AS score, {} AS rate".format(
    R3.format("sum(score) / count(*)"), R3.format("count(*) FILTER (WHERE mentioned) / count(*)"))


@query("f04_by_intent", f"""WITH {BRANDED} SELECT run_id, brand_key, intent, {_BY},
 CASE intent WHEN 'commercial_investigation' THEN 'Commercial investigation' WHEN 'comparison' THEN 'Head-to-head comparison' WHEN 'alternative' THEN 'Alternatives'
  WHEN 'local' THEN 'Local intent' WHEN 'pricing' THEN 'Pricing' WHEN 'problem' THEN 'Problem / job-to-be-done' ELSE 'Branded lookup' END AS label, min(ord) AS first_ord
FROM a GROUP BY run_id, brand_key, intent""")
def f04(spark, d):
    return M.by_intent(outcomes(spark, d))


@query("f05_by_language", f"""WITH {BRANDED}, l AS (SELECT run_id, brand_key, lang, {_BY}, count(*) FILTER (WHERE role = 'recommended') AS recommended, min(ord) AS first_ord
FROM a GROUP BY run_id, brand_key, lang)
SELECT * FROM l WHERE run_id IN (SELECT run_id FROM l GROUP BY run_id HAVING count(*) > 1)""")
def f05(spark, d):
    return M.by_language(outcomes(spark, d))


@query("f06_by_engine", f"""WITH {BRANDED} SELECT run_id, brand_key, engine, {_BY}, count(*) FILTER (WHERE own_cited) AS cited, min(ord) AS first_ord
FROM a GROUP BY run_id, brand_key, engine""")
def f06(spark, d):
    return M.by_engine(outcomes(spark, d))


@query("f04_06_breakdowns", f"""WITH {BRANDED}
SELECT run_id, brand_key, 'intent' AS dimension, intent AS member, {_BY} FROM a GROUP BY run_id, brand_key, intent
UNION ALL SELECT run_id, brand_key, 'lang', lang, {_BY} FROM a GROUP BY run_id, brand_key, lang
UNION ALL SELECT run_id, brand_key, 'engine', engine, {_BY} FROM a GROUP BY run_id, brand_key, engine""")
def f0406(spark, d):
    return M.breakdowns(outcomes(spark, d))


@query("f07_prompt_stability", f"""WITH {BRANDED}
SELECT run_id, brand_key, engine, prompt_id, count(*) AS asked, count(*) FILTER (WHERE mentioned) AS named, min(ord) AS first_ord,
 {R3.format("count(*) FILTER (WHERE mentioned) / count(*)")} AS rate,
 CASE WHEN count(*) FILTER (WHERE mentioned) = 0 THEN 'absent' WHEN count(*) FILTER (WHERE NOT mentioned) = 0 THEN 'locked' ELSE 'contested' END AS stability
FROM a GROUP BY ALL""")
def f07(spark, d):
    return M.prompt_stability(outcomes(spark, d), samples=5)


@query("f07_contested_count", f"""WITH {BRANDED}, s AS (SELECT run_id, brand_key, engine, prompt_id, avg(mentioned::INT) AS x FROM a GROUP BY ALL)
SELECT run_id, brand_key, count(*) FILTER (WHERE x > 0 AND x < 1) AS contested FROM s GROUP BY run_id, brand_key""")
def f07c(spark, d):
    return M.contested_count(M.prompt_stability(outcomes(spark, d), samples=5))


GAPS_SQL = f"""{BRANDED}, lostrows AS (SELECT a.*, m.name, m.rank AS mrank FROM a JOIN men m ON m.ord = a.ord AND m.entity_ord > 0 AND m.mentioned WHERE NOT a.mentioned),
 w AS (SELECT run_id, brand_key, engine, prompt_id, name, min(ord * 10 + mrank) AS f FROM lostrows GROUP BY ALL),
 wl AS (SELECT run_id, brand_key, engine, prompt_id, string_agg(name, '|' ORDER BY f) AS winners FROM w GROUP BY ALL),
 q AS (SELECT run_id, brand_key, engine, prompt_id, min(prompt_text) AS prompt_text, min(intent) AS intent, min(weight) AS weight, count(*) AS asked, min(ord) AS first_ord FROM a GROUP BY ALL),
 l AS (SELECT run_id, brand_key, engine, prompt_id, count(DISTINCT ord) AS lost FROM lostrows GROUP BY ALL),
 gaps AS (SELECT q.run_id, q.brand_key, q.engine, q.prompt_id, prompt_text, intent, weight, asked, lost, {R3.format("lost / asked")} AS loss_rate, winners,
  weight * {R3.format("lost / asked")} AS sort_key, first_ord
  FROM q JOIN l USING (run_id, brand_key, engine, prompt_id) JOIN wl USING (run_id, brand_key, engine, prompt_id))"""


@query("f08_find_gaps", f"WITH {GAPS_SQL} SELECT * FROM gaps")
def f08(spark, d):
    return M.find_gaps(outcomes(spark, d)).withColumn("winners", F.array_join("winners", "|"))


@query("f09_find_wins", f"""WITH {BRANDED}, w AS (SELECT * FROM a WHERE mentioned AND rank = 1)
SELECT run_id, brand_key, engine, prompt_id, min(prompt_text) AS prompt_text, min(intent) AS intent, count(*) AS won, bool_or(own_cited) AS cited, min(ord) AS first_ord,
 list_reduce(list(sentiment ORDER BY ord), lambda s, x: (s + x) / 2) AS sentiment FROM w GROUP BY ALL""")
def f09(spark, d):
    return M.find_wins(outcomes(spark, d))


CREDITS = """cred AS (SELECT run_id, brand_key, ord, h AS host, min(i) AS pos FROM (SELECT run_id, brand_key, ord, unnest(c) AS u, generate_subscripts(c, 1) AS i FROM
   (SELECT *, string_split(cites, ' ') AS c FROM v_outcomes WHERE status = 'answered') z) y,
   LATERAL (SELECT regexp_replace(lower(regexp_extract(u, '^https?://([^/?#]*)', 1)), '^www[.]', '') AS h) x WHERE h <> '' GROUP BY ALL),
 hc AS (SELECT run_id, brand_key, host, count(*) AS count, min(ord * 100 + pos) AS first_seen FROM cred GROUP BY ALL)"""


@query("f10_citation_domains", f"""WITH {CREDITS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, brand_key ORDER BY count DESC, first_seen) AS pos FROM hc)
SELECT run_id, brand_key, pos, host AS domain, count, host = 'own.example' AS is_own, host = 'rival.example' AS is_competitor FROM r WHERE pos <= 25""", ints="pos")
def f10(spark, d):
    return M.citation_domains(outcomes(spark, d), outcome_entities(spark, d))


@query("f11_distinct_counts", f"""WITH {CREDITS}
SELECT o.run_id, o.brand_key, count(DISTINCT error) AS distinct_errors, (SELECT count(*) FROM hc WHERE hc.run_id = o.run_id) AS unique_domains FROM v_outcomes o GROUP BY o.run_id, o.brand_key""")
def f11(spark, d):
    return M.distinct_counts(outcomes(spark, d))


@query("f11_distinct_sketches", f"""WITH {CREDITS}, h AS (SELECT brand_key, count(DISTINCT host) AS unique_domains FROM hc GROUP BY brand_key),
 e AS (SELECT brand_key, count(DISTINCT error) FILTER (WHERE status <> 'answered') AS distinct_errors FROM v_outcomes GROUP BY brand_key)
SELECT brand_key, coalesce(unique_domains, 0) AS unique_domains, distinct_errors, true AS within FROM e LEFT JOIN h USING (brand_key)""")
def f11_sketches(spark, d):
    """Distinct hosts and errors per brand over all its runs, exactly and from the runs' stored sketches: within five standard errors."""
    from answerscope.session import materialise
    rows = outcomes(spark, d)
    stored = materialise(M.distinct_sketches(rows))
    told = M.distinct_estimates(stored, ["brand_key"]).select("brand_key", F.col("unique_domains").alias("hosts"), F.col("distinct_errors").alias("errors"))
    exact = rows.groupBy("brand_key").agg(F.count_distinct(F.when(F.col("status") != "answered", F.col("error"))).alias("distinct_errors"))
    hosts = M.citation_credits(rows).groupBy("brand_key").agg(F.count_distinct("host").alias("unique_domains"))
    both = exact.join(hosts, "brand_key", "left").withColumn("unique_domains", F.coalesce("unique_domains", F.lit(0))).join(told, "brand_key")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 5 * 1.04 / 64 * F.col(b)
    return both.select("brand_key", "unique_domains", "distinct_errors", (near("hosts", "unique_domains") & near("errors", "distinct_errors")).alias("within"))


_SURFACE = """CASE WHEN host = 'own.example' THEN 'owned' WHEN host = 'rival.example' THEN 'competitor'
  WHEN regexp_matches(host, '(^|\\.)(reddit|ycombinator|stackoverflow|stackexchange|quora|substack)\\.com$|(^|\\.)discourse\\.|forum') THEN 'community'
  WHEN regexp_matches(host, '(^|\\.)(g2|capterra|trustpilot|trustradius|angi|houzz|getapp|softwareadvice)\\.com$|(^|\\.)(yelp|tripadvisor|glassdoor)\\.[a-z.]+$|(^|\\.)bbb\\.org$|(^|\\.)clutch\\.co$') THEN 'review'
  WHEN regexp_matches(host, '(^|\\.)wiki(pedia|data)\\.org$|\\.(gov|edu)$|\\.(gov|edu)\\.|(^|\\.)(britannica|crunchbase)\\.com$') THEN 'reference'
  WHEN regexp_matches(host, '(^|\\.)(linkedin|x|twitter|facebook|instagram|youtube|tiktok)\\.com$|(^|\\.)threads\\.net$') THEN 'social'
  WHEN regexp_matches(host, '(^|\\.)amazon\\.[a-z.]+$|(^|\\.)(etsy|producthunt|apps\\.apple|play\\.google|github)\\.com$') THEN 'marketplace'
  WHEN regexp_matches(host, '(^|\\.)(medium|forbes|techcrunch|theverge|wired|nytimes|zdnet|cnet)\\.com$|news|magazine|(^|\\.)bbc\\.[a-z.]+$|(^|\\.)guardian\\.') THEN 'editorial'
  ELSE 'other' END""".replace("\\\\", "\\")
SURF = f"{CREDITS}, s AS (SELECT *, {_SURFACE} AS surface FROM hc)"


def hosts(spark, d):
    return G.classified_hosts(outcomes(spark, d), outcome_entities(spark, d))


@query("g01_classify_host", f"""WITH {SURF}, p AS (SELECT DISTINCT {{h}} AS host FROM pages)
SELECT host, {_SURFACE} AS surface FROM (SELECT host FROM p UNION SELECT host FROM hc) u""".replace(
    "{h}", "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www[.]', '')"))
def g01(spark, d):
    from answerscope.functions.urls import host_of
    every = table(spark, d, "pages").select(host_of("url").alias("host")).union(
        M.host_counts(outcomes(spark, d)).select("host")).distinct()
    return every.select("host", G.classify(
        F.col("host"), F.col("host") == "own.example", F.col("host") == "rival.example").alias("surface"))


@query("g02_surface_summary", f"""WITH {SURF} SELECT run_id, brand_key, sum(count) AS total_citations, count(*) AS unique_domains,
 {R3.format("sum(count) FILTER (WHERE surface = 'owned') / sum(count)")} AS owned_share, {R3.format("sum(count) FILTER (WHERE surface <> 'owned') / sum(count)")} AS off_site_share FROM s GROUP BY ALL""", longs="total_citations")
def g02(spark, d):
    return G.surface_summary(hosts(spark, d))


@query("g02_surface_breakdown", f"""WITH {SURF}, b AS (SELECT run_id, brand_key, surface, sum(count) AS count FROM s GROUP BY ALL)
SELECT *, {R3.format("count / sum(count) OVER (PARTITION BY run_id, brand_key)")} AS share FROM b""", longs="count")
def g02b(spark, d):
    return G.surface_breakdown(hosts(spark, d)).drop("first_cited")


@query("g02_surface_rollup", f"""WITH {SURF} SELECT run_id, brand_key, NULL AS surface, NULL AS host, sum(count) AS count, 2 AS level FROM s GROUP BY ALL
UNION ALL SELECT run_id, brand_key, surface, NULL, sum(count), 1 FROM s GROUP BY ALL UNION ALL SELECT run_id, brand_key, surface, host, count, 0 FROM s""", longs="count")
def g02c(spark, d):
    return G.surface_rollup(hosts(spark, d))


@query("g02_top_domains", f"""WITH {SURF}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, brand_key ORDER BY count DESC, first_seen) AS pos FROM s)
SELECT run_id, brand_key, pos, host, count, surface FROM r WHERE pos <= 25""", ints="pos")
def g02d(spark, d):
    return G.top_domains(hosts(spark, d)).drop("first_cited")


@query("g03_outreach_targets", f"""WITH {SURF}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, brand_key ORDER BY count DESC, first_seen) AS pos FROM s WHERE surface NOT IN ('owned', 'competitor'))
SELECT run_id, brand_key, pos, host, count, surface, CASE surface WHEN 'community' THEN 'Communities' WHEN 'review' THEN 'Reviews and directories'
 WHEN 'editorial' THEN 'Press and editorial' WHEN 'reference' THEN 'Reference works' WHEN 'social' THEN 'Social networks' WHEN 'marketplace' THEN 'Marketplaces' ELSE 'Unclassified' END AS label
FROM r WHERE pos <= 12""", ints="pos")
def g03(spark, d):
    return G.outreach_targets(hosts(spark, d)).drop("first_cited")
