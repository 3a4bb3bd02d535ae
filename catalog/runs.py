"""A9-A11, J, K, L: stored runs, fixes, history, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerscope.functions.core import round_half_up
from answerscope.operators import history as K
from answerscope.operators import metrics as M
from answerscope.operators import readiness as I
from answerscope.operators import recommend as J
from answerscope.operators import retention as L
from answerscope.session import materialise, scratch_folder
from answerscope.sources import runs as S
from catalog.base import outcome_entities, outcomes, query, sites, view
from catalog.metrics import BRANDED, CREDITS, GAPS_SQL
from catalog.sites import ALL_CHECKS, ASSESS, all_checks

CUT = "2024-01-31 00:00:00"


def runs(spark, d):
    return view(spark, d, "v_runs")


# --- A: store and exports --------------------------------------------------------------------

_INCOMING = """inc AS (SELECT run_id, brand_key, created_at, composite + 1 AS composite, event_id FROM v_runs WHERE event_id % 10 = 3
  UNION ALL SELECT 'new' || run_id, brand_key, created_at, composite, event_id FROM v_runs WHERE event_id % 10 = 4)"""


@query("a09_save_run", f"""WITH {_INCOMING} SELECT run_id, brand_key, created_at, composite, event_id FROM v_runs WHERE event_id % 10 <> 3 UNION ALL SELECT * FROM inc""")
def a09(spark, d):
    stored = runs(spark, d).select("run_id", "brand_key", "created_at", "composite", "event_id")
    again = stored.where("event_id % 10 = 3")
    versions = again.withColumn("write_ts", F.lit(1)).unionByName(
        again.withColumn("composite", F.col("composite") + 1).withColumn("write_ts", F.lit(2)))
    fresh = stored.where("event_id % 10 = 4").withColumn("run_id", F.concat(F.lit("new"), "run_id"))
    incoming = S.newest_version(versions, ["run_id", "brand_key"]).drop("write_ts").unionByName(fresh)
    folder = scratch_folder(spark, "runs")
    S.upsert_runs(stored, folder, ["run_id", "brand_key"], version=1)
    S.upsert_runs(incoming, folder, ["run_id", "brand_key"], version=2)
    return S.read_runs(spark, folder).select(*stored.columns)


def _round_trip(df, name, write, read):
    folder = scratch_folder(df.sparkSession, name)
    write(df, folder)
    return read(folder)


@query("a10_csv_outcomes", f"""WITH {BRANDED} SELECT o.ord, o.prompt_text || ', "x"' AS prompt_text, o.status, CASE WHEN o.rank > 0 THEN o.rank::VARCHAR END AS brand_rank, nullif(o.cites, '') AS citations,
 b.mentioned::VARCHAR AS mentioned_beta FROM o JOIN men b ON b.ord = o.ord AND b.entity_ord = 1""")
def a10(spark, d):
    wide = M.outcomes_wide(outcomes(spark, d), ["Beta", "Gamma"]).withColumn(
        "prompt_text", F.concat("prompt_text", F.lit(', "x"')))
    back = _round_trip(wide, "outcomes_csv", S.write_csv, lambda p: spark.read.option("header", True).option(
        "quote", '"').option("escape", '"').csv(p))
    return back.select(F.col("ord").cast("long").alias("ord"), "prompt_text", "status", "brand_rank", "citations", "mentioned_beta")


@query("a11_json_runs", "SELECT run_id, brand_key, composite, blocked FROM v_runs")
def a11(spark, d):
    return _round_trip(
        runs(spark, d).select("run_id", "brand_key", "composite", "blocked"), "runs_json", S.write_json,
        lambda p: spark.read.schema("run_id string, brand_key string, composite double, blocked boolean").json(p))


# --- J: fixes; every audited host is a run ------------------------------------------------------


def checks(spark, d):
    """26 rows per host, read several times by the fix rules: computed once."""
    return materialise(all_checks(spark, d)).withColumnRenamed("host", "run_id")


def vis(spark, d):
    return view(spark, d, "v_vis")


TRIG = f"""{ALL_CHECKS}, tr AS (SELECT host AS run_id, fix_id, min(score) AS score, arg_min(check_id, score * 1000000 + check_ord) AS check_id, min(check_ord) AS first_ord FROM chk WHERE fix_id IS NOT NULL GROUP BY host, fix_id)"""
# fixed values, stated apart from the library's: rule, pillar, impact, effort
EXPECTED_RULES = [
    ("unblock-ai-crawlers", "technical", 5, 1),
    ("ship-robots-txt", "technical", 3, 1),
    ("publish-llms-txt", "technical", 3, 1),
    ("ship-sitemap", "technical", 3, 2),
    ("enable-https", "technical", 5, 2),
    ("server-render-content", "technical", 5, 4),
    ("speed-up-origin", "technical", 2, 3),
    ("add-canonical", "technical", 2, 1),
    ("add-jsonld", "structure", 4, 2),
    ("add-entity-schema", "structure", 4, 2),
    ("add-faq-schema", "structure", 4, 2),
    ("add-offer-schema", "structure", 3, 2),
    ("fix-headings", "structure", 3, 2),
    ("question-headings", "structure", 4, 2),
    ("semantic-landmarks", "structure", 2, 1),
    ("write-meta-descriptions", "structure", 2, 2),
    ("write-answer-capsules", "content", 5, 2),
    ("build-comparison-pages", "content", 5, 3),
    ("add-faq-content", "content", 4, 2),
    ("deepen-content", "content", 3, 3),
    ("add-quotable-stats", "content", 4, 2),
    ("add-freshness-signals", "content", 3, 1),
    ("clarify-entity", "content", 4, 1),
    ("build-third-party-presence", "authority", 5, 4),
    ("publish-nap", "authority", 3, 1),
    ("add-authorship", "authority", 2, 2),
]
RULES = "rl(rule_id, pillar, impact, effort) AS (VALUES {})".format(", ".join(
    f"('{a}', '{b}', {c}, {e})" for a, b, c, e in EXPECTED_RULES))
SEV = "CASE WHEN score < 0.25 AND impact >= 4 THEN 'critical' WHEN score < 0.5 AND impact >= 3 THEN 'high' WHEN score < 0.75 THEN 'medium' ELSE 'low' END"
PRIO = "floor((2 * impact + 1.5 * CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) / sqrt(effort) * 100 + 0.5) / 100"
BUCKET = "CASE WHEN severity = 'critical' OR (effort <= 2 AND impact >= 4) THEN 'now' WHEN effort <= 3 THEN 'next' ELSE 'later' END"


@query("j01_trigger_fixes", f"WITH {TRIG} SELECT * FROM tr")
def j01(spark, d):
    return J.triggered_fixes(checks(spark, d)).withColumn("score", F.round("score", 9))


@query("j02_j03_rules_severity", f"WITH {TRIG}, {RULES} SELECT run_id, fix_id, pillar, impact, effort, {SEV} AS severity FROM tr JOIN rl ON rule_id = fix_id")
def j02(spark, d):
    t = J.triggered_fixes(checks(spark, d))
    return J.join_rules(t).select("run_id", "fix_id", "pillar", "impact", "effort", "severity")


MEASURED = """mr AS (SELECT run_id, 'build-comparison-pages' AS fix_id, 1 - gap_count / prompts_answered AS score, 100 AS first_ord FROM v_vis WHERE prompts_answered > 0 AND gap_count / prompts_answered > 0.3
   UNION ALL SELECT run_id, 'build-third-party-presence', citation_rate, 101 FROM v_vis WHERE prompts_answered > 0 AND citation_rate < 0.15),
 mt AS (SELECT * FROM mr WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.run_id = mr.run_id AND tr.fix_id = mr.fix_id)),
 mm AS (SELECT run_id, 'convert-mentions-to-recommendations' AS rec_id, 'high' AS severity, 4 AS impact, 3 AS effort, 'content' AS pillar, influence_ratio AS evidence, 102 AS ord FROM v_vis WHERE prompts_answered > 0 AND mention_rate >= 0.3 AND influence_ratio < 0.35
   UNION ALL SELECT run_id, 'address-dismissals', 'critical', 5, 3, 'authority', dismissed_count, 103 FROM v_vis WHERE prompts_answered > 0 AND dismissed_count > 0
   UNION ALL SELECT run_id, 'work-the-off-site-surfaces', 'high', 5, 4, 'authority', off_site_share, 104 FROM v_vis WHERE prompts_answered > 0 AND total_citations >= 4 AND off_site_share >= 0.7
   UNION ALL SELECT run_id, 'branded-recall-alert', 'critical', 5, 3, 'authority', branded_rate, 105 FROM v_vis WHERE prompts_answered > 0 AND branded_rate < 0.8
   UNION ALL SELECT host, CASE WHEN robots_blocked THEN 'robots-disallows-crawling' ELSE 'crawl-blocked' END, 'critical', 5, CASE WHEN robots_blocked THEN 1 ELSE 2 END, 'technical', 1, -1 FROM v_sites WHERE NOT reachable OR robots_blocked)"""


def blocks(spark, d):
    return sites(spark, d).select(
        F.col("host").alias("run_id"), (~F.col("reachable") | F.col("robots_blocked")).alias("blocked"), "robots_blocked")


@query("j04_measured_rules", f"WITH {TRIG}, {MEASURED} SELECT run_id, rec_id, severity, impact, effort, pillar, evidence, ord FROM mm UNION ALL SELECT run_id, fix_id, '', 0, 0, '', score, first_ord FROM mt")
def j04(spark, d):
    t = J.triggered_fixes(checks(spark, d))
    extra = J.measured_triggers(vis(spark, d), t).select(
        "run_id", F.col("fix_id").alias("rec_id"), F.lit("").alias("severity"), F.lit(0).alias("impact"),
        F.lit(0).alias("effort"), F.lit("").alias("pillar"), F.col("score").alias("evidence"), F.col("first_ord").alias("ord"))
    return J.measured_rules(blocks(spark, d), vis(spark, d)).unionByName(extra)


RECS = f"""{TRIG}, {RULES}, {MEASURED}, br AS (SELECT run_id, fix_id AS rec_id, {SEV} AS severity, impact, effort, pillar, score AS evidence, first_ord AS ord
   FROM (SELECT run_id, fix_id, score, first_ord FROM tr UNION ALL SELECT * FROM mt) t JOIN rl ON rule_id = fix_id),
 rec AS (SELECT *, {PRIO} AS priority, {BUCKET} AS bucket FROM (SELECT * FROM br UNION ALL SELECT * FROM mm) z)"""


def recs(spark, d, rows=None):
    return J.recommend(checks(spark, d) if rows is None else rows, blocks(spark, d), vis(spark, d))


@query("j05_priority", f"WITH {RECS} SELECT run_id, rec_id, severity, impact, effort, pillar, round(evidence, 6) AS evidence, priority FROM rec")
def j05(spark, d):
    return J.in_order(recs(spark, d)).select(
        "run_id", "rec_id", "severity", "impact", "effort", "pillar", F.round("evidence", 6).alias("evidence"), "priority")


@query("j06_roadmap", f"WITH {RECS} SELECT run_id, bucket, count(*) AS n, max(priority) AS top FROM rec GROUP BY ALL")
def j06(spark, d):
    return recs(spark, d).groupBy("run_id", "bucket").agg(F.count("*").alias("n"), F.max("priority").alias("top"))


_HITS = [
    ("crawl_blocked", "blocked", "1", "''"),
    ("critical_crawlers_blocked", "blocked_critical > 0", "blocked_critical", "''"),
    ("leads_share", "visibility_run AND leader_is_brand", "brand_share", "''"),
    ("behind_leader", "visibility_run AND NOT leader_is_brand", "brand_share", "''"),
    ("gaps", "visibility_run AND gap_count > 0", "gap_count", "''"),
    ("dismissals", "visibility_run AND dismissed_count > 0", "dismissed_count", "''"),
    ("low_influence", "visibility_run AND dismissed_count = 0 AND mention_rate >= 0.3 AND influence_ratio < 0.35", "influence_ratio", "''"),
    ("off_site", "visibility_run AND total_citations >= 4 AND off_site_share >= 0.7", "off_site_share", "''"),
    ("rarely_cited", "visibility_run AND citation_rate < 0.2", "citation_rate", "''"),
    ("weakest_pillar", "NOT blocked AND overall IS NOT NULL", "least(technical, structure, content, authority)",
     "CASE least(technical, structure, content, authority) WHEN technical THEN 'technical' WHEN structure THEN 'structure' WHEN content THEN 'content' ELSE 'authority' END"),
    ("critical_fixes", "true", "critical_recs", "''"),
]


@query("j07_summary_points", f"""WITH {RECS}, {ASSESS.replace(ALL_CHECKS + ',', '')}, cr AS (SELECT run_id, count(*) FILTER (WHERE severity = 'critical') AS critical_recs FROM rec GROUP BY run_id),
 f AS (SELECT v.*, a.blocked, a.overall, a.technical, a.structure, a.content, a.authority, v.gap_count % 4 AS blocked_critical, coalesce(critical_recs, 0) AS critical_recs FROM v_vis v JOIN asmt a ON a.host = v.run_id LEFT JOIN cr ON cr.run_id = v.run_id),
 hit AS ({" UNION ALL ".join(f"SELECT run_id, {i} AS o, '{c}' AS code, ({v})::DOUBLE AS value, {x} AS detail FROM f WHERE {w}" for i, (c, w, v, x) in enumerate(_HITS))}),
 r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY o) - 1 AS pos FROM hit)
SELECT run_id, pos, code, round(value, 6) AS value, detail FROM r WHERE pos < 6""", ints="pos")
def j07(spark, d):
    rows = checks(spark, d)
    ready = I.assess_readiness(sites(spark, d), rows.withColumnRenamed("run_id", "host")).select(
        F.col("host").alias("run_id"), "blocked", "technical", "structure", "content", "authority")
    critical = recs(spark, d, rows).groupBy("run_id").agg(F.count_if(F.col("severity") == "critical").alias("critical_recs"))
    facts = vis(spark, d).join(ready, "run_id").join(critical, "run_id", "left").withColumns({
        "critical_recs": F.coalesce("critical_recs", F.lit(0)), "blocked_critical": F.col("gap_count") % 4})
    return J.summary_points(facts).withColumn("value", F.round("value", 6))


@query("j08_top_gaps", f"""WITH {GAPS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, brand_key ORDER BY sort_key DESC, first_ord) AS pos FROM gaps) SELECT run_id, engine, prompt_id, lost, asked, winners, pos FROM r WHERE pos <= 15""", ints="pos")
def j08(spark, d):
    g = J.top_k(M.find_gaps(outcomes(spark, d)), ["run_id", "brand_key"], [F.col("sort_key").desc(), F.col("first_ord")], 15)
    return g.select("run_id", "engine", "prompt_id", "lost", "asked", F.array_join("winners", "|").alias("winners"), "pos")


@query("j08_contested", f"""WITH {BRANDED}, s AS (SELECT run_id, engine, prompt_id, avg(mentioned::INT) AS x, min(ord) AS o FROM a GROUP BY ALL),
 r AS (SELECT *, floor(x * 1000 + 0.5) / 1000 AS rate, row_number() OVER (PARTITION BY run_id ORDER BY floor(x * 1000 + 0.5) / 1000, o) AS pos FROM s WHERE x > 0 AND x < 1) SELECT run_id, engine, prompt_id, rate, pos FROM r WHERE pos <= 15""", ints="pos")
def j08b(spark, d):
    s = M.prompt_stability(outcomes(spark, d)).where("stability = 'contested'")
    return J.top_k(s, ["run_id", "brand_key"], [F.col("rate"), F.col("first_ord")], 15).select("run_id", "engine", "prompt_id", "rate", "pos")


@query("j08_outside_domains", f"""WITH {CREDITS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY count DESC, first_seen) AS p FROM hc),
 q AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY p) AS pos FROM r WHERE p <= 25 AND host <> 'own.example') SELECT run_id, host AS domain, count, pos FROM q WHERE pos <= 6""", ints="pos")
def j08c(spark, d):
    dom = M.citation_domains(outcomes(spark, d), outcome_entities(spark, d)).where("NOT is_own").withColumnRenamed("pos", "rank_in_run")
    return J.top_k(dom, ["run_id", "brand_key"], [F.col("rank_in_run")], 6).select("run_id", "domain", "count", "pos")


@query("j08_checks_by_pillar", f"""WITH {ALL_CHECKS} SELECT host AS run_id, pillar, check_id, row_number() OVER (PARTITION BY host, pillar ORDER BY score, check_ord) AS pos FROM chk""", ints="pos")
def j08d(spark, d):
    # at nine decimals, so that 1 - 2/3 and 1/3 tie in both engines
    rows = checks(spark, d).withColumn("score", F.round("score", 9))
    return J.top_k(rows, ["run_id", "pillar"], [F.col("score"), F.col("check_ord")], 26).select(
        "run_id", "pillar", "check_id", "pos")


@query("a10_csv_checks", f"""WITH {ALL_CHECKS} SELECT host AS run_id, pillar, check_id, status, round(score, 6) AS score, weight, fix_id FROM chk""")
def a10_checks(spark, d):
    back = _round_trip(checks(spark, d), "checks_csv", S.write_csv, lambda p: spark.read.option("header", True).option(
        "escape", '"').schema("run_id string, check_ord int, check_id string, pillar string, weight int, score double, status string, fix_id string").csv(p))
    return back.select("run_id", "pillar", "check_id", "status", F.round("score", 6).alias("score"), "weight", "fix_id")


@query("a10_csv_recommendations", f"""WITH {RECS} SELECT run_id, rec_id, severity, impact, effort, pillar, priority FROM rec""")
def a10_recs(spark, d):
    cols = recs(spark, d).select("run_id", "rec_id", "severity", "impact", "effort", "pillar", "priority")
    return _round_trip(cols, "recommendations_csv", S.write_csv, lambda p: spark.read.option("header", True).option(
        "escape", '"').schema(cols.schema).csv(p))


# --- K: history ----------------------------------------------------------------------------------

_COMP = "CASE WHEN readiness IS NOT NULL AND visibility IS NOT NULL THEN floor((readiness * 0.55::DOUBLE + visibility * 0.45::DOUBLE) * 1000 + 0.5) / 1000 ELSE coalesce(readiness, visibility) END"


@query("k01_composite", f"""WITH c AS (SELECT run_id, readiness, visibility, {_COMP} AS composite FROM v_runs)
SELECT run_id, composite, CASE WHEN composite IS NULL THEN 'N/A' WHEN composite >= .85 THEN 'A' WHEN composite >= .7 THEN 'B' WHEN composite >= .55 THEN 'C' WHEN composite >= .4 THEN 'D' ELSE 'F' END AS grade,
 readiness IS NULL OR visibility IS NULL AS partial FROM c""")
def k01(spark, d):
    return K.roll_up(runs(spark, d).drop("composite")).select("run_id", "composite", "grade", "partial")


_REC_IDS = "list_distinct(['fix' || event_id % 5, 'fix' || event_id % 7, 'rule' || event_id % 3])"


@query("k02_compute_delta", f"""WITH r AS (SELECT *, {_REC_IDS} AS recs FROM v_runs), p AS (SELECT *, lag(run_id) OVER w AS previous_id, (lag(created_at) OVER w)::VARCHAR AS previous_at, lag(composite) OVER w AS pc, lag(readiness) OVER w AS pr, lag(visibility) OVER w AS pv, lag(mention_rate) OVER w AS pm, lag(recs) OVER w AS precs FROM r WINDOW w AS (PARTITION BY brand_key ORDER BY created_at, run_id))
SELECT run_id, previous_id, previous_at, {", ".join(f"floor((coalesce({a}, 0) - coalesce({b}, 0)) * 1000 + 0.5) / 1000 AS {n}" for a, b, n in [("composite", "pc", "composite"), ("readiness", "pr", "readiness"), ("visibility", "pv", "visibility"), ("mention_rate", "pm", "mention_rate")])},
 array_to_string(list_sort(list_filter(precs, lambda x: NOT list_contains(recs, x))), '|') AS resolved, array_to_string(list_sort(list_filter(recs, lambda x: NOT list_contains(precs, x))), '|') AS introduced FROM p WHERE previous_id IS NOT NULL""")
def k02(spark, d):
    e = F.col("event_id")
    ids = F.array_distinct(F.array(
        F.concat(F.lit("fix"), (e % 5).cast("string")), F.concat(F.lit("fix"), (e % 7).cast("string")),
        F.concat(F.lit("rule"), (e % 3).cast("string"))))
    mine = ["composite", "readiness", "visibility", "mention_rate", "citation_rate", "brand_share", "recs"]
    r = runs(spark, d).withColumns({"recs": ids, "citation_rate": F.col("mention_rate"), "brand_share": F.col("visibility")})
    before = r.select(F.col("run_id").alias("previous_id"), *[F.col(m).alias(f"previous_{m}") for m in mine])
    pairs = K.lag_run(r).where("previous_id IS NOT NULL").join(before, "previous_id")
    return K.compute_delta(pairs).select(
        "run_id", "previous_id", F.col("previous_at").cast("string").alias("previous_at"), "composite", "readiness", "visibility", "mention_rate",
        F.array_join(F.array_sort("resolved"), "|").alias("resolved"), F.array_join(F.array_sort("introduced"), "|").alias("introduced"))


@query("k03_history", "SELECT brand_key, run_id, created_at::VARCHAR AS created_at, composite FROM v_runs WHERE brand_key = 'b7'")
def k03(spark, d):
    return K.history(runs(spark, d), "b7").select("brand_key", "run_id", F.col("created_at").cast("string").alias("created_at"), "composite")


@query("k04_brands_list", "SELECT brand_key, count(*) AS runs, arg_max(run_id, created_at) AS latest_id, max(created_at)::VARCHAR AS latest_at FROM v_runs GROUP BY brand_key")
def k04(spark, d):
    return K.brands_list(runs(spark, d)).select(
        "brand_key", "runs", F.col("latest.run_id").alias("latest_id"), F.col("latest.created_at").cast("string").alias("latest_at"))


@query("k05_previous_run", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY brand_key ORDER BY created_at DESC, run_id DESC) AS k FROM v_runs)
SELECT r.run_id, CASE WHEN r.k = 1 THEN s.run_id ELSE t.run_id END AS previous_id FROM r LEFT JOIN r t ON t.brand_key = r.brand_key AND t.k = 1 LEFT JOIN r s ON s.brand_key = r.brand_key AND s.k = 2""")
def k05(spark, d):
    return K.previous_run(runs(spark, d)).select("run_id", "previous_id")


@query("k05_lag_run", "SELECT run_id, lag(run_id) OVER w AS previous_id, (lag(created_at) OVER w)::VARCHAR AS previous_at FROM v_runs WINDOW w AS (PARTITION BY brand_key ORDER BY created_at, run_id)")
def k05b(spark, d):
    return K.lag_run(runs(spark, d)).select("run_id", "previous_id", F.col("previous_at").cast("string").alias("previous_at"))


@query("k05_as_of_run", """WITH q AS (SELECT event_id, 'b' || CAST(event_id % 97 AS VARCHAR) AS brand_key, ts + INTERVAL 6 HOUR AS as_of FROM events)
SELECT q.event_id, r.run_id FROM q ASOF LEFT JOIN (SELECT brand_key, created_at, run_id FROM v_runs) r ON q.brand_key = r.brand_key AND q.as_of >= r.created_at""")
def k05c(spark, d):
    dates = view(spark, d, "events").select(
        "event_id", F.concat(F.lit("b"), (F.col("event_id") % 97).cast("string")).alias("brand_key"),
        (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("as_of"))
    return K.as_of_run(dates, runs(spark, d)).select("event_id", "run_id")


@query("k06_trend", "SELECT brand_key, run_id, created_at::VARCHAR AS created_at, composite, readiness, visibility, mention_rate FROM v_runs")
def k06(spark, d):
    return K.trend(runs(spark, d)).withColumn("created_at", F.col("created_at").cast("string"))


_TREND = """tp AS (SELECT * FROM v_runs WHERE composite IS NOT NULL), ts_ AS (SELECT brand_key, count(*) AS points, min(composite) AS low, max(composite) AS high, arg_min(composite, created_at) AS first, arg_max(composite, created_at) AS last FROM tp GROUP BY brand_key)"""


@query("k07_trend_summary", f"WITH {_TREND} SELECT *, CASE WHEN points < 2 THEN 'one run' WHEN last >= first THEN 'up' ELSE 'down' END AS direction FROM ts_")
def k07(spark, d):
    return K.trend_summary(runs(spark, d))


@query("k07_trend_points", f"""WITH {_TREND}, n AS (SELECT brand_key, run_id, composite, row_number() OVER (PARTITION BY brand_key ORDER BY created_at, run_id) - 1 AS i FROM tp)
SELECT run_id, round(i / (points - 1), 9) AS x, round((composite - low) / CASE WHEN high = low THEN 1 ELSE high - low END, 9) AS y FROM n JOIN ts_ USING (brand_key) WHERE points >= 2""")
def k07b(spark, d):
    return K.trend_points(runs(spark, d)).select("run_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("k08_threshold_gate", "SELECT run_id, composite FROM v_runs WHERE composite < 0.5")
def k08(spark, d):
    return K.below_threshold(runs(spark, d)).select("run_id", "composite")


@query("k09_provenance", """WITH u AS (SELECT run_id, brand_key, string_agg(DISTINCT engine || run_id, '|' ORDER BY engine || run_id) AS engines, bool_and(run_id = 'r0' OR engine IN ('e0', 'e1')) AS simulated, count(DISTINCT prompt_id) AS prompt_count FROM v_outcomes GROUP BY ALL)
SELECT run_id, brand_key, engines, simulated, run_id = 'r1' AS partial, run_id = 'r2' AS crawl_blocked, prompt_count FROM u""")
def k09(spark, d):
    # each run has engines of its own: all of run r0's are offline, and some of the others'
    o = view(spark, d, "v_outcomes").withColumn("engine", F.concat("engine", "run_id"))
    engines = o.select("engine").distinct().withColumn("offline", F.col("engine").rlike("r0$|^e[01]"))
    one = F.lit(0.5)
    r = o.select("run_id", "brand_key").distinct().select(
        "run_id", "brand_key", F.when(F.col("run_id") != "r1", one).alias("readiness"), one.alias("visibility"),
        (F.col("run_id") == "r2").alias("blocked"))
    return K.provenance(o, engines, r).withColumn("engines", F.array_join("engines", "|"))


# --- L: retention -----------------------------------------------------------------------------------

def as_of():
    return F.lit(CUT).cast("timestamp")


@query("l01_purge_split", f"SELECT run_id, coalesce(created_at < TIMESTAMP '{CUT}' - INTERVAL 10 DAY, false) AS removed FROM v_runs")
def l01(spark, d):
    removed, kept = L.split_expired(runs(spark, d), as_of(), 10)
    return removed.select("run_id", F.lit(True).alias("removed")).unionByName(kept.select("run_id", F.lit(False).alias("removed")))


@query("l01_purge_report", f"""WITH g AS (SELECT brand_key, event_id % 50 > 0 AND created_at < TIMESTAMP '{CUT}' - INTERVAL 20 DAY AS gone FROM v_runs)
SELECT brand_key, count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE NOT gone) AS kept, bool_and(gone) AS brand_gone FROM g GROUP BY brand_key""")
def l01b(spark, d):
    undated = runs(spark, d).withColumn("created_at", F.when(F.col("event_id") % 50 > 0, F.col("created_at")))
    return L.purge_report(undated, as_of(), 20)


@query("l01_purge_details", f"""SELECT r.run_id, x.i AS check_ord FROM v_runs r CROSS JOIN (SELECT unnest([0, 1]) AS i) x WHERE NOT (r.created_at < TIMESTAMP '{CUT}' - INTERVAL 10 DAY)""")
def l01c(spark, d):
    r = runs(spark, d)
    details = r.select("run_id", "brand_key", F.explode(F.array(F.lit(0), F.lit(1))).alias("check_ord"))
    return L.purge_details(details, L.split_expired(r, as_of(), 10)[0]).select("run_id", "check_ord")


@query("l02_erase_subject", "SELECT 'kept' AS what, brand_key, count(*) AS n FROM v_runs WHERE brand_key <> 'b7' GROUP BY brand_key UNION ALL SELECT 'deleted', 'b7', count(*) FROM v_runs WHERE brand_key = 'b7'")
def l02(spark, d):
    left, gone = L.erase_subject({"runs": runs(spark, d)}, "b7")
    return left["runs"].groupBy("brand_key").agg(F.count("*").alias("n")).select(F.lit("kept").alias("what"), "brand_key", "n").unionByName(
        gone.select(F.lit("deleted").alias("what"), "brand_key", F.col("runs_deleted").alias("n")))


@query("l03_export_subject", "SELECT 'runs' AS \"table\", run_id, composite FROM v_runs WHERE brand_key = 'b7' UNION ALL SELECT 'scores', run_id, mention_rate FROM v_runs WHERE brand_key = 'b7'")
def l03(spark, d):
    r = runs(spark, d)
    out = L.export_subject({"runs": r.select("brand_key", "run_id", "composite"),
                            "scores": r.select("brand_key", "run_id", F.col("mention_rate").alias("composite"))}, "b7")
    back = F.from_json("row", "run_id string, composite double")
    return out.select("table", back["run_id"].alias("run_id"), back["composite"].alias("composite"))


@query("l04_holdings", "SELECT count(DISTINCT brand_key) AS brands_held, count(*) AS runs_held FROM v_runs")
def l04(spark, d):
    return L.holdings(runs(spark, d))
