"""Prioritised fixes, roadmap, findings, report views.

Everything here is keyed by ``run_id`` and works on summary rows (at most 26 checks and one
visibility row per run).  The rule table is a constant of 26 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerscope import fixed
from answerscope.functions.core import lookup, round_half_up

COMPARISON_FIX, THIRD_PARTY_FIX = "build-comparison-pages", "build-third-party-presence"
SEVERITIES = ["critical", "high", "medium", "low"]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.RULES, "rule_id string, pillar string, impact int, effort int")


def triggered_fixes(checks: DataFrame) -> DataFrame:
    """The worst check behind each proposed fix, first on ties."""
    return checks.where(F.col("fix_id").isNotNull()).groupBy("run_id", "fix_id").agg(
        F.min(F.struct("score", "check_ord", "check_id")).alias("worst"),
        F.min("check_ord").alias("first_ord")).select(
        "run_id", "fix_id", "worst.score", "worst.check_id", "first_ord")


def severity_for(score: Column, impact: Column) -> Column:
    """J3."""
    return (
        F.when((score < 0.25) & (impact >= 4), "critical")
        .when((score < 0.5) & (impact >= 3), "high")
        .when(score < 0.75, "medium").otherwise("low"))


def priority(impact: Column, effort: Column, severity: Column) -> Column:
    """J5."""
    boost = lookup(severity, fixed.SEVERITY_BOOST, 0)
    return round_half_up((impact * 2 + boost * 1.5) / F.sqrt(effort.cast("double")), 2)


def severity_rank(severity: Column) -> Column:
    return lookup(severity, {s: i for i, s in enumerate(SEVERITIES)}, len(SEVERITIES))


def roadmap_bucket(severity: Column, impact: Column, effort: Column) -> Column:
    """now / next / later."""
    return (
        F.when((severity == "critical") | ((effort <= 2) & (impact >= 4)), "now")
        .when(effort <= 3, "next").otherwise("later"))


def join_rules(triggers: DataFrame) -> DataFrame:
    """Rule columns and severity per trigger; unknown fix ids drop out."""
    dim = rules(triggers.sparkSession).withColumnRenamed("rule_id", "fix_id")
    return triggers.join(F.broadcast(dim), "fix_id").withColumn(
        "severity", severity_for(F.col("score"), F.col("impact")))


def measured_triggers(visibility: DataFrame, triggers: DataFrame) -> DataFrame:
    """Fixes raised by measured absence unless a check already raised them."""
    gap_ratio = F.col("gap_count") / F.col("prompts_answered")
    cited = F.coalesce("citation_rate", F.lit(0.0))
    raised = visibility.where(F.col("prompts_answered") > 0).select("run_id", F.explode(F.array_compact(F.array(
        F.when(gap_ratio > 0.3, F.struct(
            F.lit(COMPARISON_FIX).alias("fix_id"), (1 - gap_ratio).alias("score"),
            F.lit("comparison-content").alias("check_id"), F.lit(100).alias("first_ord"))),
        F.when(cited < 0.15, F.struct(
            F.lit(THIRD_PARTY_FIX).alias("fix_id"), cited.alias("score"),
            F.lit("third-party-signals").alias("check_id"), F.lit(101).alias("first_ord")))))).alias("t"))
    return raised.select("run_id", "t.*").join(
        triggers.select("run_id", "fix_id"), ["run_id", "fix_id"], "left_anti")


def measured_rules(readiness: DataFrame, visibility: DataFrame) -> DataFrame:
    """Rules without a check: blocked crawls and what the answers show."""
    spec = {r[0]: r for r in fixed.MEASURED_RULES}

    def rule(rule_id: str, ord_: int, value: Column) -> Column:
        _, severity, impact, effort, pillar = spec[rule_id]
        return F.struct(
            F.lit(rule_id).alias("rec_id"), F.lit(severity).alias("severity"), F.lit(impact).alias("impact"),
            F.lit(effort).alias("effort"), F.lit(pillar).alias("pillar"),
            value.cast("double").alias("evidence"), F.lit(ord_).alias("ord"))

    blocked = readiness.where("blocked").select("run_id", F.when(
        F.col("robots_blocked"), rule("robots-disallows-crawling", -1, F.lit(1.0))).otherwise(
        rule("crawl-blocked", -1, F.lit(1.0))).alias("r"))
    v = {c: F.coalesce(c, F.lit(0)) for c in (
        "mention_rate", "dismissed_count", "total_citations", "off_site_share")}
    influence = F.coalesce("influence_ratio", F.lit(0.0))
    shown = visibility.where(F.col("prompts_answered") > 0).select("run_id", F.explode(F.array_compact(F.array(
        F.when((v["mention_rate"] >= 0.3) & (influence < 0.35),
               rule("convert-mentions-to-recommendations", 102, influence)),
        F.when(v["dismissed_count"] > 0, rule("address-dismissals", 103, v["dismissed_count"])),
        F.when((v["total_citations"] >= 4) & (v["off_site_share"] >= 0.7),
               rule("work-the-off-site-surfaces", 104, v["off_site_share"])),
        F.when(F.col("branded_rate") < 0.8, rule("branded-recall-alert", 105, F.col("branded_rate"))),
    ))).alias("r"))
    return blocked.unionByName(shown).select("run_id", "r.*")


def recommend(checks: DataFrame, readiness: DataFrame, visibility: DataFrame) -> DataFrame:
    """Full action plan (J1-J6): one row per run and recommendation.

    checks: run_id, check_ord, check_id, score, fix_id.  readiness: run_id, blocked,
    robots_blocked.  visibility: run_id, prompts_answered, gap_count, citation_rate,
    mention_rate, influence_ratio, dismissed_count, total_citations, off_site_share,
    branded_rate (null when no branded prompt was asked).
    """
    triggers = triggered_fixes(checks)
    by_rule = join_rules(triggers.unionByName(measured_triggers(visibility, triggers))).select(
        "run_id", F.col("fix_id").alias("rec_id"), "severity", "impact", "effort", "pillar",
        F.col("score").alias("evidence"), F.col("first_ord").alias("ord"))
    every = by_rule.unionByName(measured_rules(readiness, visibility))
    return every.withColumns({
        "priority": priority(F.col("impact"), F.col("effort"), F.col("severity")),
        "severity_rank": severity_rank(F.col("severity")),
        "bucket": roadmap_bucket(F.col("severity"), F.col("impact"), F.col("effort"))})


def in_order(recs: DataFrame) -> DataFrame:
    """Reading order of the plan: severity, then priority, then order of discovery."""
    return recs.orderBy("run_id", "severity_rank", F.col("priority").desc(), "ord")


FINDINGS_KEPT = 6


def summary_points(facts: DataFrame) -> DataFrame:
    """Findings feed (J7): first six rule hits per run, in fixed order, as code + value.

    facts: run_id, blocked, blocked_critical, brand_share, leader_is_brand, gap_count,
    dismissed_count, mention_rate, influence_ratio, total_citations, off_site_share,
    citation_rate, visibility_run (boolean), technical, structure, content, authority
    (nullable pillar scores), critical_recs.
    """
    f = F.col
    ran = f("visibility_run")
    # weakest pillar: lowest score, the first listed on ties
    pillars = F.array_compact(F.array(*[
        F.when(f(p).isNotNull(), F.struct(f(p).alias("v"), F.lit(i).alias("i"), F.lit(p).alias("p")))
        for i, p in enumerate(["technical", "structure", "content", "authority"])]))
    worst = F.array_min(pillars)

    def hit(code: str, cond: Column, value: Column, detail: Column | None = None) -> Column:
        return F.when(cond, F.struct(
            F.lit(code).alias("code"), value.cast("double").alias("value"),
            (F.lit("") if detail is None else detail).alias("detail")))

    low_influence = (f("dismissed_count") == 0) & (f("mention_rate") >= 0.3) & (f("influence_ratio") < 0.35)
    points = F.array_compact(F.array(
        hit("crawl_blocked", f("blocked"), F.lit(1)),
        hit("critical_crawlers_blocked", f("blocked_critical") > 0, f("blocked_critical")),
        hit("leads_share", ran & f("leader_is_brand"), f("brand_share")),
        hit("behind_leader", ran & ~f("leader_is_brand"), f("brand_share")),
        hit("gaps", ran & (f("gap_count") > 0), f("gap_count")),
        hit("dismissals", ran & (f("dismissed_count") > 0), f("dismissed_count")),
        hit("low_influence", ran & low_influence, f("influence_ratio")),
        hit("off_site", ran & (f("total_citations") >= 4) & (f("off_site_share") >= 0.7), f("off_site_share")),
        hit("rarely_cited", ran & (f("citation_rate") < 0.2), f("citation_rate")),
        hit("weakest_pillar", ~f("blocked") & worst.isNotNull(), worst["v"], worst["p"]),
        hit("critical_fixes", F.lit(True), f("critical_recs"))))
    return facts.select("run_id", F.posexplode(F.slice(points, 1, FINDINGS_KEPT)).alias("pos", "x")).select(
        "run_id", "pos", "x.code", "x.value", "x.detail")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key (J8); limited per partition before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def report_views(gaps: DataFrame, stability: DataFrame, domains: DataFrame, checks: DataFrame) -> dict[str, DataFrame]:
    """The report's short lists."""
    run = ["run_id", "brand_key"]
    by_loss = [F.col("sort_key").desc(), F.col("first_ord")]
    by_count = [F.col("count").desc(), F.col("pos")]
    return {
        "gaps": top_k(gaps, run, by_loss, 15),
        "lost_prompts": top_k(gaps, run, by_loss, 5),
        "contested": top_k(stability.where("stability = 'contested'"), run,
                           [F.col("rate"), F.col("first_ord")], 15),
        "domains": domains.where("pos <= 15"),
        "outside_domains": top_k(domains.where("NOT is_own").withColumnRenamed("pos", "rank_in_run"), run,
                                 [F.col("rank_in_run")], 6),
        "checks": checks.orderBy("run_id", "pillar", "score", "check_ord"),
    }
