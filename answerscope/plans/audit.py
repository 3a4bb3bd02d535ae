"""Whole audits for all brands in one plan: visibility, readiness, fixes, roll-up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.operators import history as K
from answerscope.operators import metrics as M
from answerscope.operators import readiness as I
from answerscope.operators import recommend as J
from answerscope.operators import surfaces as G
from answerscope.session import materialise

RUN = M.RUN


@dataclass
class Audit:
    """Tables of an audit."""

    outcomes: DataFrame
    summary: DataFrame
    share_of_voice: DataFrame
    gaps: DataFrame
    wins: DataFrame
    hosts: DataFrame
    surfaces: DataFrame
    checks: DataFrame
    readiness: DataFrame
    recommendations: DataFrame
    runs: DataFrame


def visibility_facts(outcomes: DataFrame, hosts: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row per run with the numbers the fix rules look at."""
    gap_count = gaps.groupBy(*RUN).agg(F.count(F.lit(1)).alias("gap_count"))
    branded = M.by_intent(outcomes).where("intent = 'branded'").select(*RUN, F.col("rate").alias("branded_rate"))
    cites = G.surface_summary(hosts).select(*RUN, "total_citations", "off_site_share")
    return (
        M.summarise(outcomes).join(gap_count, RUN, "left").join(branded, RUN, "left")
        .join(cites, RUN, "left").withColumn("gap_count", F.coalesce("gap_count", F.lit(0))))


def audit(
    outcomes: DataFrame, entities: DataFrame, sites: DataFrame, pages: DataFrame, brands: DataFrame,
    run_sites: DataFrame, as_of: Column | None = None,
) -> Audit:
    """Everything about a set of runs.

    ``outcomes`` should come from a written table (score once, read many); it feeds seven
    aggregates.  ``run_sites``: run_id, brand_key, host, created_at.
    """
    summary = M.summarise(outcomes)
    gaps = M.find_gaps(outcomes)
    hosts = G.classified_hosts(outcomes, entities)
    sov = M.share_of_voice(outcomes, entities)
    # 26 narrow rows per host that feed scores, fixes and the output: computed once
    host_checks = materialise(I.run_checks(sites, pages, brands, as_of))
    usable = host_checks.join(
        sites.where(F.col("reachable") & ~F.col("robots_blocked")).select("host"), "host", "left_semi")
    checks = run_sites.select("run_id", "host").join(usable, "host")
    readiness = run_sites.join(I.assess_readiness(sites, host_checks), "host")
    facts = visibility_facts(outcomes, hosts, gaps)
    recs = J.recommend(checks, readiness, facts)
    halves = (
        run_sites.select(*RUN, "created_at")
        .join(readiness.select("run_id", F.col("overall").alias("readiness"), "blocked"), "run_id", "left")
        .join(summary.select(*RUN, F.col("score").alias("visibility"), "mention_rate", "citation_rate"), RUN, "left")
        .join(recs.groupBy("run_id").agg(F.count(F.lit(1)).alias("recommendations")), "run_id", "left"))
    return Audit(
        outcomes=outcomes, summary=summary, share_of_voice=sov, gaps=gaps, wins=M.find_wins(outcomes),
        hosts=hosts, surfaces=G.surface_breakdown(hosts), checks=checks, readiness=readiness,
        recommendations=recs, runs=K.roll_up(halves))
