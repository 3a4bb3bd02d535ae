"""Citation surfaces: where the cited pages live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerscope import fixed
from answerscope.functions.core import ratio, round_half_up
from answerscope.operators.metrics import RUN, entity_hosts, host_counts

# our own wording, one line per surface
LABELS = {
    "owned": "Own site", "competitor": "Competitor site", "community": "Communities",
    "review": "Reviews and directories", "editorial": "Press and editorial",
    "reference": "Reference works", "social": "Social networks",
    "marketplace": "Marketplaces", "other": "Unclassified",
}


def surface_of_host(host: Column) -> Column:
    """Surface by host pattern alone: first matching class in order, else other."""
    out = F.when(F.coalesce(host, F.lit("")) == "", "other")
    for surface, patterns in fixed.SURFACE_PATTERNS:
        out = out.when(host.rlike("|".join(patterns)), surface)
    return out.otherwise("other")


def classify(host: Column, is_own: Column, is_competitor: Column) -> Column:
    """Surface of a host for one brand (G1)."""
    return (
        F.when(F.coalesce(host, F.lit("")) == "", "other")
        .when(F.coalesce(is_own, F.lit(False)), "owned")
        .when(F.coalesce(is_competitor, F.lit(False)), "competitor")
        .otherwise(surface_of_host(host)))


def classified_hosts(outcomes: DataFrame, entities: DataFrame) -> DataFrame:
    """Credits per host with its surface; the patterns run once per distinct host."""
    return (
        host_counts(outcomes).join(entity_hosts(entities), ["brand_key", "host"], "left")
        .withColumn("surface", classify(F.col("host"), F.col("is_own"), F.col("is_competitor")))
        .drop("is_own", "is_competitor"))


def surface_summary(hosts: DataFrame) -> DataFrame:
    """Totals per run."""
    owned = F.sum(F.when(F.col("surface") == "owned", F.col("count")).otherwise(0))
    total = F.sum("count")
    return hosts.groupBy(*RUN).agg(
        total.alias("total_citations"), F.count(F.lit(1)).alias("unique_domains"),
        round_half_up(ratio(owned, total)).alias("owned_share"),
        round_half_up(ratio(total - owned, total)).alias("off_site_share"))


def surface_breakdown(hosts: DataFrame) -> DataFrame:
    """Credits and share per surface (G2); order by count desc, first_cited."""
    rows = hosts.groupBy(*RUN, "surface").agg(
        F.sum("count").alias("count"), F.min("first_cited").alias("first_cited"))
    total = F.sum("count").over(Window.partitionBy(*RUN))
    return rows.withColumn("share", round_half_up(ratio(F.col("count"), total)))


def surface_rollup(hosts: DataFrame) -> DataFrame:
    """Surface totals and their domains in one pass: ROLLUP within a run."""
    return (
        hosts.groupingSets(
            [[F.col(c) for c in RUN], [*map(F.col, RUN), F.col("surface")],
             [*map(F.col, RUN), F.col("surface"), F.col("host")]],
            *RUN, "surface", "host")
        .agg(F.sum("count").alias("count"),
             (F.grouping("surface") + F.grouping("host")).cast("int").alias("level")))


def top_domains(hosts: DataFrame, keep: int = fixed.DOMAINS_KEPT) -> DataFrame:
    w = Window.partitionBy(*RUN).orderBy(F.col("count").desc(), "first_cited")
    return hosts.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= keep)


def outreach_targets(hosts: DataFrame, keep: int = fixed.TARGETS_KEPT) -> DataFrame:
    """Most cited hosts that can be worked on."""
    rows = top_domains(hosts.where(~F.col("surface").isin("owned", "competitor")), keep)
    label = F.when(F.lit(False), "")
    for k, v in LABELS.items():
        label = label.when(F.col("surface") == k, v)
    return rows.withColumn("label", label)
