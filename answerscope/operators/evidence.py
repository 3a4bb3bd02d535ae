"""What the checks of a site saw: the values behind each score, a few per host.

Values found on pages (types, comparison URLs, profiles) become rows of (host, check, value) with
the place where they stand first; these are reduced map-side before the first few of a host are
kept, and the group limit drops the rest on the map side too.  No host's pages meet in a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerscope import fixed
from answerscope.functions import html as H
from answerscope.functions.core import WS
from answerscope.functions.urls import host_of, path_or_self
from answerscope.operators import readiness as I
from answerscope.operators.robots import audit_ai_access

#: how many values of a check are kept per host
KEPT = {"jsonld-present": 12, "entity-schema": 12, "comparison-content": 6, "third-party-signals": 10}


def site_evidence(sites: DataFrame) -> DataFrame:
    """Evidence that needs no page: host, check_id, evidence.

    Blocked crawlers in order of the registry, lines of robots.txt and llms.txt and links of the
    latter, URLs in the sitemap, the origin.  A check without anything to show has no row.
    """
    robots, llms = (F.coalesce(c, F.lit("")) for c in ("robots_txt", "llms_txt"))
    lines = lambda text: F.concat(F.lit("lines "), F.size(F.split(text, "\r?\n", -1)).cast("string"))
    links = F.concat(F.lit("links "), F.regexp_count(llms, F.lit(r"\]\(")).cast("string"))
    some = F.size(F.coalesce("sitemap_urls", F.array().cast("array<string>")))
    shown = {
        "robots-txt": F.when(robots != "", F.array(lines(robots))),
        "llms-txt": F.when(llms != "", F.array(lines(llms), links)),
        "sitemap": F.when(some > 0, F.array(F.concat(F.lit("urls "), some.cast("string")))),
        "https": F.array("origin"),
    }
    rows = sites.select("host", F.explode(F.array(*[F.struct(F.lit(c).alias("check_id"), e.alias("evidence")) for c, e in shown.items()])).alias("e"))
    # as many crawlers as the registry has
    blocked = audit_ai_access(sites).where(~F.col("allowed")).groupBy("host").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("crawler_ord", "label"))), lambda x: x["label"]).alias("evidence"))
    return rows.select("host", "e.*").where("evidence IS NOT NULL").unionByName(blocked.select("host", F.lit("ai-crawler-access").alias("check_id"), "evidence"))


def _found(check_id: str, values: Column, tier: int) -> Column:
    """Values of a page as rows (check_id, tier, nth, value)."""
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v, i: F.struct(
        F.lit(check_id).alias("check_id"), F.lit(tier).alias("tier"), i.alias("nth"), v.alias("value")))


def listed_evidence(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """The first distinct values of a host: host, check_id, evidence.

    Types of structured data (12) and those that make an entity, URLs of comparison pages (6; those
    of pages first, then of the sitemap), known platforms linked to and after them the hosts of
    ``sameAs`` (10).  Order is that of pages (``page_ord``, then URL) and of places in a page.
    """
    comparison = "(?i)" + "|".join(f"(?:{p})" for p in I.COMPARISON)
    types = F.flatten(F.transform("nodes", lambda n: n["types"]))
    profiles = F.transform(F.flatten(F.transform("nodes", lambda n: n["same_as"])), lambda u: host_of(u))
    is_entity = lambda t: t.isin(fixed.ENTITY_TYPES)
    with_nodes = pages.select("host", "page_ord", "url", "html", I.PARTS["nodes"]().alias("nodes"))
    narrow = with_nodes.select(
        "host", "page_ord", "url", types.alias("types"),
        I.platforms_of(H.links("html", "url"), F.col("host")).alias("platforms"), F.filter(profiles, lambda h: h != "").alias("profiles"))
    rows = narrow.select("host", "page_ord", "url", F.explode_outer(F.concat(
        _found("jsonld-present", F.col("types"), 0), _found("entity-schema", F.filter("types", is_entity), 0),
        _found("comparison-content", F.when(path_or_self("url").rlike(comparison), F.array("url")), 0),
        _found("third-party-signals", F.col("platforms"), 0), _found("third-party-signals", F.col("profiles"), 1))).alias("f")).where("f.value <> ''")
    place = F.struct(F.col("f.tier").alias("tier"), F.col("page_ord").cast("long").alias("page_ord"), F.col("url").alias("url"), F.col("f.nth").alias("nth"))
    on_pages = rows.select("host", "f.check_id", "f.value", place.alias("place"))
    mapped = sites.select("host", F.posexplode("sitemap_urls").alias("nth", "value")).where(path_or_self("value").rlike(comparison))
    on_maps = mapped.select("host", F.lit("comparison-content").alias("check_id"), "value", F.struct(
        F.lit(1).alias("tier"), F.col("nth").cast("long").alias("page_ord"), F.lit("").alias("url"), F.lit(0).alias("nth")).alias("place"))
    once = on_pages.unionByName(on_maps).groupBy("host", "check_id", "value").agg(F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("host", "check_id").orderBy("place", "value"))
    first = once.withColumn("k", rank).where(F.col("k") <= max(KEPT.values()))
    kept = first.where(reduce(lambda a, b: a | b, [(F.col("check_id") == c) & (F.col("k") <= n) for c, n in KEPT.items()]))
    listed = F.array_sort(F.collect_list(F.struct("k", "value")))
    return kept.groupBy("host", "check_id").agg(F.transform(listed, lambda x: x["value"]).alias("evidence"))


def measured_evidence(pages: DataFrame) -> DataFrame:
    """Figures over a host's pages: host, check_id, evidence.

    Mean response time and over how many pages; median words and pages under 300; the newest date
    and how many there are; the first words of the home page's copy.  Checks without a page to
    measure have no row.
    """
    parts = [I.PARTS[p]().alias(p) for p in ("text", "nodes")]
    stamp = F.regexp_extract("html", I.STAMP, 1)
    dates = F.filter(F.transform(F.concat(F.flatten(F.transform("nodes", lambda n: n["dates"])), F.array(stamp)), I.parse_date), lambda d: d.isNotNull())
    home = F.when((F.col("page_ord") == 0) & (F.col("status") == 200), H.lead_copy("html", 25))
    ok, latency, words = (I.FEATURES[f][1]() for f in ("ok", "latency", "words"))
    rows = pages.select("*", *parts).select("host", latency.alias("ms"), F.when(ok, words).alias("words"), dates.alias("dates"), home.alias("home"))
    # one row per page of figures, reduced by (host, words) first: the histogram is as long as there are lengths
    by_length = rows.groupBy("host", "words").agg(
        F.count(F.lit(1)).alias("n"), F.count("ms").alias("timed"), F.sum("ms").alias("ms"), F.sum(F.size("dates")).alias("dated"),
        F.max(F.array_max("dates")).alias("newest"), F.max("home").alias("home"))
    lengths = F.collect_list(F.when(F.col("words").isNotNull(), F.struct(F.lpad(F.col("words").cast("string"), 10, "0").alias("value"), "n")))
    facts = by_length.groupBy("host").agg(
        F.sum("timed").alias("timed"), F.sum("ms").alias("ms"), F.sum("dated").alias("dated"), F.max("newest").alias("newest"), F.max("home").alias("home"),
        lengths.alias("hist"), F.sum(F.when(F.col("words").isNotNull(), F.col("n"))).alias("n_ok"), F.coalesce(F.sum(F.when(F.col("words") < 300, F.col("n"))), F.lit(0)).alias("short"))
    text = lambda c: F.col(c).cast("string")
    median = I._median(F.col("hist"), F.floor(F.col("n_ok") / 2)).cast("string")
    shown = {
        "response-speed": F.when(F.col("timed") > 0, F.array(F.concat(F.lit("ms "), F.floor(F.col("ms") / F.col("timed") + 0.5).cast("string")), F.concat(F.lit("pages "), text("timed")))),
        "content-depth": F.when(F.col("n_ok") > 0, F.array(F.concat(F.lit("median "), median), F.concat(F.lit("under 300 "), text("short")))),
        "freshness": F.when(F.col("newest").isNotNull(), F.array(F.concat(F.lit("newest "), F.date_format("newest", "yyyy-MM-dd")), F.concat(F.lit("dates "), text("dated")))),
        "entity-clarity": F.when(F.col("home").isNotNull(), F.array("home")),
    }
    return facts.select("host", F.explode_outer(F.array(*[F.struct(F.lit(c).alias("check_id"), e.alias("evidence")) for c, e in shown.items()])).alias("e")).select("host", "e.*").where("evidence IS NOT NULL")


def evidence(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """All evidence of the suite: host, check_id, evidence.

    Checks of single pages list the first pages that fail (``readiness.failing_pages``).  What the
    remaining checks saw is a yes or no, which their score tells.
    """
    single = I.failing_pages(pages, [c for c in I.PAGE_FAILS if c not in ("jsonld-present",)])
    return site_evidence(sites).unionByName(listed_evidence(sites, pages)).unionByName(measured_evidence(pages)).unionByName(single)
