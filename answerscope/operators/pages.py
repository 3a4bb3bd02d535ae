"""Page selection and page / site snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerscope import fixed
from answerscope.functions import html as H
from answerscope.functions import jsonld as J
from answerscope.functions.text import word_count
from answerscope.functions.core import trim_ws
from answerscope.functions.urls import host_of, normalise_url, path_of, resolve_url, strip_www

SITEMAPS_READ, CHILDREN_PER_INDEX, CHILDREN_READ = 4, 3, 3


def kept_pages(pages: DataFrame) -> DataFrame:
    """Home page and every page that answered below 400."""
    return pages.where(((F.col("status") > 0) & (F.col("status") < 400)) | (F.col("page_ord") == 0))


def plain_body(ok: Column, body: Column) -> Column:
    """Body of a plain-text resource, null for errors and HTML error pages."""
    return F.when(ok & ~F.substring(body, 1, 400).rlike(r"(?i)<html[\s>]"), body)


def sitemap_urls(sites: DataFrame, bodies: DataFrame) -> DataFrame:
    """URLs listed by a site's sitemaps (A8): host, url, first place found.

    ``sites``: host, origin, robots_txt.  ``bodies``: host, url, body (null when not ok).  A large
    file may come in several bodies, a row each: all are read, and places count within a body.
    """
    default = F.array(F.concat("origin", F.lit("/sitemap.xml")), F.concat("origin", F.lit("/sitemap_index.xml")))
    declared = F.regexp_extract_all(
        F.coalesce("robots_txt", F.lit("")), F.lit(r"(?im)^[ \t]*sitemap:[ \t]*(\S+)"), 1)
    candidates = sites.select("host", F.posexplode(F.slice(F.array_distinct(
        F.concat(default, declared)), 1, SITEMAPS_READ)).alias("cand", "sitemap"))

    def locs(body: str) -> Column:
        return F.regexp_extract_all(F.col(body), F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), 1)

    read = candidates.join(
        bodies.select("host", F.col("url").alias("sitemap"), "body"), ["host", "sitemap"]
    ).where(F.col("body").isNotNull()).select(
        "host", "cand", locs("body").alias("locs"), F.col("body").rlike("(?i)<sitemapindex").alias("is_index"))
    direct = read.where(~F.col("is_index")).select(
        "host", F.lit(0).alias("pass"), "cand", F.posexplode("locs").alias("pos", "url"))
    nth = Window.partitionBy("host").orderBy("cand", "pos")
    children = (
        read.where("is_index")
        .select("host", "cand", F.posexplode(F.slice("locs", 1, CHILDREN_PER_INDEX)).alias("pos", "child"))
        .withColumn("n", F.row_number().over(nth)).where(F.col("n") <= CHILDREN_READ))
    nested = children.join(
        bodies.select("host", F.col("url").alias("child"), "body"), ["host", "child"]
    ).where(F.col("body").isNotNull()).select(
        "host", F.lit(1).alias("pass"), F.col("n").alias("cand"), F.posexplode(locs("body")).alias("pos", "url"))
    return direct.unionByName(nested).groupBy("host", "url").agg(
        F.min(F.struct("pass", "cand", "pos")).alias("first_found"))


def extract_pages(raw: DataFrame) -> DataFrame:
    """Raw pages (url, html, ...) with text, title, description, headings, links, JSON-LD."""
    return raw.withColumns({
        "text": H.to_text("html"), "title": H.title("html"), "description": H.description("html"),
        "headings": H.headings("html"), "jsonld": J.nodes("html"), "links": H.links("html", "url"),
        "bytes": F.length("html").cast("long")})


def page_summary(pages: DataFrame) -> DataFrame:
    """Report rows of fetched pages (C13); schema types keep their prefix here."""
    return pages.where(F.col("status") == 200).select(
        "host", "url", H.title("html").alias("title"),
        word_count(H.to_text("html")).alias("words"),
        J.schema_types(J.nodes("html"), strip=False).alias("schema_types"))


def site_summary(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """Report row of a site (C14)."""
    crawled = pages.groupBy("host").agg(F.count_if(F.col("status") == 200).alias("pages_crawled"))
    return sites.join(crawled, "host", "left").select(
        "host", "origin", "reachable", F.coalesce("pages_crawled", F.lit(0)).alias("pages_crawled"),
        F.size("sitemap_urls").alias("sitemap_urls"),
        (F.coalesce("robots_txt", F.lit("")) != "").alias("has_robots_txt"),
        (F.coalesce("llms_txt", F.lit("")) != "").alias("has_llms_txt"), "error")


def clean_page_url(url: Column) -> Column:
    """URL without query, fragment and one trailing slash."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/$", "")


def select_pages(
    sites: DataFrame, discovered: DataFrame, pinned: DataFrame | None = None,
    limit: int = fixed.MAX_PAGES,
) -> DataFrame:
    """Which pages of a host to read (D7): host, url, pick.

    Tiers: home, pinned, first URL per priority path, then shallowest first.  Discovered URLs are
    read and spelled once: each gives a row for itself and one per priority path it matches, and
    both are reduced map-side, so a host with a third of all URLs ships at most ``limit`` rows per
    task to the per-host top-k.  ``discovered``: host, ord, url.  ``sites``: host, origin.
    ``pinned``: host, ord, url (a pinned page may be relative to the origin).  Addresses are compared
    and returned in their canonical spelling (case of the host, default ports, dot segments).
    """
    sites = sites.withColumn("origin", F.regexp_replace(normalise_url("origin"), "/$", ""))
    zero = F.lit(0).cast("long")

    def spelled(df: DataFrame) -> DataFrame:
        # resolving an address spells it canonically
        known = df.join(sites.select("host", "origin"), "host")
        return known.withColumn("url", resolve_url(trim_ws("url"), F.concat("origin", F.lit("/")))).drop("origin")

    def own(url: Column) -> Column:
        """Whether a canonical address is one of the host's."""
        return strip_www(F.regexp_extract(url, "^[a-z]+://(?:[^/?#]*@)?([^/?#]*)", 1)) == strip_www("host")

    def place(tier: int | Column, a: Column, b: Column, c: Column) -> Column:
        tier = F.lit(tier) if isinstance(tier, int) else tier
        return F.struct(tier.cast("int").alias("tier"), a.cast("long").alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c"))

    path = path_of("url")
    depth = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    itself = F.struct(F.lit(-1).alias("p"), place(3, depth, F.length("url"), F.col("ord")).alias("place"))
    # of the addresses that match a priority path the first one counts
    matches = F.array_compact(F.array(*[F.when(path.rlike("(?i)" + rx), F.struct(
        F.lit(p).alias("p"), place(2, F.col("ord"), zero, zero).alias("place"))) for p, rx in enumerate(fixed.PRIORITY_PATHS)]))
    rows = spelled(discovered).where(own(F.col("url"))).select("host", "url", F.explode_outer(F.concat(F.array(itself), matches)).alias("e"))
    found = rows.groupBy("host", "e.p", F.when(F.col("e.p") < 0, F.col("url")).alias("key")).agg(F.min(F.struct("e.place", "url")).alias("first"))
    # among themselves the priority paths stand in their own order
    candidates = found.select("host", "first.url", F.when(F.col("p") < 0, F.col("first.place")).otherwise(place(2, F.col("p"), zero, zero)).alias("place"))
    candidates = candidates.unionByName(sites.select("host", F.col("origin").alias("url"), place(0, zero, zero, zero).alias("place")))
    if pinned is not None:
        candidates = candidates.unionByName(spelled(pinned).select("host", "url", place(1, F.col("ord"), zero, zero).alias("place")))
    clean = candidates.withColumn("url", clean_page_url(F.col("url"))).where(own(F.col("url")) & ~F.col("url").rlike("(?i)" + fixed.ASSET_PATTERN))
    distinct = clean.groupBy("host", "url").agg(F.min("place").alias("place"))
    w = Window.partitionBy("host").orderBy("place", "url")
    return distinct.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= limit).drop("place")

