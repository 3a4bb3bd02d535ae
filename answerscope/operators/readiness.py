"""Site readiness: 26 checks as one aggregate over pages, pillar scores, gating.

``page_features`` turns HTML into a narrow row once; every check is a few sums and maxima
over those rows plus a score expression, so asking for one check computes only what it uses.
The whole suite reads the pages once: what has to be counted distinct per host (comparison
URLs, third-party profiles) or ranked (word counts) rides along as token rows, reduced by
(host, token) first and by host after.  Both steps combine map-side, so a host with a third
of all pages is reduced where its pages are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerscope import fixed
from answerscope.functions import html as H
from answerscope.functions import jsonld as J
from answerscope.functions import text as T
from answerscope.functions.core import (
    NOT_AFTER_WORD as NB, NOT_BEFORE_WORD as NA, WS, clamp, literals, ratio, round_half_up, status_for,
)
from answerscope.functions.urls import host_of, path_or_self, strip_www
from answerscope.operators.contact import across_pages
from answerscope.operators.robots import audit_ai_access

# --- fixed values: patterns of the checks ---
COMPARISON = [
    rf"{NB}vs{NA}|{NB}versus{NA}", rf"{NB}alternatives?{NA}", rf"{NB}compare|comparison{NA}",
    rf"{NB}best{NA}.{{0,40}}{NB}(?:for|in|of){NA}",
]
QUESTION = (
    rf"(?i)^(?:how|what|why|when|where|who|which|can|do|does|is|are|should|will){NA}|\?\z"
)
# A number with thousands marks: groups of one to three digits, the last of exactly three.  A
# repeated group of varying length recurses once per repetition in the regex engine, so middle
# groups of one or two digits are dropped first and the rest is a repetition of fixed length.
MIDDLE_GROUP = rf"(?<={NB}\d{{1,3}}),\d{{1,2}}(?=,)"
FIGURES = (
    rf"(?i){NB}\d{{1,3}}(?:\.\d+)?%|{NB}\d{{1,3}}(?:,\d{{3}})+{NA}"
    rf"|\$\s?\d[\d,.]*(?:\s?(?:k|m|bn|billion|million))?(?:(?<=[A-Za-z0-9_]){NA}|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    rf"|{NB}\d+x{NA}"
)
PHONE = rf"\+?\d[\d\s\x{{a0}}().-]{{7,}}\d"
STREET = (
    rf"(?i){NB}\d{{1,5}}{WS}+[A-Z][a-zA-Z]+{WS}+"
    rf"(?:street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|suite|ste){NA}"
)
EMAIL = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
BYLINE = rf"{NB}by{WS}+[A-Z][a-z]+{WS}+[A-Z][a-z]+"
CANONICAL = rf"(?i)<link{NA}[^>]*rel\s*=\s*[\"']canonical[\"']"
LANDMARK = rf"(?i)<(?:main|article){NA}"
STAMP = rf"(?i)<time{NA}[^>]*datetime\s*=\s*[\"']([^\"']+)[\"']"
FAQ_URL = "(?i)faq|frequently-asked|questions"


def count_figures(text: str) -> Column:
    """Percentages, numbers with thousands marks, amounts and multiples in a text."""
    return F.regexp_count(F.regexp_replace(text, MIDDLE_GROUP, ""), F.lit(FIGURES))


def parse_date(s: Column) -> Column:
    """ISO-8601 dates and times, RFC 2822 dates with the weekday dropped; else null."""
    t = F.regexp_replace(F.trim(s), r"^[A-Za-z]{3,9},\s*", "")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}(-\d{2})?([T ].*)?$"), F.try_to_timestamp(t))
    month = F.when(t.rlike(r"^\d{4}-\d{2}$"), F.try_to_timestamp(F.concat(t, F.lit("-01"))))
    rfc = F.when(
        t.rlike(r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}( (GMT|UTC|Z))?$"),
        F.try_to_timestamp(F.regexp_replace(t, " (GMT|UTC|Z)$", ""), F.lit("d MMM yyyy HH:mm:ss")))
    return F.coalesce(month, iso, rfc)


def _types(types: list[str]) -> Column:
    wanted = F.array(*map(F.lit, types))
    return F.exists("nodes", lambda n: F.arrays_overlap(n["types"], wanted))


def _node(key: str) -> Column:
    return F.exists("nodes", lambda n: n[key])


def _heads(cond: Callable[[Column], Column]) -> Column:
    return F.size(F.filter("headings", cond))


def _compares() -> Column:
    rx = "(?i)" + "|".join(f"(?:{p})" for p in COMPARISON)
    return F.col("title").rlike(rx) | path_or_self("url").rlike(rx)


def _newest() -> Column:
    stamp = F.regexp_extract("html", STAMP, 1)
    listed = F.flatten(F.transform("nodes", lambda n: n["dates"]))
    dates = F.concat(listed, F.when(stamp != "", F.array(stamp)).otherwise(F.array().cast("array<string>")))
    return F.array_max(F.transform(dates, parse_date))


def _lead() -> Column:
    text = F.concat_ws(" ", "title", "description", H.lead_copy("html", 120))
    fetched = F.when(F.col("status") == 200, "1").otherwise("0")
    return F.when(F.col("page_ord") == 0, F.concat(fetched, T.normalise(text)))


# parts of a page that several features share
PARTS: dict[str, Callable[[], Column]] = {
    "text": lambda: H.to_text("html"),
    "headings": lambda: H.headings("html"),
    "title": lambda: H.title("html"),
    "description": lambda: H.description("html"),
    "nodes": lambda: J.node_facts(J.nodes("html")),
}
# feature -> (parts it reads, expression)
FEATURES: dict[str, tuple[list[str], Callable[[], Column]]] = {
    "ok": ([], lambda: F.col("status") == 200),
    "latency": ([], lambda: F.when((F.col("status") == 200) & (F.col("latency_ms") > 0), F.col("latency_ms"))),
    "words": (["text"], lambda: T.word_count("text")),
    "shell": (["text"], lambda: H.looks_client_rendered("html", F.col("text"))),
    "canonical": ([], lambda: F.col("html").rlike(CANONICAL)),
    "has_ld": (["nodes"], lambda: F.size("nodes") > 0),
    "entity_type": (["nodes"], lambda: _types(fixed.ENTITY_TYPES)),
    "same_as": (["nodes"], lambda: _node("has_same_as")),
    "faq_type": (["nodes"], lambda: _types(fixed.FAQ_TYPES)),
    "faq_full": (["nodes"], lambda: _node("has_questions")),
    "offer_type": (["nodes"], lambda: _types(fixed.OFFER_TYPES)),
    "priced": (["nodes"], lambda: _node("priced")),
    "good_outline": (["headings"], lambda: (_heads(lambda h: h["level"] == 1) == 1)
                     & (_heads(lambda h: h["level"] == 2) >= 2)),
    "subheads": (["headings"], lambda: _heads(lambda h: h["level"] >= 2)),
    "q_subheads": (["headings"], lambda: _heads(lambda h: (h["level"] >= 2) & h["text"].rlike(QUESTION))),
    "q_heads": (["headings"], lambda: _heads(lambda h: F.endswith(h["text"], F.lit("?")))),
    "landmark": ([], lambda: F.col("html").rlike(LANDMARK)),
    "described": (["description"], lambda: F.length("description") >= 60),
    "capsule": ([], lambda: T.is_answer_capsule(H.lead_copy("html", 60))),
    "compares": (["title"], _compares),
    "faq_url": ([], lambda: F.col("url").rlike(FAQ_URL)),
    "quotable": (["text"], lambda: count_figures("text") >= 3),
    "newest": (["nodes"], _newest),
    "phone": (["text", "nodes"], lambda: F.col("text").rlike(PHONE) | _node("phone")),
    "street": (["text", "nodes"], lambda: F.col("text").rlike(STREET) | _node("address")),
    "email": (["text"], lambda: F.col("text").rlike(EMAIL)),
    "author_ld": (["nodes"], lambda: _node("author")),
    "author_meta": ([], lambda: H.meta("html", "author") != ""),
    "byline": (["text"], lambda: F.substring("text", 1, 4000).rlike(BYLINE)),
    "profiles": (["nodes"], lambda: F.array_distinct(F.concat(
        platforms_of(H.links("html", "url"), F.col("host")),
        F.transform(F.flatten(F.transform("nodes", lambda n: n["same_as"])), lambda u: host_of(u))))),
    "home": (["title", "description"], _lead),
}


def page_features(pages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One narrow row per page: host, page_ord, url and the named features (all by default)."""
    chosen = list(FEATURES) if names is None else names
    parts = [p for p in PARTS if any(p in FEATURES[n][0] for n in chosen)]
    with_parts = pages.select("*", *[PARTS[p]().alias(p) for p in parts]) if parts else pages
    return with_parts.select("host", "page_ord", "url", *[FEATURES[n][1]().alias(n) for n in chosen])


def platforms_of(links: Column, own: Column) -> Column:
    """Known platforms a page links to, each once."""
    known = literals(fixed.PLATFORMS)

    def platform(h: Column) -> Column:
        return F.try_element_at(
            F.filter(known, lambda p: (h == p) | F.endswith(h, F.concat(F.lit("."), p))), F.lit(1))

    hosts = F.array_distinct(F.transform(links, lambda u: host_of(u)))
    foreign = F.filter(hosts, lambda h: (h != "") & (h != strip_www(own)))
    return F.array_distinct(F.filter(F.transform(foreign, platform), lambda p: p.isNotNull()))


# --- the checks -------------------------------------------------------------------------


@dataclass(frozen=True)
class Check:
    """One check: the page features it reads, the sums and maxima it takes of them, its score.

    ``sums`` and ``maxima`` map a name the score uses to an expression over features.
    ``token`` names what has to be counted or ranked per distinct value.
    """

    id: str
    pillar: str
    weight: int
    score: Callable[[], Column]
    fix: str
    fix_below: float
    features: tuple[str, ...] = ()
    sums: Callable[[], dict[str, Column]] = dict
    maxima: Callable[[], dict[str, Column]] = dict
    token: str | None = None
    needs_pages: bool = False  # no fix is proposed when there was nothing to analyse


def _c(name: str) -> Column:
    return F.col(name)


def _n_ok() -> dict[str, Column]:
    return {"n_ok": _c("ok").cast("long")}


def _share_of(check_id: str, pillar: str, weight: int, feature: str, none: float, fix: str, below: float,
              pages_only: bool = True) -> Check:
    """Share of fetched pages with a property; ``none`` when no page was fetched."""
    n = f"n_{feature}"
    return Check(
        check_id, pillar, weight,
        lambda: F.when(_c("n_ok") > 0, _c(n) / _c("n_ok")).otherwise(none), fix, below, ("ok", feature),
        lambda: _n_ok() | {n: (_c("ok") & _c(feature)).cast("long")}, needs_pages=pages_only)


def _graded(check_id: str, weight: int, kind: str, full: str, scores: tuple[float, float, float], fix: str) -> Check:
    """Structured data: absent, present, present and complete on any page."""
    absent, present, complete = scores
    return Check(
        check_id, "structure", weight,
        lambda: F.when(~_c(f"any_{kind}"), absent).when(_c(f"any_{full}"), complete).otherwise(present),
        fix, 1.0, (kind, full), maxima=lambda: {f"any_{kind}": _c(kind), f"any_{full}": _c(full)})


def _steps(value: Column, *steps: tuple[float, float], other: float) -> Column:
    out = F.when(F.lit(False), F.lit(other))
    for at_least, score in steps:
        out = out.when(value >= at_least, score)
    return out.otherwise(F.lit(other))


# fixed values: ids, pillars, weights, scores and bounds of the checks
CHECKS: list[Check] = [
    Check("ai-crawler-access", "technical", 10, lambda: _c("critical_allowed"), "unblock-ai-crawlers", 1.0),
    Check("robots-txt", "technical", 3, lambda: F.when(~_c("has_robots"), 0.2)
          .when(_c("robots_sitemap"), 1.0).otherwise(0.65), "ship-robots-txt", 1.0),
    Check("llms-txt", "technical", 4, lambda: F.when(~_c("has_llms"), 0.0)
          .when(_c("llms_routes"), 1.0).otherwise(0.6), "publish-llms-txt", 1.0),
    Check("sitemap", "technical", 3, lambda: F.when(_c("n_sitemap") == 0, 0.1).otherwise(
        _steps(_c("n_sitemap"), (15, 1.0), (5, 0.8), other=0.5)), "ship-sitemap", 0.8),
    Check("https", "technical", 3, lambda: F.when(_c("secure"), 1.0).otherwise(0.0), "enable-https", 1.0),
    Check("server-rendering", "technical", 8,
          lambda: F.when(_c("n_ok") > 0, 1 - _c("n_thin") / _c("n_ok")).otherwise(0.0),
          "server-render-content", 0.9, ("ok", "shell", "words"),
          lambda: _n_ok() | {"n_thin": (_c("ok") & (_c("shell") | (_c("words") < 120))).cast("long")},
          needs_pages=True),
    Check("response-speed", "technical", 2,
          lambda: F.when(_c("n_timed") == 0, 0.5).when(_c("ms") < 600 * _c("n_timed"), 1.0)
          .when(_c("ms") < 1500 * _c("n_timed"), 0.8).when(_c("ms") < 3000 * _c("n_timed"), 0.5).otherwise(0.2),
          "speed-up-origin", 0.8, ("latency",),
          lambda: {"n_timed": _c("latency").isNotNull().cast("long"), "ms": _c("latency")}),
    _share_of("canonical", "technical", 2, "canonical", 0.5, "add-canonical", 0.8),
    _share_of("jsonld-present", "structure", 7, "has_ld", 0.0, "add-jsonld", 0.8, pages_only=False),
    _graded("entity-schema", 6, "entity_type", "same_as", (0.1, 0.65, 1.0), "add-entity-schema"),
    _graded("faq-schema", 5, "faq_type", "faq_full", (0.0, 0.7, 1.0), "add-faq-schema"),
    _graded("offer-schema", 4, "offer_type", "priced", (0.15, 0.6, 1.0), "add-offer-schema"),
    _share_of("heading-hierarchy", "structure", 4, "good_outline", 0.5, "fix-headings", 0.8),
    Check("question-headings", "structure", 5, lambda: F.when(_c("n_q_sub") == 0, 0.1).otherwise(
        _steps(ratio(_c("n_q_sub"), _c("n_sub")), (0.25, 1.0), (0.12, 0.7), other=0.4)),
          "question-headings", 0.8, ("ok", "subheads", "q_subheads"), lambda: {
              "n_sub": F.when(_c("ok"), _c("subheads")), "n_q_sub": F.when(_c("ok"), _c("q_subheads"))}),
    _share_of("semantic-html", "structure", 2, "landmark", 0.5, "semantic-landmarks", 0.8),
    _share_of("meta-description", "structure", 2, "described", 0.5, "write-meta-descriptions", 0.8),
    _share_of("answer-capsule", "content", 7, "capsule", 0.5, "write-answer-capsules", 0.8),
    Check("comparison-content", "content", 8,
          lambda: _steps(_c("n_compare"), (3, 1.0), (2, 0.75), (1, 0.45), other=0.05),
          "build-comparison-pages", 0.75, ("compares",), token="compare"),
    Check("faq-content", "content", 6, lambda: F.when(_c("n_q_heads") >= 6, 1.0)
          .when(_c("n_q_heads") >= 3, 0.75).when(_c("n_faq_url") > 0, 0.5)
          .when(_c("n_q_heads") > 0, 0.35).otherwise(0.05), "add-faq-content", 0.75,
          ("ok", "q_heads", "faq_url"), lambda: {
              "n_q_heads": F.when(_c("ok"), _c("q_heads")), "n_faq_url": (_c("ok") & _c("faq_url")).cast("long")}),
    Check("content-depth", "content", 4, lambda: F.when(_c("median_words").isNull(), 0.5).otherwise(
        _steps(_c("median_words"), (800, 1.0), (500, 0.8), (300, 0.55), other=0.25)),
          "deepen-content", 0.8, ("ok", "words"), _n_ok, token="words", needs_pages=True),
    _share_of("quotable-stats", "content", 5, "quotable", 0.5, "add-quotable-stats", 0.7),
    Check("freshness", "content", 4, lambda: F.when(_c("age_days").isNull(), 0.15)
          .when(_c("age_days") <= 60, 1.0).when(_c("age_days") <= 180, 0.75)
          .when(_c("age_days") <= 365, 0.45).otherwise(0.2), "add-freshness-signals", 0.75, ("newest",),
          maxima=lambda: {"newest": _c("newest")}),
    Check("third-party-signals", "authority", 6,
          lambda: _steps(_c("n_profile"), (5, 1.0), (3, 0.75), (1, 0.45), other=0.05),
          "build-third-party-presence", 0.75, ("profiles",), token="profile"),
    Check("contact-signals", "authority", 4, lambda: (
        _c("any_phone").cast("int") + _c("any_street").cast("int") + _c("any_email").cast("int")) / 3.0,
          "publish-nap", 1.0, ("phone", "street", "email"),
          maxima=lambda: {"any_phone": _c("phone"), "any_street": _c("street"), "any_email": _c("email")}),
    Check("authorship", "authority", 3, lambda: F.when(_c("any_author_ld"), 1.0)
          .when(_c("any_author_meta"), 0.7).when(_c("any_byline"), 0.45).otherwise(0.1),
          "add-authorship", 0.7, ("author_ld", "author_meta", "byline"), maxima=lambda: {
              "any_author_ld": _c("author_ld"), "any_author_meta": _c("author_meta"), "any_byline": _c("byline")}),
    Check("entity-clarity", "content", 5,
          lambda: F.when(_c("home_ok"), _c("clarity")).otherwise(0.3), "clarify-entity", 0.8,
          ("home",), token="home"),
]
BY_ID = {c.id: c for c in CHECKS}


def _site_facts(sites: DataFrame, need: set[str], as_of: Column) -> DataFrame:
    """Facts known per site without reading pages."""
    robots = F.coalesce("robots_txt", F.lit(""))
    llms = F.coalesce("llms_txt", F.lit(""))
    out = sites.select(
        "host", as_of.alias("as_of"), (robots != "").alias("has_robots"),
        robots.rlike(rf"(?i)(?:^|\n){WS}*sitemap:").alias("robots_sitemap"),
        (llms != "").alias("has_llms"),
        ((F.regexp_count(llms, F.lit(r"\]\(")) >= 3) & llms.rlike(rf"(?m)^#{WS}+[^\s]")).alias("llms_routes"),
        F.size("sitemap_urls").alias("n_sitemap"),
        F.startswith("origin", F.lit("https://")).alias("secure"))
    if "ai-crawler-access" in need:
        access = audit_ai_access(sites).groupBy("host").agg(
            F.avg(F.when(F.col("critical"), F.col("allowed").cast("int"))).alias("critical_allowed"),
            F.count_if(~F.col("allowed")).alias("blocked_crawlers"))
        out = out.join(access, "host", "left")
    return out


# what each token counts, from a page's features
TOKENS: dict[str, Callable[[], Column]] = {
    "compare": lambda: F.when(_c("compares"), F.array("url")),
    "profile": lambda: F.filter("profiles", lambda p: p != ""),
    "words": lambda: F.when(_c("ok"), F.array(F.lpad(_c("words").cast("string"), 10, "0"))),
    # the home page's lead is a token too: as a key it leaves the sums hash-aggregated
    "home": lambda: F.when(_c("home").isNotNull(), F.array("home")),
}


def _token_rows(kind: str, values: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.transform(F.coalesce(values, empty), lambda v: F.struct(
        F.lit(kind).alias("kind"), v.alias("value")))


def _median(histogram: Column, half: Column) -> Column:
    """Value at 0-based position ``half`` of a sorted histogram of (value, n)."""
    done = F.aggregate(
        F.array_sort(histogram), F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("string").alias("v")),
        lambda acc, h: F.when(acc["v"].isNotNull() | (acc["seen"] + h["n"] <= half), F.struct(
            (acc["seen"] + h["n"]).alias("seen"), acc["v"].alias("v"))).otherwise(F.struct(
                acc["seen"].alias("seen"), h["value"].alias("v"))))
    return done["v"].cast("int")


def _per_host(pages: DataFrame, sites: DataFrame, chosen: list[Check]) -> DataFrame | None:
    """Everything the chosen checks need of a host's pages, from one pass over the pages."""
    names = list(dict.fromkeys(f for c in chosen for f in c.features))
    if not names:
        return None
    sums: dict[str, Column] = {}
    maxima: dict[str, Column] = {}
    for c in chosen:
        sums |= c.sums()
        maxima |= c.maxima()
    kinds = [c.token for c in chosen if c.token]
    rows = page_features(pages, names)
    plain = [e.alias(n) for n, e in (sums | maxima).items()]
    total = [F.sum(n).alias(n) for n in sums] + [F.max(n).alias(n) for n in maxima]
    if not kinds:
        return rows.select("host", *plain).groupBy("host").agg(*total)
    # one plain row per page carries the sums; every token is a row of its own
    tokens = F.concat(
        F.array(F.struct(F.lit("page").alias("kind"), F.lit("").alias("value"))),
        *[_token_rows(k, TOKENS[k]()) for k in kinds])
    wide = rows.select("host", *plain, F.explode_outer(tokens).alias("t"))
    on_page = F.col("t.kind") == "page"
    measured = wide.select("host", "t.kind", "t.value", *[
        F.when(on_page, F.col(n)).alias(n) for n in (*sums, *maxima)])
    if "compare" in kinds:
        rx = "(?i)" + "|".join(f"(?:{p})" for p in COMPARISON)
        listed = sites.select("host", F.lit("compare").alias("kind"), F.explode("sitemap_urls").alias("value"))
        measured = measured.unionByName(
            listed.where(path_or_self("value").rlike(rx)), allowMissingColumns=True)
    by_token = measured.groupBy("host", "kind", "value").agg(*total, F.count(F.lit(1)).alias("n"))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds if k in ("compare", "profile")]
    if "home" in kinds:
        counts.append(F.max(F.when(F.col("kind") == "home", F.col("value"))).alias("home"))
    hist = [] if "words" not in kinds else [F.collect_list(
        F.when(F.col("kind") == "words", F.struct("value", "n"))).alias("_hist")]
    out = by_token.groupBy("host").agg(*total, *counts, *hist)
    if hist:  # as long as the number of different word counts, not of pages
        out = out.withColumn("median_words", _median(F.col("_hist"), F.floor(F.col("n_ok") / 2))).drop("_hist")
    return out


def clarity(hosts: DataFrame, brands: DataFrame) -> DataFrame:
    """Adds ``clarity``: does the home page's lead say who, what and where.

    ``hosts`` carries ``home``: '1' or '0' (fetched or not) and the lead after it.
    ``brands``: host, name, category_text, location.
    """
    lead = F.substr("home", F.lit(2))
    words = brands.select(
        "host", F.split(T.normalise("name"), f"{WS}+").alias("names"),
        F.filter(F.split(T.normalise("category_text"), f"{WS}+"), lambda w: F.length(w) > 3).alias("cats"),
        (F.coalesce("location", F.lit("")) == "").alias("anywhere"),
        F.split(T.normalise("location"), rf"(?:{WS}|,)+").alias("places"))
    inside = lambda w: F.contains(lead, w)
    named = F.coalesce(F.forall("names", lambda w: (F.length(w) < 3) | inside(w)), F.lit(True))
    cat = F.when(F.size("cats") > 0, F.size(F.filter("cats", inside)) / F.size("cats")).otherwise(1.0)
    placed = F.coalesce("anywhere", F.lit(True)) | F.exists("places", lambda w: (F.length(w) > 2) & inside(w))
    score = F.when(named, 0.4).otherwise(0.0) + cat * 0.4 + F.when(placed, 0.2).otherwise(0.0)
    return hosts.join(words, "host", "left").withColumns({
        "clarity": score, "home_ok": F.coalesce(F.startswith("home", F.lit("1")), F.lit(False))}).drop(
        "names", "cats", "anywhere", "places")


def run_checks(
    sites: DataFrame, pages: DataFrame, brands: DataFrame, as_of: Column | None = None,
    only: list[str] | None = None,
) -> DataFrame:
    """All checks (or those named) per host, long form.

    Columns: host, check_ord, check_id, pillar, weight, score, status, fix_id.
    """
    chosen = [c for c in CHECKS if only is None or c.id in only]
    need = {c.id for c in chosen}
    base = _site_facts(sites, need, F.current_timestamp() if as_of is None else as_of)
    facts = _per_host(pages, sites, chosen)
    if facts is not None:
        base = base.join(facts, "host", "left")
        base = base.withColumns(
            {c: F.coalesce(F.col(c), F.lit(0)) for c in facts.columns if c.startswith("n_")}
            | {c: F.coalesce(F.col(c), F.lit(False)) for c in facts.columns if c.startswith("any_")})
    if "contact-signals" in need:
        seams = across_pages(pages).select("host", F.col("phone").alias("seam_phone"), F.col("street").alias("seam_street"))
        held = lambda c: F.coalesce(F.col(c), F.lit(False))
        base = base.join(seams, "host", "left").withColumns({
            "any_phone": held("any_phone") | held("seam_phone"), "any_street": held("any_street") | held("seam_street")})
    if "freshness" in need:
        base = base.withColumn("age_days", F.floor(
            (F.col("as_of").cast("double") - F.col("newest").cast("double")) / 86400))
    if "entity-clarity" in need:
        base = clarity(base, brands)

    def row(c: Check) -> Column:
        score = clamp(c.score().cast("double"), 0.0, 1.0)
        raise_fix = score < c.fix_below
        if c.id == "ai-crawler-access":
            raise_fix = F.col("blocked_crawlers") > 0
        elif c.id == "entity-clarity":
            raise_fix = raise_fix & F.col("home_ok")
        elif c.id == "response-speed":
            raise_fix = raise_fix & (F.col("n_timed") > 0)
        elif c.needs_pages:
            raise_fix = raise_fix & (F.col("n_ok") > 0)
        return F.struct(
            F.lit(CHECKS.index(c)).alias("check_ord"), F.lit(c.id).alias("check_id"),
            F.lit(c.pillar).alias("pillar"), F.lit(c.weight).alias("weight"),
            score.alias("score"), status_for(score).alias("status"),
            F.when(raise_fix, c.fix).alias("fix_id"))

    # the outer form keeps Spark from adding a size filter that would score everything twice
    return base.select("host", F.inline_outer(F.array(*[row(c) for c in chosen])))


#: checks of single pages: the features they read and when a page fails
PAGE_FAILS: dict[str, tuple[list[str], Callable[[], Column]]] = {
    "server-rendering": (["shell", "words"], lambda: _c("shell") | (_c("words") < 120)),
    **{c: ([f], lambda f=f: ~_c(f)) for c, f in {
        "canonical": "canonical", "jsonld-present": "has_ld", "heading-hierarchy": "good_outline", "semantic-html": "landmark",
        "meta-description": "described", "answer-capsule": "capsule", "quotable-stats": "quotable"}.items()},
}


def failing_pages(pages: DataFrame, only: list[str] | None = None, keep: int = 5) -> DataFrame:
    """Evidence of the checks of single pages: host, check_id, URLs of the first fetched pages that fail.

    One pass over the pages; the group limit keeps ``keep`` rows a host and check on the map side.
    """
    chosen = [c for c in PAGE_FAILS if only is None or c in only]
    names = list(dict.fromkeys(["ok", *(f for c in chosen for f in PAGE_FAILS[c][0])]))
    rows = page_features(pages, names).where("ok").select("host", "page_ord", "url", F.explode_outer(F.array_compact(F.array(
        *[F.when(F.coalesce(PAGE_FAILS[c][1](), F.lit(False)), c) for c in chosen]))).alias("check_id")).where("check_id IS NOT NULL")
    first = Window.partitionBy("host", "check_id").orderBy("page_ord", "url")
    kept = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= keep)
    listed = F.array_sort(F.collect_list(F.struct("place", "url")))
    return kept.groupBy("host", "check_id").agg(F.transform(listed, lambda x: x["url"]).alias("evidence"))


def score_readiness(checks: DataFrame) -> DataFrame:
    """Pillar and overall scores per host (I28) in a single aggregate."""
    sums = []
    for p in fixed.PILLAR_WEIGHTS:
        mine = F.col("pillar") == p
        sums += [F.sum(F.when(mine, F.col("score") * F.col("weight"))).alias(f"{p}_s"),
                 F.sum(F.when(mine, F.col("weight"))).alias(f"{p}_w")]
    agg = checks.groupBy("host").agg(
        *sums, *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "warn", "fail")],
        F.count(F.lit(1)).alias("n_total"))
    value = {p: ratio(F.coalesce(F.col(f"{p}_s"), F.lit(0.0)), F.coalesce(F.col(f"{p}_w"), F.lit(0)))
             for p in fixed.PILLAR_WEIGHTS}
    present = {p: F.when(F.col(f"{p}_w").isNotNull(), w).otherwise(0.0)
               for p, w in fixed.PILLAR_WEIGHTS.items()}
    top = sum((value[p] * present[p] for p in value), F.lit(0.0))
    bottom = sum(present.values(), F.lit(0.0))
    return agg.select(
        "host", round_half_up(ratio(top, bottom)).alias("overall"),
        *[round_half_up(v).alias(p) for p, v in value.items()],
        "n_pass", "n_warn", "n_fail", "n_total")


def blocked_reason(sites: DataFrame) -> Column:
    return F.when(F.col("robots_blocked"), "robots").otherwise(F.coalesce("error", F.lit("no usable response")))


def assess_readiness(sites: DataFrame, checks: DataFrame) -> DataFrame:
    """Readiness per host (I29): blocked hosts carry null scores and the reason, never zeros.

    ``checks`` are the rows of ``run_checks``; those of blocked hosts are dropped here, where
    only narrow per-host rows meet.
    """
    open_hosts = sites.where(F.col("reachable") & ~F.col("robots_blocked")).select("host")
    scores = score_readiness(checks.join(open_hosts, "host", "left_semi"))
    blocked = ~F.col("reachable") | F.col("robots_blocked")
    return sites.join(scores, "host", "left").select(
        "host", blocked.alias("blocked"), F.when(blocked, F.col("robots_blocked")).otherwise(False).alias("robots_blocked"),
        F.when(blocked, blocked_reason(sites)).otherwise("").alias("blocked_reason"),
        "overall", *fixed.PILLAR_WEIGHTS,
        *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_pass", "n_warn", "n_fail", "n_total")])
