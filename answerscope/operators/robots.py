"""robots.txt as tables: parsing, group choice, path rules, access audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerscope import fixed
from answerscope.functions.core import rx_quote, trim_ws
from answerscope.functions.urls import path_of


def crawler_rows() -> Column:
    """The eleven crawlers that feed assistants, as a literal array to ``inline``."""
    return F.array(*[F.struct(
        F.lit(i).alias("crawler_ord"), F.lit(ua).alias("ua"), F.lit(label).alias("label"),
        F.lit(critical).alias("critical")) for i, (ua, label, critical) in enumerate(fixed.CRAWLERS)])


def all_crawlers() -> list[str]:
    return [ua for ua, _, _ in fixed.CRAWLERS]


def parse_robots(sites: DataFrame) -> DataFrame:
    """Directives of every robots.txt (D1): host, group_id, line_no, kind, value.

    ``kind`` is agent, allow or disallow.  Consecutive user-agent lines share a group; any
    other field ends the run of agents; rules before the first group are ignored.  The
    window runs over the lines of one file.
    """
    lines = sites.where(F.col("robots_txt").isNotNull()).select(
        "host", F.posexplode(F.split("robots_txt", "\r?\n")).alias("line_no", "raw"))
    line = trim_ws(F.regexp_replace("raw", "#.*$", ""))
    fields = lines.select("host", "line_no", line.alias("line")).where(
        F.instr("line", ":") > 1).select(
        "host", "line_no",
        F.lower(trim_ws(F.substring_index("line", ":", 1))).alias("field"),
        trim_ws(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    by_line = Window.partitionBy("host").orderBy("line_no")
    is_agent = F.col("field") == "user-agent"
    opens = is_agent & ~F.coalesce(F.lag(is_agent).over(by_line), F.lit(False))
    grouped = fields.withColumn("opens", opens).withColumn(
        "group_id", F.sum(F.col("opens").cast("int")).over(
            by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.where(
        (F.col("group_id") > 0) & F.col("field").isin("user-agent", "allow", "disallow")
    ).select(
        "host", "group_id", "line_no",
        F.when(is_agent, "agent").otherwise(F.col("field")).alias("kind"),
        F.when(is_agent, F.lower("value")).otherwise(F.col("value")).alias("value"))


def group_for(directives: DataFrame, agents: list[str]) -> DataFrame:
    """The group that speaks to each user agent (D2): host, ua, group_id.

    Longest matching agent wins, the first on ties; '*' and an empty agent count as length
    0.  ``agents`` is a literal handful, tested inside the row of each robots agent line, and
    the best line is an argmax with map-side partials.
    """
    tested = directives.where("kind = 'agent'").select(
        "host", "group_id", "line_no", F.col("value").alias("agent"),
        F.explode(F.array(*map(F.lit, agents))).alias("ua"))
    low = F.lower("ua")
    hit = (F.col("agent") == "*") | F.startswith(low, F.col("agent")) | F.startswith(F.col("agent"), low)
    strength = F.struct(
        F.when(F.col("agent") == "*", 0).otherwise(F.length("agent")).alias("len"),
        (-F.col("line_no")).alias("early"))
    return tested.where(hit).groupBy("host", "ua").agg(F.max_by("group_id", strength).alias("group_id"))


def path_matches(pattern: Column, path: Column) -> Column:
    """Whether a robots path pattern covers a path (D3)."""
    anchored = F.endswith(pattern, F.lit("$"))
    body = F.regexp_replace(pattern, r"\$$", "")
    regex = F.concat(
        F.lit("(?s)^"), F.replace(rx_quote(body), F.lit("*"), F.lit("\\E[^\n\r]*\\Q")),
        F.when(anchored, "$").otherwise(""))
    plain = F.when(anchored, path == body).otherwise(F.startswith(path, body))
    return (
        F.when(pattern == "", False).when(pattern == "/", True)
        .when(F.contains(body, F.lit("*")), F.rlike(path, regex)).otherwise(plain))


def allowed_by(rules: Column, path: Column) -> Column:
    """Verdict of a group's rules on a path (D4): longest wins, ties allow, none allows."""
    live = F.filter(rules, lambda r: ~((r["kind"] == "disallow") & (r["value"] == "")) & path_matches(r["value"], path))
    best = F.array_max(F.transform(live, lambda r: F.struct(
        F.length(r["value"]).alias("len"), (r["kind"] == "allow").alias("ok"))))
    return F.coalesce(best["ok"], F.lit(True))


def rules_for(directives: DataFrame, agents: list[str]) -> DataFrame:
    """Rules per host and user agent as one array (at most one robots.txt long)."""
    rules = directives.where("kind <> 'agent'").groupBy("host", "group_id").agg(
        F.collect_list(F.struct("kind", "value")).alias("rules"))
    return group_for(directives, agents).join(rules, ["host", "group_id"], "left").select(
        "host", "ua", F.coalesce(
            "rules", F.array().cast("array<struct<kind:string,value:string>>")).alias("rules"))


def is_allowed(targets: DataFrame, directives: DataFrame, agents: list[str]) -> DataFrame:
    """Verdict of every agent on every target (host, path).

    The few rules of a host are gathered per agent into one row before they meet the
    targets, so targets multiply by the literal agents only, never by rules.
    """
    wide = targets.withColumn("ua", F.explode(F.array(*map(F.lit, agents))))
    verdicts = rules_for(directives, agents)
    return wide.join(verdicts, ["host", "ua"], "left").withColumn(
        "allowed", F.coalesce(allowed_by(F.col("rules"), F.col("path")), F.lit(True))).drop("rules")


def audit_ai_access(sites: DataFrame) -> DataFrame:
    """Host x crawler: may it fetch the root, is it named."""
    directives = parse_robots(sites)
    verdicts = rules_for(directives, all_crawlers())
    named = directives.where("kind = 'agent'").groupBy("host").agg(F.collect_set("value").alias("named"))
    return (
        sites.select("host", F.inline(crawler_rows()))
        .join(verdicts, ["host", "ua"], "left").join(named, "host", "left")
        .select("host", "crawler_ord", "ua", "label", "critical",
                F.coalesce(allowed_by(F.col("rules"), F.lit("/")), F.lit(True)).alias("allowed"),
                F.coalesce(F.array_contains("named", F.lower("ua")), F.lit(False)).alias("explicit")))


def crawl_permission(urls: DataFrame, sites: DataFrame, agent: str) -> DataFrame:
    """Candidate URLs (host, url) with our own agent's permission.

    A host's rules travel as one small array to its URLs; rows never multiply by rules.
    """
    verdicts = rules_for(parse_robots(sites), [agent]).drop("ua")
    joined = urls.join(verdicts, "host", "left")
    verdict = F.coalesce(allowed_by(F.col("rules"), path_of("url")), F.lit(True))
    site = F.coalesce(allowed_by(F.col("rules"), F.lit("/")), F.lit(True))
    return joined.select(*urls.columns, verdict.alias("allowed"), (~site).alias("site_blocked"))


def permission_summary(checked: DataFrame) -> DataFrame:
    """Skipped URLs and site-wide blocks per host."""
    return checked.groupBy("host").agg(
        F.count_if("allowed").alias("kept"), F.count_if(~F.col("allowed")).alias("skipped"),
        F.max("site_blocked").alias("site_blocked"))
