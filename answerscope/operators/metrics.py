"""Visibility metrics over outcomes.

Input is the wide outcome table of ``mentions.score_answers``: run_id, brand_key, engine,
prompt_id, prompt_text, intent, lang, weight, status, ord, citations, mentions, brand,
own_cited, score.  All groups are reduced map-side first; nothing collects a group of
answers into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerscope import fixed
from answerscope.functions.core import lookup, ratio, round_half_up
from answerscope.functions.urls import host_of, strip_www

RUN = ["run_id", "brand_key"]
QUESTION = [*RUN, "engine", "prompt_id"]


def answered(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("status") == "answered")


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def job_matrix(engines: DataFrame, prompts: DataFrame, samples: Column | int = 1) -> DataFrame:
    """Every (engine, prompt, sample) that should have an answer (E5).

    Engines pair with prompts inside one brand, through an equi join on ``brand_key``.
    """
    n = F.least(F.lit(fixed.MAX_SAMPLES), F.greatest(
        F.lit(1), F.floor(F.lit(samples) if not isinstance(samples, Column) else samples))).cast("int")
    return engines.join(prompts, "brand_key").select(
        *engines.columns, *[c for c in prompts.columns if c != "brand_key"],
        F.explode(F.sequence(F.lit(0), n - 1)).alias("sample"))


def missing_jobs(matrix: DataFrame, answers: DataFrame) -> DataFrame:
    """Jobs of the matrix without an answer row (E5)."""
    keys = ["brand_key", "engine", "prompt_id", "sample"]
    return matrix.join(answers.select(keys), keys, "left_anti")


def failures(outcomes: DataFrame) -> DataFrame:
    """Failed calls per run with the first three distinct messages."""
    failed = outcomes.where(F.col("status") != "answered")
    per_error = failed.groupBy(*RUN, "error").agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    top = Window.partitionBy(*RUN).orderBy("first_ord", "error")
    totals = per_error.groupBy(*RUN).agg(
        F.sum("n").alias("failed"), F.count(F.lit(1)).alias("distinct_errors"))
    kept = per_error.withColumn("pos", F.row_number().over(top)).where("pos <= 3")
    messages = kept.groupBy(*RUN).agg(F.array_sort(F.collect_list(
        F.struct("pos", "error"))).alias("e")).select(
        *RUN, F.transform("e", lambda x: x["error"]).alias("errors"))
    return totals.join(messages, RUN)


def outcomes_wide(outcomes: DataFrame, names: list[str]) -> DataFrame:
    """Export shape (E7): one column per competitor, citations space-joined, no rank when 0.

    The competitor flags are read out of the mentions array; no pivot, no shuffle.
    """
    def flag(name: str) -> Column:
        return F.exists("mentions", lambda m: (m["name"] == name) & ~m["is_brand"] & m["mentioned"])

    def safe(name: str) -> str:
        out = "".join(c if c.isascii() and c.isalnum() else " " for c in name)
        lead = "_" if name and out[:1] == " " else ""
        tail = "_" if name and out[-1:] == " " else ""
        return "mentioned_" + lead + "_".join(out.split()).lower() + tail

    return outcomes.select(
        "run_id", "brand_key", "engine", "intent", "weight", "prompt_text", "status", "ord",
        F.col("brand.mentioned").alias("brand_mentioned"),
        F.when(F.col("brand.rank") > 0, F.col("brand.rank").cast("string"))
        .otherwise("").alias("brand_rank"),
        F.col("brand.sentiment").alias("brand_sentiment"), "own_cited",
        *[flag(n).alias(safe(n)) for n in names],
        F.array_join(F.coalesce("citations", F.array().cast("array<string>")), " ").alias("citations"))


def margin_of_error(rate: Column, n: Column) -> Column:
    """Half width of the 95% interval of a rate (F2)."""
    half = 1.96 * F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.0)) / F.nullif(n, F.lit(0)))
    return F.coalesce(half, F.lit(0.0))


def summarise(outcomes: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Headline numbers per run (F1, F2).  ``runs`` keeps runs without any outcome."""
    ok = F.col("status") == "answered"
    named = ok & F.col("brand.mentioned")
    role = F.col("brand.role")
    w = F.when(ok, F.col("weight"))
    sums = outcomes.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("prompts_run"), _n(ok).alias("prompts_answered"),
        F.sum(F.col("score") * w).alias("_sw"), F.sum(w).alias("_w"),
        _n(named).alias("mentions"),
        _n(ok & (role == "recommended")).alias("_rec"),
        _n(ok & (role == "dismissed")).alias("dismissed_count"),
        _n(ok & F.col("own_cited")).alias("_cited"),
        *[_n(named & (role == r)).alias(f"role_{r}") for r in fixed.ROLE_WEIGHTS],
        F.avg(F.when(ok & (F.col("brand.rank") > 0), F.col("brand.rank"))).alias("_rank"),
        F.avg(F.when(named, F.col("brand.sentiment"))).alias("_tone"))
    if runs is not None:
        sums = runs.select(*RUN).join(sums, RUN, "left")
    zero = F.lit(0)
    c = {n: F.coalesce(F.col(n), zero) for n in sums.columns if n not in RUN}
    n = c["prompts_answered"]
    rate = ratio(c["mentions"], n)
    return sums.select(
        *RUN, c["prompts_run"].alias("prompts_run"), n.alias("prompts_answered"),
        (c["prompts_run"] - n).alias("prompts_failed"),
        round_half_up(ratio(c["_sw"], c["_w"])).alias("score"),
        round_half_up(margin_of_error(rate, n)).alias("margin_of_error"),
        c["mentions"].alias("mentions"), round_half_up(rate).alias("mention_rate"),
        round_half_up(ratio(c["_rec"], n)).alias("recommendation_rate"),
        round_half_up(ratio(c["_cited"], n)).alias("citation_rate"),
        c["dismissed_count"].alias("dismissed_count"),
        *[c[f"role_{r}"].alias(f"role_{r}") for r in fixed.ROLE_WEIGHTS],
        round_half_up(ratio(c["_rec"], c["mentions"])).alias("influence_ratio"),
        round_half_up(c["_rank"], 2).alias("avg_rank"),
        round_half_up(c["_tone"], 2).alias("avg_sentiment"))


def share_of_voice(outcomes: DataFrame, entities: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Mentions of each tracked entity and its share of all mentions."""
    per_entity = (
        # outer: otherwise Spark infers a size filter and evaluates the mentions twice
        answered(outcomes).select(*RUN, F.explode_outer("mentions").alias("m"))
        .where("m.mentioned").groupBy(*RUN, F.col("m.entity_ord").alias("entity_ord"))
        .agg(F.count(F.lit(1)).alias("n")))
    base = (runs if runs is not None else outcomes).select(*RUN).distinct()
    every = base.join(entities.select("brand_key", "entity_ord", "name", "is_brand"), "brand_key")
    rows = every.join(per_entity, [*RUN, "entity_ord"], "left").withColumn(
        "count", F.coalesce("n", F.lit(0)))
    total = F.sum("count").over(Window.partitionBy(*RUN))
    return rows.select(
        *RUN, "entity_ord", "name", "is_brand", "count",
        round_half_up(ratio(F.col("count"), total)).alias("share"))


def _breakdown(outcomes: DataFrame, key: str, *more: Column) -> DataFrame:
    return answered(outcomes).groupBy(*RUN, key).agg(
        F.count(F.lit(1)).alias("total"), _n(F.col("brand.mentioned")).alias("mentions"),
        F.sum("score").alias("_s"), F.min("ord").alias("first_ord"), *more).withColumns({
            "score": round_half_up(ratio(F.col("_s"), F.col("total"))),
            "rate": round_half_up(ratio(F.col("mentions"), F.col("total")))}).drop("_s")


def by_intent(outcomes: DataFrame) -> DataFrame:
    """Visibility per intent class (F4); order by total desc, first_ord."""
    return _breakdown(outcomes, "intent").withColumn(
        "label", lookup(F.col("intent"), fixed.INTENT_LABELS, F.col("intent")))


def by_language(outcomes: DataFrame) -> DataFrame:
    """Visibility per language (F5); nothing for runs asked in one language only."""
    rows = _breakdown(outcomes, "lang", _n(F.col("brand.role") == "recommended").alias("recommended"))
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*RUN))).where("_n > 1").drop("_n")


def by_engine(outcomes: DataFrame) -> DataFrame:
    """Visibility per engine (F6); order by score desc, first_ord."""
    return _breakdown(outcomes, "engine", _n(F.col("own_cited")).alias("cited"))


def breakdowns(outcomes: DataFrame) -> DataFrame:
    """F4-F6 in one pass with GROUPING SETS over (intent), (lang), (engine)."""
    dims = ["intent", "lang", "engine"]
    sets = answered(outcomes).groupingSets(
        [[*RUN, d] for d in dims], *RUN, *dims).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("total"),
        _n(F.col("brand.mentioned")).alias("mentions"), F.sum("score").alias("_s"))
    # the lowest three bits of the grouping id tell which of the dimensions is present
    present = {"intent": 3, "lang": 5, "engine": 6}
    name = F.when(F.lit(False), "")
    member = F.when(F.lit(False), "")
    for d, bits in present.items():
        hit = (F.col("_gid").bitwiseAND(7)) == bits
        name, member = name.when(hit, d), member.when(hit, F.col(d))
    return sets.select(
        *RUN, name.alias("dimension"), member.alias("member"), "total", "mentions",
        round_half_up(ratio(F.col("_s"), F.col("total"))).alias("score"),
        round_half_up(ratio(F.col("mentions"), F.col("total"))).alias("rate"))


def prompt_stability(outcomes: DataFrame, samples: int = 2) -> DataFrame:
    """How often the brand came back per question and engine (F7); empty for single samples."""
    rows = answered(outcomes).where(F.lit(samples > 1)).groupBy(*QUESTION).agg(
        F.count(F.lit(1)).alias("asked"), _n(F.col("brand.mentioned")).alias("named"),
        F.min("ord").alias("first_ord"))
    rate = ratio(F.col("named"), F.col("asked"))
    return rows.withColumns({
        "rate": round_half_up(rate),
        "stability": F.when(F.col("named") == 0, "absent")
        .when(F.col("named") == F.col("asked"), "locked").otherwise("contested")})


def contested_count(stability: DataFrame) -> DataFrame:
    """Questions per run on which the brand comes and goes."""
    return stability.groupBy(*RUN).agg(F.count_if(F.col("stability") == "contested").alias("contested"))


def find_gaps(outcomes: DataFrame) -> DataFrame:
    """Questions lost to competitors, with the winners in order of first win (F8).

    One pass: answers become one row per winner (or a single row without one), reduced by
    (question, winner) and then by question.  The gathered list of winners is as long as the
    competitor list, however many samples a question has.
    """
    rivals = F.filter("mentions", lambda m: ~m["is_brand"] & m["mentioned"])
    won_by = F.when(~F.col("brand.mentioned"), F.transform(
        rivals, lambda m: F.struct(m["name"].alias("name"), m["rank"].alias("rank"))))
    rows = answered(outcomes).select(
        *QUESTION, "prompt_text", "intent", "weight", "ord", F.posexplode_outer(won_by).alias("i", "w"))
    once = F.col("i").isNull() | (F.col("i") == 0)  # one of an answer's rows counts the answer
    per_winner = rows.groupBy(*QUESTION, F.col("w.name").alias("name")).agg(
        F.min_by(F.struct("prompt_text", "intent", "weight"), "ord").alias("q"), _n(once).alias("asked"),
        _n(F.col("i") == 0).alias("lost"), F.min("ord").alias("first_ord"),
        F.min(F.struct("ord", F.col("w.rank").alias("rank"))).alias("first"))
    gathered = F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct(
        F.col("first.ord"), F.col("first.rank"), "name"))))
    found = per_winner.groupBy(*QUESTION).agg(
        F.min_by("q", "first_ord").alias("q"), F.sum("asked").alias("asked"), F.sum("lost").alias("lost"),
        F.min("first_ord").alias("first_ord"), gathered.alias("w")).where("lost > 0")
    loss = round_half_up(ratio(F.col("lost"), F.col("asked")))
    return found.select(
        *QUESTION, "q.prompt_text", "q.intent", "q.weight", "asked", "lost",
        loss.alias("loss_rate"), F.transform("w", lambda x: x["name"]).alias("winners"),
        (F.col("q.weight") * loss).alias("sort_key"), "first_ord")


#: width in answer order of the ranges within which wins are numbered, so that no window holds a whole question
WIN_RANGE = 10_000


def find_wins(outcomes: DataFrame) -> DataFrame:
    """Questions where the brand is named first.

    The sentiment is a running half-fold s <- (s + x)/2 in answer order: a weighted sum in which
    the newest win counts 1/2, the one before 1/4 and so on, the oldest as much as the one after
    it.  A win's number from the end is its number within a range of answers plus the wins of
    later ranges; the sum combines map-side, all wins taking part.
    """
    won = answered(outcomes).where(F.col("brand.mentioned") & (F.col("brand.rank") == 1)).withColumn("part", F.floor(F.col("ord") / WIN_RANGE))
    parts = won.groupBy(*QUESTION, "part").agg(
        F.min_by(F.struct("prompt_text", "intent"), "ord").alias("q"),
        F.count(F.lit(1)).alias("n"), F.max("own_cited").alias("cited"), F.min("ord").alias("first_ord"))
    question = Window.partitionBy(*QUESTION)
    later = question.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"later": F.coalesce(F.sum("n").over(later), F.lit(0)), "won": F.sum("n").over(question)})
    newest = Window.partitionBy(*QUESTION, "part").orderBy(F.col("ord").desc(), F.col("brand.sentiment").desc())
    numbered = won.select(*QUESTION, "part", F.col("brand.sentiment").alias("s"), F.row_number().over(newest).alias("k")).join(
        parts.select(*QUESTION, "part", "later", "won"), [*QUESTION, "part"])
    back = F.least(F.col("k") + F.col("later"), F.greatest(F.col("won") - 1, F.lit(1)))
    weight = F.when(F.col("won") == 1, 1.0).otherwise(F.pow(F.lit(2.0), -back))
    tones = numbered.groupBy(*QUESTION).agg(F.sum(F.col("s") * weight).alias("sentiment"))
    facts = parts.groupBy(*QUESTION).agg(
        F.min_by("q", "first_ord").alias("q"), F.sum("n").alias("won"), F.max("cited").alias("cited"), F.min("first_ord").alias("first_ord"))
    return facts.join(tones, QUESTION).select(
        *QUESTION, "q.prompt_text", "q.intent", "won", "sentiment", "cited", "first_ord")


def citation_credits(outcomes: DataFrame) -> DataFrame:
    """One credit per host and answer: run, brand, ord, pos, host."""
    hosts = F.array_distinct(F.filter(
        F.transform("citations", lambda u: host_of(u)), lambda h: h != ""))
    return answered(outcomes).select(
        *RUN, "ord", F.posexplode_outer(hosts).alias("pos", "host")).where("host IS NOT NULL")


def host_counts(outcomes: DataFrame) -> DataFrame:
    """Credits per host, with the place it was first cited for stable ordering."""
    return citation_credits(outcomes).groupBy(*RUN, "host").agg(
        F.count(F.lit(1)).alias("count"), F.min(F.struct("ord", "pos")).alias("first_cited"))


def entity_hosts(entities: DataFrame) -> DataFrame:
    """Hosts of brand and competitors: one row per brand_key and host."""
    return (
        entities.where(F.coalesce("domain", F.lit("")) != "")
        .select("brand_key", strip_www("domain").alias("host"), "is_brand")
        .groupBy("brand_key", "host").agg(
            F.max("is_brand").alias("is_own"), F.max(~F.col("is_brand")).alias("is_competitor")))


def citation_domains(outcomes: DataFrame, entities: DataFrame, keep: int = fixed.DOMAINS_KEPT) -> DataFrame:
    """Most cited hosts of a run."""
    w = Window.partitionBy(*RUN).orderBy(F.col("count").desc(), "first_cited")
    top = host_counts(outcomes).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= keep)
    return top.join(entity_hosts(entities), ["brand_key", "host"], "left").select(
        *RUN, "pos", F.col("host").alias("domain"), "count",
        F.coalesce("is_own", F.lit(False)).alias("is_own"),
        F.coalesce("is_competitor", F.lit(False)).alias("is_competitor"))


def distinct_counts(outcomes: DataFrame, approximate: bool = False) -> DataFrame:
    """Unique domains and distinct errors per run (F11); exact unless asked otherwise."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    domains = citation_credits(outcomes).groupBy(*RUN).agg(count("host").alias("unique_domains"))
    errors = outcomes.groupBy(*RUN).agg(
        count(F.when(F.col("status") != "answered", F.col("error"))).alias("distinct_errors"))
    return errors.join(domains, RUN, "left").withColumn(
        "unique_domains", F.coalesce("unique_domains", F.lit(0)))


#: precision of stored sketches: a relative standard error of 1.04 / sqrt(2 ** 12), 1.6 %
SKETCH_BITS = 12


def distinct_sketches(outcomes: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """Stored sketches of a run's distinct hosts and errors (F11): a few KB each, one row per run.

    Written beside the outcomes of each run, they answer how many different hosts or errors any set of
    runs or brands had (``distinct_estimates``) without reading an answer again.  Exact counts do not
    add up over runs, sketches do.  A run without citations or errors has empty sketches.
    """
    errors = outcomes.groupBy(*RUN).agg(F.hll_sketch_agg(F.when(F.col("status") != "answered", F.col("error")), bits).alias("errors"))
    hosts = citation_credits(outcomes).groupBy(*RUN).agg(F.hll_sketch_agg("host", bits).alias("hosts"))
    return errors.join(hosts, RUN, "left")


def distinct_estimates(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Estimated distinct hosts and errors of each group of runs, by merging their sketches."""
    merged = sketches.groupBy(*by).agg(F.hll_union_agg("hosts").alias("hosts"), F.hll_union_agg("errors").alias("errors"))
    size = lambda c: F.coalesce(F.hll_sketch_estimate(c), F.lit(0).cast("long"))
    return merged.select(*by, size("hosts").alias("unique_domains"), size("errors").alias("distinct_errors"))
