"""Prompt sets for all brands at once (H1-H3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerscope import fixed
from answerscope.functions.core import WS, hash_id, lookup, trim_ws
from answerscope.plans.joins import join_dimension
from answerscope.sources.brands import text_of

# Our own starter bank; callers pass their own table (lang, intent, template_ord, template).
STARTER_TEMPLATES = [
    ("en", "commercial_investigation", "Which {cat} would you pick today?"),
    ("en", "commercial_investigation", "Name good {cat} for {aud}."),
    ("en", "local", "Where do I find {cat} around {loc}?"),
    ("en", "comparison", "How does {brand} compare with {comp}?"),
    ("en", "alternative", "What could replace {comp}?"),
    ("en", "pricing", "What should {cat} cost?"),
    ("en", "problem", "How do I choose {cat}?"),
    ("en", "branded", "What do people say about {brand}?"),
    ("de", "commercial_investigation", "Welche {cat} sind zu empfehlen?"),
    ("de", "local", "Wo gibt es {cat} in {loc}?"),
    ("de", "comparison", "{brand} oder {comp}?"),
    ("de", "pricing", "Wie teuer sind {cat}?"),
    ("de", "branded", "Wer ist {brand}?"),
    ("fr", "commercial_investigation", "Quels {cat} choisir ?"),
    ("fr", "comparison", "{brand} ou {comp} ?"),
    ("fr", "pricing", "Quel budget pour {cat} ?"),
    ("fr", "branded", "Que vaut {brand} ?"),
    ("it", "commercial_investigation", "Quali {cat} scegliere?"),
    ("it", "comparison", "{brand} o {comp}?"),
    ("it", "branded", "Chi è {brand}?"),
]
COMPETITORS_NAMED = 3


def starter_templates(spark: SparkSession) -> DataFrame:
    rows = [(lang, i, intent, t) for i, (lang, intent, t) in enumerate(STARTER_TEMPLATES)]
    return spark.createDataFrame(rows, "lang string, template_ord int, intent string, template string")


def supported_languages(languages: Column, supported: list[str]) -> Column:
    """A brand's languages that have templates, English when none has."""
    kept = F.filter(F.coalesce(languages, F.array(F.lit("en"))), lambda x: x.isin(supported))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("en")))


def _fill(template: Column, values: dict[str, Column]) -> Column:
    """Template with its slots filled, null when a slot it uses has no value."""
    out = template
    for slot, value in values.items():
        token = F.lit("{" + slot + "}")
        known = F.nullif(value, F.lit(""))
        out = F.when(F.contains(template, token), F.replace(out, token, known)).otherwise(out)
    return out


def expand_templates(brands: DataFrame, templates: DataFrame, supported: list[str]) -> DataFrame:
    """Brand x language x template (x first three competitors) (H1).

    ``brands`` is the output of ``normalise_brands``.  Columns: brand_key, ord, lang,
    intent, text.  Templates meet brands through an equi join on the language.
    """
    # localised texts are resolved once per brand and language, before templates multiply rows
    per_lang = brands.select("*", F.posexplode(
        supported_languages(F.col("languages"), supported)).alias("lang_ord", "lang")).select(
        "brand_key", "name", "location", "competitors", "lang_ord", "lang",
        text_of(F.col("category"), F.col("category_order"), F.col("lang")).alias("cat"),
        text_of(F.col("audience"), F.col("audience_order"), F.col("lang")).alias("aud"))
    bank = templates.select("lang", "template_ord", "intent", "template")
    rows = join_dimension(per_lang, bank, ["lang"], spread="brand_key")
    names = F.transform(F.slice("competitors", 1, COMPETITORS_NAMED), lambda c: c["name"])
    asks_rival = F.contains("template", F.lit("{comp}"))
    each = rows.select("*", F.posexplode(F.when(asks_rival, names).otherwise(
        F.array(F.lit(None).cast("string")))).alias("comp_ord", "comp"))
    text = _fill(F.col("template"), {
        "cat": F.col("cat"), "aud": F.col("aud"), "loc": F.col("location"), "brand": F.col("name"), "comp": F.col("comp")})
    return each.select(
        "brand_key", F.struct("lang_ord", "template_ord", "comp_ord").alias("ord"), "lang", "intent",
        text.alias("text")).where(F.coalesce("text", F.lit("")) != "")


def prompt_key(text: Column) -> Column:
    return trim_ws(F.regexp_replace(F.lower(text), f"{WS}+", " "))


def pinned_prompts(brands: DataFrame, supported: list[str]) -> DataFrame:
    """The operator's own questions, which are always asked."""
    lang = supported_languages(F.col("languages"), supported)[0]
    return brands.select(
        "brand_key", lang.alias("lang"), F.posexplode("extra_prompts").alias("pos", "text")
    ).where(F.col("text") != "").select(
        "brand_key", F.struct(F.lit(-1).alias("lang_ord"), F.col("pos").alias("template_ord"),
                              F.lit(0).alias("comp_ord")).alias("ord"),
        "lang", F.lit("commercial_investigation").alias("intent"), "text")


def dedupe_prompts(pinned: DataFrame, expanded: DataFrame) -> DataFrame:
    """One row per brand and question text, the first one winning, pinned ahead (H2)."""
    every = pinned.withColumn("pinned", F.lit(True)).unionByName(
        expanded.withColumn("pinned", F.lit(False))).withColumn("key", prompt_key(F.col("text")))
    first = every.groupBy("brand_key", "key").agg(F.min_by(
        F.struct("pinned", "ord", "lang", "intent", "text"), "ord").alias("p"))
    return first.select(
        "brand_key", "p.*", "key",
        hash_id(F.concat_ws("|", F.col("p.intent"), F.col("key")), 8).alias("prompt_id"),
        lookup(F.col("p.intent"), fixed.INTENT_WEIGHTS, fixed.DEFAULT_INTENT_WEIGHT).alias("weight"))


def balance(prompts: DataFrame, limit: int = fixed.PROMPT_LIMIT) -> DataFrame:
    """Fit the set to ``limit`` (H3): pinned stay, the rest round-robin over language and intent."""
    brand = Window.partitionBy("brand_key")
    sized = prompts.withColumns({
        "n_pinned": F.count_if("pinned").over(brand),
        "n_rest": F.count_if(~F.col("pinned")).over(brand)})
    bucket = Window.partitionBy("brand_key", "pinned", "lang", "intent")
    rounds = sized.withColumns({
        "round": F.row_number().over(bucket.orderBy("ord")),
        "bucket_first": F.min("ord").over(bucket)})
    room = F.greatest(F.lit(limit) - F.col("n_pinned"), F.lit(0))
    fits = F.col("n_rest") <= room
    turn = Window.partitionBy("brand_key", "pinned").orderBy(
        F.when(F.col("pinned") | fits, F.struct(
            F.lit(0).alias("r"), F.lit(0.0).alias("w"), F.col("ord").alias("o"))).otherwise(F.struct(
                F.col("round").alias("r"), (-F.col("weight")).alias("w"), F.col("bucket_first").alias("o"))),
        "ord")
    kept = rounds.withColumn("turn", F.row_number().over(turn)).where(
        F.col("pinned") | (F.col("turn") <= room))
    position = F.when(F.col("pinned"), F.col("turn")).otherwise(F.col("n_pinned") + F.col("turn"))
    return kept.select(
        "brand_key", "prompt_id", (position - 1).alias("prompt_ord"), "text", "intent", "lang",
        "weight", F.when(F.col("pinned"), "operator-supplied").alias("note"))


def generate_prompts(brands: DataFrame, templates: DataFrame, supported: list[str],
                     limit: int = fixed.PROMPT_LIMIT) -> DataFrame:
    """H1-H3 in one go."""
    return balance(dedupe_prompts(
        pinned_prompts(brands, supported), expand_templates(brands, templates, supported)), limit)
