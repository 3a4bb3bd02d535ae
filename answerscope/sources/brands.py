"""Brand profiles: reading, validating, normalising (A3-A5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.functions.urls import ascii_host
from answerscope.functions.core import slug, trim_ws

def parse_profiles(lines: DataFrame, column: str = "value") -> DataFrame:
    """Profile text -> profile VARIANT, key orders as written, and the text of broken lines."""
    profile = F.try_parse_json(column)
    none = F.array().cast("array<string>")

    def order(path: str) -> Column:
        return F.coalesce(F.json_object_keys(F.get_json_object(column, path)), none)

    return lines.select(
        profile.alias("profile"), order("$.category").alias("category_keys"),
        order("$.audience").alias("audience_keys"),
        F.when(profile.isNull(), F.col(column)).alias("_corrupt_record"))


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    """Raw profiles, one JSON object per line (A3); broken lines keep their text."""
    return parse_profiles(spark.read.text(path).where(F.trim("value") != ""))


def _kind(v: Column) -> Column:
    """First word of the variant's type: STRING, OBJECT, ARRAY, BIGINT ... or null."""
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _string(v: Column, path: str) -> Column:
    return F.when(_kind(_get(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def _strings(v: Column, path: str) -> Column:
    return F.coalesce(F.filter(F.try_variant_get(v, path, "array<string>"), lambda s: s.isNotNull()),
                      F.array().cast("array<string>"))


def bare_domain(s: Column) -> Column:
    """Domain without scheme and path; ``www.`` stays."""
    return F.regexp_replace(F.regexp_replace(s, "^https?://", ""), "/.*$", "")


def _localised(v: Column, path: str) -> Column:
    """Plain string -> map with key '*'; per-language object -> map; else empty."""
    plain = _string(v, path)
    return (
        F.when(plain.isNotNull(), F.create_map(F.lit("*"), trim_ws(plain)))
        .when(_kind(_get(v, path)) == "OBJECT", F.try_variant_get(v, path, "map<string,string>"))
        .otherwise(F.create_map().cast("map<string,string>")))


def key_order(kind: Column, keys: Column) -> Column:
    """Languages of a localised field in the order written; '*' for the plain form."""
    return F.when(kind == "OBJECT", keys).otherwise(F.array(F.lit("*")))


def normalise_brands(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split raw profiles into (valid, errors) (A4)."""
    v = F.col("profile")
    kind = _kind(_get(v, "$.category"))
    text = F.coalesce(_string(v, "$.category"), F.lit(""))
    values = F.map_values(F.try_variant_get(v, "$.category", "map<string,string>"))
    filled = F.exists(values, lambda s: F.coalesce(trim_ws(s), F.lit("")) != "")
    no_category = (F.coalesce(kind, F.lit("")) != "OBJECT") & (text == "")
    empty_map = (kind == "OBJECT") & ~F.coalesce(filled, F.lit(False))
    problems = F.array_compact(F.array(
        F.when(F.coalesce(_string(v, "$.name"), F.lit("")) == "", "name"),
        F.when(F.coalesce(_string(v, "$.domain"), F.lit("")) == "", "domain"),
        F.when(no_category, "category"), F.when(empty_map, "category_empty")))
    checked = raw.withColumn("errors", F.when(v.isNull(), F.array(F.lit("not_json"))).otherwise(problems))
    bad = checked.where(F.size("errors") > 0)
    good = checked.where(F.size("errors") == 0)

    def rival(c: Column) -> Column:
        plain = _kind(c) == "STRING"
        return F.struct(
            F.when(plain, F.try_variant_get(c, "$", "string"))
            .otherwise(F.try_variant_get(c, "$.name", "string")).alias("name"),
            F.when(~plain, F.nullif(ascii_host(bare_domain(_string(c, "$.domain"))), F.lit(""))).alias("domain"),
            F.when(plain, F.array().cast("array<string>")).otherwise(_strings(c, "$.aliases")).alias("aliases"))

    rivals = F.filter(
        F.transform(F.coalesce(F.try_variant_get(v, "$.competitors", "array<variant>"),
                               F.array().cast("array<variant>")), rival),
        lambda c: F.coalesce(c["name"], F.lit("")) != "")
    listed = F.filter(F.transform(_strings(v, "$.languages"), lambda s: trim_ws(F.lower(s))), lambda s: s != "")
    languages = (
        F.when(F.size(_strings(v, "$.languages")) > 0, listed)
        .when(kind == "OBJECT", F.col("category_keys")).otherwise(F.array(F.lit("en"))))
    domain = ascii_host(F.regexp_replace(bare_domain(trim_ws(_string(v, "$.domain"))), r"^www\.", ""))
    valid = good.select(
        slug(domain).alias("brand_key"), trim_ws(_string(v, "$.name")).alias("name"),
        domain.alias("domain"), _strings(v, "$.aliases").alias("aliases"),
        _localised(v, "$.category").alias("category"), _localised(v, "$.audience").alias("audience"),
        languages.alias("languages"), F.nullif(trim_ws(_string(v, "$.location")), F.lit("")).alias("location"),
        rivals.alias("competitors"), _strings(v, "$.extraPrompts").alias("extra_prompts"),
        _strings(v, "$.keyPages").alias("key_pages"),
        key_order(kind, F.col("category_keys")).alias("category_order"),
        key_order(_kind(_get(v, "$.audience")), F.col("audience_keys")).alias("audience_order"))
    return valid, bad


def text_of(values: Column, order: Column, lang: Column) -> Column:
    """Text in ``lang``, else English, else the first language that has one (A5)."""
    def at(key: Column) -> Column:
        return F.nullif(F.try_element_at(values, key), F.lit(""))

    first = F.filter(F.transform(order, lambda k: at(k)), lambda s: s.isNotNull())
    return F.coalesce(at(lang), at(F.lit("en")), F.try_element_at(first, F.lit(1)))


def entities_of(valid: DataFrame) -> DataFrame:
    """Entity dimension: the brand is ord 0, competitors follow in profile order."""
    own = F.array(F.struct("name", "domain", "aliases"))
    return valid.select(
        "brand_key", F.posexplode(F.concat(own, "competitors")).alias("entity_ord", "e")).select(
        "brand_key", "entity_ord", "e.name", "e.domain", "e.aliases", (F.col("entity_ord") == 0).alias("is_brand"))


def duplicate_entities(entities: DataFrame) -> DataFrame:
    """Brands whose profile names the same entity twice (their counts would merge)."""
    return entities.groupBy("brand_key", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
