"""JSON-LD extraction on VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerscope.functions.core import NOT_BEFORE_WORD, WS, ColumnOrName, as_col, bind, trim_ws


def _parse(body: Column) -> Column:
    clean = F.regexp_replace(trim_ws(body), rf"^{WS}*<!\[CDATA\[", "")
    clean = F.regexp_replace(clean, rf"\]\]>{WS}*$", "")
    relaxed = F.regexp_replace(clean, rf",{WS}*([}}\]])", "$1")
    return F.coalesce(F.try_parse_json(clean), F.try_parse_json(relaxed))


def _as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _graph(v: Column) -> Column:
    return F.try_variant_get(v, '$["@graph"]', "array<variant>")


def _keys(v: Column) -> Column:
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def _tag(v: Column, done: bool) -> Column:
    return F.struct(v.alias("node"), F.lit(done).alias("done"))


def _expand(item: Column) -> Column:
    """One unwrapping step: arrays and @graph lists open up, plain objects are finished."""
    v = item["node"]
    none = F.filter(F.array(item), lambda _: F.lit(False))
    opened = F.transform(_graph(v), lambda n: _tag(n, False))
    return (
        F.when(item["done"], F.array(item))
        .when(_as_array(v).isNotNull(), F.transform(_as_array(v), lambda n: _tag(n, False)))
        .when(_graph(v).isNotNull(), F.concat(
            # the wrapper itself counts when it says more than one thing besides @graph
            F.when(F.size(_keys(v)) > 2, F.array(_tag(v, True))).otherwise(none), opened))
        .when(_keys(v).isNotNull(), F.array(_tag(v, True)))
        .otherwise(none))


def nodes(html: ColumnOrName) -> Column:
    """All JSON-LD objects of a page, flattened, as array<variant>."""
    h = F.coalesce(as_col(html), F.lit(""))
    script = (rf"(?is)<script{NOT_BEFORE_WORD}[^>]*type\s*=\s*[\"']application/ld\+json[\"']"
              r"[^>]*>(.*?)</script>")

    def opened(body: Column) -> Column:
        """The objects of one script; every step unwraps one level until all items are finished."""
        levels = F.regexp_count(body, F.lit(r"\[")) + 1
        items = F.filter(F.array(_tag(_parse(body), False)), lambda i: i["node"].isNotNull())
        return F.aggregate(F.sequence(F.lit(0), levels), items, lambda now, _: F.when(
            F.exists(now, lambda i: ~i["done"]), F.flatten(F.transform(now, lambda i: _expand(i)))).otherwise(now))

    items = F.flatten(F.transform(F.regexp_extract_all(h, F.lit(script), 1), opened))
    return F.transform(F.filter(items, lambda i: i["done"]), lambda i: i["node"])


def strings_at(node: Column, key: str) -> Column:
    """String value(s) under ``key``: a string or the strings of an array."""
    path = f'$["{key}"]'
    one = F.try_variant_get(node, path, "string")
    many = F.try_variant_get(node, path, "array<variant>")
    none = F.array().cast("array<string>")
    return F.when(many.isNotNull(), F.filter(
        F.transform(many, lambda m: F.when(
            F.schema_of_variant(m) == "STRING", F.try_variant_get(m, "$", "string"))),
        lambda s: s.isNotNull())
    ).when(is_string(node, key), F.array(one)).otherwise(none)


def is_string(node: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(node, f'$["{key}"]', "variant")) == "STRING"


def string_at(node: Column, key: str) -> Column:
    return F.when(is_string(node, key), F.try_variant_get(node, f'$["{key}"]', "string"))


def truthy(node: Column, key: str) -> Column:
    """Present and neither null, false, zero nor the empty string."""
    v = F.to_json(F.try_variant_get(node, f'$["{key}"]', "variant"))
    return F.coalesce(~v.isin("null", "false", "0", "0.0", "-0", '""'), F.lit(False))


def array_size(node: Column, key: str) -> Column:
    many = F.try_variant_get(node, f'$["{key}"]', "array<variant>")
    return F.coalesce(F.size(many), F.lit(-1))


def schema_types(node_array: Column, strip: bool = True) -> Column:
    """Distinct @type names over nodes (C8); ``strip`` drops the schema.org prefix."""
    every = F.flatten(F.transform(node_array, lambda n: strings_at(n, "@type")))
    if strip:
        every = F.transform(
            every, lambda t: F.regexp_replace(t, r"(?i)^https?://schema\.org/", ""))
    return F.array_distinct(every)


def node_facts(node_array: Column) -> Column:
    """The few facts the site checks need of each node, as plain structs."""
    def facts(n: Column) -> Column:
        listed = F.try_variant_get(n, '$["sameAs"]', "array<variant>")
        return F.struct(
            F.transform(strings_at(n, "@type"), lambda t: F.regexp_replace(
                t, r"(?i)^https?://schema\.org/", "")).alias("types"),
            F.when(listed.isNotNull(), F.size(listed) > 0)
            .otherwise(truthy(n, "sameAs")).alias("has_same_as"),
            strings_at(n, "sameAs").alias("same_as"),
            (array_size(n, "mainEntity") >= 3).alias("has_questions"),
            (truthy(n, "offers") | truthy(n, "price") | truthy(n, "aggregateRating")).alias("priced"),
            F.filter(F.array(*[string_at(n, k) for k in (
                "dateModified", "datePublished", "uploadDate")]),
                lambda d: d.isNotNull()).alias("dates"),
            truthy(n, "telephone").alias("phone"),
            truthy(n, "address").alias("address"),
            truthy(n, "author").alias("author"))

    return F.transform(node_array, lambda n: bind(n, facts))
