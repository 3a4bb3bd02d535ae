"""A3-A5, H: brand profiles and prompt sets for every customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerscope.operators import prompts as H
from answerscope.sources import brands as B
from catalog.base import query, view

LANGS = ["en", "de", "fr", "it"]

PROFILES = r"""pj AS (SELECT k, c_name, c_mktsegment, line, json_valid(line) AS ok FROM v_profiles),
 pe AS (SELECT *, CASE WHEN NOT ok THEN 'not_json' ELSE concat_ws('|', CASE WHEN k % 13 = 5 THEN 'name' END, CASE WHEN k % 17 = 5 THEN 'domain' END,
   CASE WHEN k % 19 = 5 THEN 'category' END, CASE WHEN k % 23 = 5 AND k % 19 <> 5 THEN 'category_empty' END) END AS errors FROM pj),
 vb AS (SELECT k, c_name AS name, lower(c_mktsegment) || k || '.example' AS domain, regexp_replace(lower(c_mktsegment) || k || '.example', '[^a-z0-9]+', '-', 'g') AS brand_key,
   CASE k % 3 WHEN 0 THEN lower(c_mktsegment) || ' tools' ELSE '' END AS plain,
   CASE WHEN k % 5 = 0 THEN ['de', 'en'] WHEN k % 3 = 0 THEN ['en'] WHEN k % 3 = 1 THEN ['de', 'en'] ELSE ['it', 'fr'] END AS langs,
   CASE WHEN k % 2 = 0 THEN 'Paris' END AS loc, CASE WHEN k % 6 = 0 THEN 'teams' END AS aud,
   CASE k % 4 WHEN 0 THEN ['Rival A', 'Rival B'] WHEN 1 THEN [] WHEN 2 THEN ['Solo'] ELSE ['C1', 'C2', 'C3', 'C4', 'C5'] END AS comps,
   CASE WHEN k % 7 = 0 THEN ['My own  question?', 'WHO ist ' || c_name || '?', 'Wer ist ' || c_name || '?'] ELSE [] END AS extra
   FROM pe WHERE errors = '')"""
CAT = """CASE k % 3 WHEN 0 THEN plain WHEN 1 THEN 'Werkzeug' ELSE CASE lang WHEN 'fr' THEN 'Outils' ELSE 'Attrezzi' END END"""


def raw(spark, d):
    return B.parse_profiles(view(spark, d, "v_profiles"), "line")


def valid(spark, d):
    return B.normalise_brands(raw(spark, d))[0]


@query("a03_read_brands", "SELECT json_valid(line) AS readable, CASE WHEN NOT json_valid(line) THEN line END AS broken, count(*) AS n FROM v_profiles GROUP BY ALL")
def a03(spark, d):
    return raw(spark, d).groupBy(
        F.col("profile").isNotNull().alias("readable"), F.col("_corrupt_record").alias("broken")).agg(F.count("*").alias("n"))


@query("a04_normalise_brands", f"""WITH {PROFILES} SELECT brand_key, name, domain, array_to_string(langs, ',') AS languages, loc AS location, 'c' || k AS aliases,
 array_to_string(comps, ',') AS competitors, CASE WHEN k % 4 = 0 THEN 'www.b.example' ELSE '' END AS competitor_domains, len(extra) AS extra_prompts FROM vb""", ints="extra_prompts")
def a04(spark, d):
    return valid(spark, d).select(
        "brand_key", "name", "domain", F.array_join("languages", ",").alias("languages"), "location",
        F.array_join("aliases", ",").alias("aliases"),
        F.array_join(F.transform("competitors", lambda c: c["name"]), ",").alias("competitors"),
        F.array_join(F.transform("competitors", lambda c: c["domain"]), ",").alias("competitor_domains"),
        F.size("extra_prompts").alias("extra_prompts"))


@query("a04_brand_errors", f"WITH {PROFILES} SELECT errors, count(*) AS n FROM pe WHERE errors <> '' GROUP BY ALL")
def a04e(spark, d):
    return B.normalise_brands(raw(spark, d))[1].groupBy(F.array_join("errors", "|").alias("errors")).agg(F.count("*").alias("n"))


@query("a05_text_of", f"""WITH {PROFILES}, l AS (SELECT *, unnest(['en', 'de', 'fr', 'xx']) AS lang FROM vb) SELECT brand_key, lang, {CAT} AS category, aud AS audience FROM l""")
def a05(spark, d):
    v = valid(spark, d).withColumn("lang", F.explode(F.array(*map(F.lit, ["en", "de", "fr", "xx"]))))
    return v.select("brand_key", "lang", B.text_of(F.col("category"), F.col("category_order"), F.col("lang")).alias("category"),
                    B.text_of(F.col("audience"), F.col("audience_order"), F.col("lang")).alias("audience"))


@query("a04_entities", f"""WITH {PROFILES}, e AS (SELECT brand_key, list_concat([name], comps) AS l FROM vb)
SELECT brand_key, unnest(l) AS name, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS entity_ord, generate_subscripts(l, 1) = 1 AS is_brand FROM e""")
def a04n(spark, d):
    return B.entities_of(valid(spark, d)).select("brand_key", "name", "entity_ord", "is_brand")


TEMPLATES = "tp(template_ord, lang, intent, template) AS (VALUES {})".format(", ".join(
    "({}, '{}', '{}', '{}')".format(i, lang, intent, t.replace("'", "''")) for i, (lang, intent, t) in enumerate(H.STARTER_TEMPLATES)))
EXPANDED = f"""{PROFILES}, {TEMPLATES}, lg AS (SELECT *, unnest(langs) AS lang, generate_subscripts(langs, 1) - 1 AS lang_ord FROM vb),
 tj AS (SELECT lg.*, template_ord, intent, template, {CAT} AS cat, CASE WHEN contains(template, '{{comp}}') THEN list_slice(comps, 1, 3) ELSE [NULL] END AS cs FROM lg JOIN tp USING (lang)),
 tx AS (SELECT *, unnest(cs) AS comp, generate_subscripts(cs, 1) - 1 AS comp_ord FROM tj),
 ex AS (SELECT brand_key, lang_ord, template_ord, comp_ord, lang, intent, replace(replace(replace(replace(replace(template, '{{cat}}', cat), '{{aud}}', coalesce(aud, '')), '{{loc}}', coalesce(loc, '')), '{{brand}}', name), '{{comp}}', coalesce(comp, '')) AS text
   FROM tx WHERE (NOT contains(template, '{{aud}}') OR aud IS NOT NULL) AND (NOT contains(template, '{{loc}}') OR loc IS NOT NULL))"""


@query("h01_expand_templates", f"WITH {EXPANDED} SELECT * FROM ex", ints="lang_ord comp_ord")
def h01(spark, d):
    return H.expand_templates(valid(spark, d), H.starter_templates(spark), LANGS).select("brand_key", "ord.*", "lang", "intent", "text")


DEDUPED = f"""{EXPANDED}, pin AS (SELECT brand_key, langs[1] AS lang, unnest(extra) AS text, generate_subscripts(extra, 1) - 1 AS pos FROM vb),
 al AS (SELECT brand_key, true AS pinned, -1 AS lang_ord, pos AS template_ord, 0 AS comp_ord, lang, 'commercial_investigation' AS intent, text FROM pin
   UNION ALL SELECT brand_key, false, lang_ord, template_ord, comp_ord, lang, intent, text FROM ex),
 ky AS (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key, lang_ord * 1000000 + template_ord * 1000 + comp_ord AS o FROM al),
 dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand_key, key ORDER BY o) AS rn FROM ky) z WHERE rn = 1),
 pr AS (SELECT brand_key, pinned, o, lang, intent, text, key, substr(sha256(intent || '|' || key), 1, 8) AS prompt_id,
   CASE intent WHEN 'commercial_investigation' THEN 1.0 WHEN 'comparison' THEN 0.9 WHEN 'alternative' THEN 0.85 WHEN 'local' THEN 0.85 WHEN 'pricing' THEN 0.7 WHEN 'problem' THEN 0.6 WHEN 'branded' THEN 0.35 ELSE 0.5 END::DOUBLE AS weight FROM dd)"""


def deduped(spark, d):
    v = valid(spark, d)
    return H.dedupe_prompts(H.pinned_prompts(v, LANGS), H.expand_templates(v, H.starter_templates(spark), LANGS))


@query("h02_dedupe_prompts", f"WITH {DEDUPED} SELECT brand_key, pinned, lang, intent, text, key, prompt_id, weight FROM pr")
def h02(spark, d):
    return deduped(spark, d).drop("ord")


@query("h03_balance", f"""WITH {DEDUPED}, n AS (SELECT brand_key, count(*) FILTER (WHERE pinned) AS np, count(*) FILTER (WHERE NOT pinned) AS nr FROM pr GROUP BY ALL),
 rd AS (SELECT pr.*, np, nr, greatest(6 - np, 0) AS room, row_number() OVER (PARTITION BY brand_key, pinned, lang, intent ORDER BY o) AS round, min(o) OVER (PARTITION BY brand_key, pinned, lang, intent) AS bf FROM pr JOIN n USING (brand_key)),
 tn AS (SELECT *, row_number() OVER (PARTITION BY brand_key, pinned ORDER BY CASE WHEN pinned OR nr <= room THEN 0 ELSE round END, CASE WHEN pinned OR nr <= room THEN 0 ELSE -weight END, CASE WHEN pinned OR nr <= room THEN o ELSE bf END, o) AS turn FROM rd)
SELECT brand_key, prompt_id, text, intent, lang, weight, CASE WHEN pinned THEN turn - 1 ELSE np + turn - 1 END AS prompt_ord, CASE WHEN pinned THEN 'operator-supplied' END AS note FROM tn WHERE pinned OR turn <= room""")
def h03(spark, d):
    return H.balance(deduped(spark, d), 6)
