"""B: text functions over whole documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerscope.functions import core as C
from answerscope.functions import text as T
from answerscope.functions import urls as U
from answerscope.operators.mentions import entity_variants
from catalog.base import entities, query, table, view

POS, NEG = ["tion", "thon"], ["thth"]
TEST_LEXICON = {"positive": POS, "negative": NEG}

# sentences of every document, with their line; an RE2 rendering that marks boundaries
SENTENCES = r"""lines AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
  marked AS (SELECT *, string_split(regexp_replace(line, '([.!?])(\s)', '\1␞\2', 'g'), '␞') AS parts FROM lines),
  pieces AS (SELECT doc_id, lang, source, line, line_no, unnest(parts) AS raw, generate_subscripts(parts, 1) AS part_no FROM marked),
  sent AS (SELECT *, trim(raw, chr(32) || chr(9) || chr(10) || chr(13)) AS s FROM pieces)"""


@query("b01_normalise", "SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def b01(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalise("text").alias("folded"))


@query("b02_escape", r"""SELECT page_id, regexp_replace(url, '([.*+?^${}()|\[\]\\])', '\\\1', 'g') AS escaped,
    true AS quoted FROM pages""")
def b02(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", C.rx_escape("url").alias("escaped"),
                    F.rlike("url", F.concat(F.lit("^"), C.rx_quote(F.col("url")), F.lit("$"))).alias("quoted"))


@query("b03_name_variants", r"""
WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Best ' || c_mktsegment WHEN 1 THEN c_mktsegment || ' House ' || c_custkey
      WHEN 2 THEN ' ' || c_name ELSE 'Go ' || c_name END AS name,
    CASE c_custkey % 3 WHEN 0 THEN 'www.' || lower(c_mktsegment) || '.com' WHEN 1 THEN 'ab.io' ELSE NULL END AS domain,
    CASE WHEN c_custkey % 5 = 0 THEN [c_mktsegment, ' x', 'C' || c_custkey] ELSE [] END AS aliases FROM customer),
parts AS (SELECT *, regexp_split_to_array(trim(name), '\s+') AS w,
    split_part(regexp_replace(coalesce(domain, ''), '^www\.', ''), '.', 1) AS label FROM c),
cand AS (SELECT c_custkey, list_concat([trim(name)], list_transform(aliases, lambda a: trim(a)),
    CASE WHEN domain IS NULL THEN [] ELSE [domain] END, CASE WHEN length(label) >= 3 THEN [label] ELSE [] END,
    CASE WHEN len(w) > 1 AND length(w[1]) >= 4 AND lower(w[1]) NOT IN ('best') THEN [w[1]] ELSE [] END) AS l FROM parts),
rows_ AS (SELECT c_custkey, unnest(l) AS variant, generate_subscripts(l, 1) AS i FROM cand),
firsts AS (SELECT c_custkey, variant, min(i) AS i FROM rows_ WHERE length(variant) >= 2 GROUP BY ALL)
SELECT c_custkey, variant, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY i) - 1 AS INTEGER) AS variant_ord FROM firsts""")
def b03(spark, d):
    key, seg, name = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_name")
    c = table(spark, d, "customer").select(
        key.alias("brand_key"), F.lit(0).alias("entity_ord"),
        F.when(key % 4 == 0, F.concat(F.lit("Best "), seg)).when(key % 4 == 1, F.concat_ws(" ", seg, F.lit("House"), key))
        .when(key % 4 == 2, F.concat(F.lit(" "), name)).otherwise(F.concat(F.lit("Go "), name)).alias("name"),
        F.when(key % 3 == 0, F.concat(F.lit("www."), F.lower(seg), F.lit(".com"))).when(key % 3 == 1, "ab.io").alias("domain"),
        F.when(key % 5 == 0, F.array(seg, F.lit(" x"), F.concat(F.lit("C"), key))).otherwise(
            F.array().cast("array<string>")).alias("aliases"))
    return entity_variants(c).select(F.col("brand_key").alias("c_custkey"), "variant", "variant_ord")


@query("b04_sentences", f"""WITH {SENTENCES}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part_no) - 1 AS INTEGER) AS pos, s AS sentence
FROM sent WHERE s <> ''""")
def b04(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence"))


@query("b05_in_list_context", rf"""WITH {SENTENCES}
SELECT doc_id, count(*) AS sentences, count(*) FILTER (WHERE
    regexp_matches(line, '^\s*(?:\d{{1,2}}\s*[.)]|[-*•])\s+') OR
    regexp_matches(lower(s), 'include|such as|options are|options for|consider|choices|candidates|alternatives are|shortlist|gehören|zählen zu|infrage kommen|zum beispiel|unter anderem|anbieter sind|parmi|notamment|par exemple|tra cui|ad esempio')
    OR (contains(s, ',') AND regexp_matches(s, '(?i)\b(and|or|then|plus|followed by|und|oder|dann|sowie|et|ou|puis|ensuite|e|o|poi)\b'))
    OR len(string_split(s, ',')) > 2) AS in_list
FROM sent WHERE s <> '' GROUP BY doc_id""")
def b05(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    s = lines.select("doc_id", "line", F.explode(T.sentences("line")).alias("s"))
    return s.groupBy("doc_id").agg(
        F.count("*").alias("sentences"), F.count_if(T.in_list_context(F.col("line"), F.col("s"))).alias("in_list"))


@query("b06_score_sentiment", f"""WITH {SENTENCES},
n AS (SELECT doc_id, lower(strip_accents(s)) AS t FROM sent WHERE s <> '')
SELECT doc_id, round(sum(greatest(-1, least(1, (contains(t, 'tion')::INT + contains(t, 'thon')::INT - contains(t, 'thth')::INT) / 3.0))), 6) AS tone
FROM n GROUP BY doc_id""")
def b06(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.explode(T.sentences("text")).alias("s"))
    return s.groupBy("doc_id").agg(F.round(F.sum(T.score_sentiment("s", POS, NEG)), 6).alias("tone"))


@query("b07_classify_role", r"""
WITH q AS (SELECT doc_id, trim(text) AS base, doc_id % 6 AS k FROM documents),
s AS (SELECT doc_id, k, CASE k WHEN 0 THEN 'We avoid this: ' || base WHEN 1 THEN 'Rather than Acme, ' || base
   WHEN 2 THEN 'An excellent choice. ' || base WHEN 3 THEN 'Unlike ' || repeat('z', 60) || ' Acme ' || base
   WHEN 4 THEN '' ELSE base END AS t FROM q),
n AS (SELECT *, lower(strip_accents(t)) AS f FROM s)
SELECT doc_id, CASE WHEN f = '' THEN 'referenced'
  WHEN regexp_matches(f, 'avoid|not recommended|wouldn''t recommend|would not recommend|not a good|not the best|not ideal|not suitable|not worth|steer clear|skip|less suitable|falls short|struggles with|no longer|outdated|a poor|worse than|weakest|drawback|doesn''t|does not offer|lacks|limited compared') THEN 'dismissed'
  WHEN k = 1 THEN 'dismissed'
  WHEN regexp_matches(f, 'best|top pick|top choice|i recommend|we recommend|recommended|i would recommend|go with|ideal|excellent choice|strongest|winner|my pick|the standout|first choice|well suited|great choice|good choice|worth choosing|i would choose|preferred') THEN 'recommended'
  WHEN doc_id % 2 = 0 THEN 'listed' ELSE 'referenced' END AS role FROM n""")
def b07(spark, d):
    k, base = F.col("doc_id") % 6, F.trim("text")
    t = (F.when(k == 0, F.concat(F.lit("We avoid this: "), base)).when(k == 1, F.concat(F.lit("Rather than Acme, "), base))
         .when(k == 2, F.concat(F.lit("An excellent choice. "), base))
         .when(k == 3, F.concat(F.lit("Unlike " + "z" * 60 + " Acme "), base)).when(k == 4, "").otherwise(base))
    return table(spark, d, "documents").select(
        "doc_id", T.classify_role(t, F.lit("Acme"), F.col("doc_id") % 2 == 0).alias("role"))


@query("b08_extract_urls", r"""
WITH t AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS k FROM pages),
e AS (SELECT page_id, k, regexp_replace(url, '^(https?://[^/?#]+)$', '\1/') AS u FROM t)
SELECT page_id, CASE k WHEN 1 THEN 'https://md.example/x|' || u WHEN 2 THEN u || '|http://b.example:8080/q' ELSE u END AS urls FROM e""")
def b08(spark, d):
    u, k = F.col("url"), F.col("page_id") % 3
    t = (F.when(k == 0, F.concat(F.lit("See "), u, F.lit(", or [this](https://md.example/x).")))
         .when(k == 1, F.concat(F.lit('Sources: '), u, F.lit(" and HTTP://B.example:8080/q! ("), F.lit("https://no.example/x) "), u))
         .otherwise(F.concat(u, F.lit("; "), u, F.lit("."))))
    return table(spark, d, "pages").select("page_id", F.array_join(U.extract_urls(t), "|").alias("urls"))


@query("b09_word_count", r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS words FROM documents""")
def b09(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count("text").alias("words"))


@query("b10_answer_capsule", r"""
WITH t AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 9 = 0 THEN 'At ' || text WHEN doc_id % 9 = 1 THEN 'Since 1998 ' || text ELSE text END, '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '\S+')) >= 15
  AND NOT regexp_matches(t, '(?i)^(welcome|we are|we''re|founded in|for over \d+|since \d{4}|our (team|mission|story)|at [a-z])')
  AND len(regexp_extract_all(regexp_extract(t, '^[^.!?]*'), '\S+')) BETWEEN 6 AND 45 AS capsule FROM t""")
def b10(spark, d):
    k = F.col("doc_id") % 9
    t = F.when(k == 0, F.concat(F.lit("At "), "text")).when(k == 1, F.concat(F.lit("Since 1998 "), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.is_answer_capsule(t).alias("capsule"))


_URL_CASE = """CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://user@') WHEN 2 THEN upper(url)
  WHEN 3 THEN regexp_replace(url, '(://[^/?#]*)', '\\1:443') WHEN 4 THEN regexp_replace(url, '(://[^/?#]*)', '\\1:8080') ELSE 'no url ' || url END"""


def _odd_urls(spark, d):
    k, u = F.col("page_id") % 6, F.col("url")
    return table(spark, d, "pages").select("page_id", F.when(k == 0, u).when(k == 1, F.replace(u, F.lit("://"), F.lit("://user@")))
        .when(k == 2, F.upper(u)).when(k == 3, F.regexp_replace(u, "(://[^/?#]*)", "$1:443"))
        .when(k == 4, F.regexp_replace(u, "(://[^/?#]*)", "$1:8080")).otherwise(F.concat(F.lit("no url "), u)).alias("url"))


@query("b11_host_of", f"""WITH u AS (SELECT page_id, {_URL_CASE} AS u FROM pages),
h AS (SELECT page_id, lower(u) AS u, regexp_extract(lower(u), '^https?://(?:[^/?#@]*@)?([^/?#]*)', 1) AS h FROM u)
SELECT page_id, regexp_replace(CASE WHEN u LIKE 'https:%' THEN regexp_replace(h, ':443$', '') ELSE regexp_replace(h, ':80$', '') END, '^www[.]', '') AS host FROM h""")
def b11(spark, d):
    return _odd_urls(spark, d).select("page_id", U.host_of("url").alias("host"))


@query("b12_same_host", """SELECT p.page_id, p.host = q.host AS same FROM v_pages p JOIN v_pages q ON q.page_id = p.page_id + 1""")
def b12(spark, d):
    p = table(spark, d, "pages").select("page_id", F.upper(F.concat(F.lit("www."), U.host_of("url"))).alias("a"))
    q = table(spark, d, "pages").select((F.col("page_id") - 1).alias("page_id"), U.host_of("url").alias("b"))
    return p.join(q, "page_id").select("page_id", U.same_host("a", "b").alias("same"))


@query("b13_site_origin", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://' ELSE regexp_extract(url, '^https?://') END || full_host AS origin,
  regexp_replace(full_host, '^www[.]', '') AS host FROM (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS full_host FROM pages) t""")
def b13(spark, d):
    raw = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.upper(F.col("url")))
    o = table(spark, d, "pages").select("page_id", U.site_origin(raw).alias("origin"))
    return o.withColumn("host", U.host_of("origin"))


@query("b14_slug", r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)
SELECT page_id, substr(s, 1, 60) AS slug, s AS rule_slug, 'brand' AS empty_slug FROM s""")
def b14(spark, d):
    return table(spark, d, "pages").select(
        "page_id", C.slug("url").alias("slug"), C.slug("url", None, None).alias("rule_slug"), C.slug(F.lit("--")).alias("empty_slug"))


@query("b15_hash_id", "SELECT doc_id, substr(sha256(text), 1, 8) AS id8, substr(sha256(text), 1, 10) AS id10 FROM documents")
def b15(spark, d):
    return table(spark, d, "documents").select("doc_id", C.hash_id("text", 8).alias("id8"), C.hash_id("text").alias("id10"))


@query("b16_clamp_round", """SELECT event_id, floor((value - 20) / 7 * 1000 + 0.5) / 1000 AS r3, floor((value - 20) / 7 * 100 + 0.5) / 100 AS r2,
  greatest(-1.0, least(1.0, value - 20)) AS c FROM events""")
def b16(spark, d):
    x = (F.col("value") - 20) / 7
    return table(spark, d, "events").select(
        "event_id", C.round_half_up(x).alias("r3"), C.round_half_up(x, 2).alias("r2"),
        C.clamp(F.col("value") - 20, -1.0, 1.0).alias("c"))


@query("b17_grades", """SELECT event_id, CASE WHEN composite IS NULL THEN 'N/A' WHEN composite >= .85 THEN 'A' WHEN composite >= .7 THEN 'B'
  WHEN composite >= .55 THEN 'C' WHEN composite >= .4 THEN 'D' ELSE 'F' END AS grade,
  CASE WHEN mention_rate >= .8 THEN 'pass' WHEN mention_rate >= .45 THEN 'warn' ELSE 'fail' END AS status,
  CASE WHEN composite IS NULL THEN 'none' WHEN composite >= .7 THEN 'good' WHEN composite >= .45 THEN 'warning' ELSE 'critical' END AS band FROM v_runs""")
def b17(spark, d):
    return view(spark, d, "v_runs").select(
        "event_id", C.grade_for("composite").alias("grade"), C.status_for("mention_rate").alias("status"),
        C.band_for("composite").alias("band"))


@query("b18_snippets", r"""
WITH h AS (SELECT doc_id, text, strpos(text, 'tion') - 1 AS idx FROM documents)
SELECT doc_id, substr(text, 1, 900) AS excerpt, CASE WHEN idx >= 0 THEN trim(regexp_replace(
  substr(text, greatest(0, idx - 120) + 1, idx + 4 + 160 - greatest(0, idx - 120)), '\s+', ' ', 'g')) END AS snippet FROM h""")
def b18(spark, d):
    idx = F.instr("text", "tion") - 1
    return table(spark, d, "documents").select(
        "doc_id", T.excerpt("text").alias("excerpt"),
        F.when(idx >= 0, T.snippet(F.col("text"), idx, F.lit(4))).alias("snippet"))
