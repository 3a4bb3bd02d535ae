"""A1-A2, E: reading answers, finding entities in them, scoring each answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerscope.functions.core import round_half_up
from answerscope.operators import mentions as M
from answerscope.sources import answers as A
from catalog.base import answers, entities, query, table, view
from catalog.text_queries import SENTENCES, TEST_LEXICON


@query("a01_read_answers", """SELECT ord, status, coalesce(text, '') AS text,
  CASE ord % 6 WHEN 4 THEN 'nonsense https://WWW.Rival.example/b https://medium.com/' || CAST(ord AS STRING) ELSE cites END AS citations FROM v_docs""")
def a01(spark, d):
    rows = answers(spark, d).withColumn("citations", F.concat("citations", F.array(F.lit("")), "citations"))
    return A.clean_answers(rows).select("ord", "status", "text", F.array_join("citations", " ").alias("citations"))


@query("a02_normalise_payload", r"""
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'error' ELSE 'answered' END AS status,
  CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 4 = 1 THEN text || chr(10) || 'see https://inline.example/x.'
       WHEN doc_id % 4 = 3 THEN text || chr(10) || 'tail' ELSE text END AS text,
  CASE WHEN doc_id % 11 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'rate limited' ELSE 'HTTP 503' END END AS error,
  CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'https://inline.example/x'
       WHEN doc_id % 4 = 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'https://c.example/1 https://c.example/2' ELSE 'https://s.example/' || doc_id END
       ELSE 'https://g.example/' || doc_id END AS citations
FROM documents""")
def a02(spark, d):
    i, t = F.col("doc_id"), F.col("text")
    k = i % 4
    def js(x): return F.to_json(x)  # noqa: E704
    chat = F.struct(F.struct(t.alias("content")).alias("message"))
    msgs = F.array(F.struct(F.lit("text").alias("type"), t.alias("text")), F.struct(F.lit("tool").alias("type"), F.lit("hidden").alias("text")),
                   F.struct(F.lit("text").alias("type"), F.lit("see https://inline.example/x.").alias("text")))
    parts = F.array(F.struct(t.alias("text")), F.struct(F.lit("").alias("text")), F.struct(F.lit("tail").alias("text")))
    chunk = F.array(F.struct(F.struct(F.concat(F.lit("https://g.example/"), i.cast("string")).alias("uri")).alias("web")))
    cites = F.array(F.lit("https://c.example/1"), F.lit("https://c.example/2"), F.lit("https://c.example/1"))
    found = F.array(F.struct(F.concat(F.lit("https://s.example/"), i.cast("string")).alias("url")))
    ok = (F.when(k == 0, js(F.struct(F.array(chat).alias("choices")))).when(k == 1, js(F.struct(msgs.alias("content"))))
          .when(k == 2, js(F.struct(F.array(chat).alias("choices"), F.when(i % 3 == 0, cites).alias("citations"),
                                    found.alias("search_results"))))
          .otherwise(js(F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"),
                                                  F.struct(chunk.alias("groundingChunks")).alias("groundingMetadata"))).alias("candidates")))))
    bad = F.when(i % 2 == 0, js(F.struct(F.struct(F.lit("rate limited").alias("message")).alias("error")))).otherwise("{}")
    raw = table(spark, d, "documents").select(
        "doc_id", F.when(k == 0, "chat").when(k == 1, "messages").when(k == 2, "search").otherwise("grounded").alias("provider"),
        F.when(i % 11 == 0, 503).otherwise(200).alias("http_status"), F.when(i % 11 == 0, bad).otherwise(ok).alias("payload"))
    return A.normalise_payload(raw).select("doc_id", "status", "text", "error", F.array_join("citations", " ").alias("citations"))


# hits per sentence; every non-word character is doubled so neighbouring hits do not share one
_HITS = r"""dbl AS (SELECT *, regexp_replace(s, '([^A-Za-z0-9_])', '\1\1', 'g') AS d2 FROM sent),
 ent(entity_ord, spelling, spelling_ord) AS (VALUES (0, 'own.example', 0), (0, 'From', 1), (0, 'own', 2), (1, 'www.rival.example', 0), (1, 'rival', 1), (1, 'With', 2), (2, 'Ther', 0), (2, 'Thre', 1)),
 hits AS (SELECT doc_id, line, line_no, part_no, s, entity_ord, spelling_ord,
   len(regexp_extract_all(d2, '(?i)(?:^|[^A-Za-z0-9_.-])(?:' || replace(spelling, '.', '[.][.]') || ')(?:$|[^A-Za-z0-9_-])')) AS n,
   greatest(-1, least(1, (contains(f, 'tion')::INT + contains(f, 'thon')::INT - contains(f, 'thth')::INT) / 3.0)) AS tone
   FROM (SELECT *, lower(strip_accents(s)) AS f FROM dbl) x CROSS JOIN ent)"""
_FIRST = r"""firsts AS (SELECT doc_id, entity_ord, min(length(regexp_extract(text, '(?is)^((?:.*?[^A-Za-z0-9_.-])??)(?:' || replace(spelling, '.', '[.]') || ')(?:[^A-Za-z0-9_-]|$)', 1))) AS first_index
   FROM documents CROSS JOIN ent WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_.-])(?:' || replace(spelling, '.', '[.]') || ')($|[^A-Za-z0-9_-])') GROUP BY ALL)"""
_CONNECT = r"(?i)\b(and|or|then|plus|followed by|und|oder|dann|sowie|et|ou|puis|ensuite|e|o|poi)\b"
MENTIONS_SQL = rf"""{SENTENCES}, {_HITS}, {_FIRST},
 per AS (SELECT doc_id, entity_ord, sum(n) AS n, sum(n * tone) / sum(n) AS sentiment,
   arg_min(struct_pack(s := s, line := line), spelling_ord * 1000000000000 + line_no * 1000000 + part_no) AS lead
   FROM hits WHERE n > 0 GROUP BY ALL),
 mentions AS (SELECT doc_id, entity_ord, n AS count, first_index, sentiment, lead.s AS sentence, lead.line AS line,
   row_number() OVER (PARTITION BY doc_id ORDER BY first_index, entity_ord) AS rank FROM per JOIN firsts USING (doc_id, entity_ord)),
 roles AS (SELECT *, CASE
   WHEN regexp_matches(lower(strip_accents(sentence)), 'avoid|not recommended|wouldn''t recommend|would not recommend|not a good|not the best|not ideal|not suitable|not worth|steer clear|skip|less suitable|falls short|struggles with|no longer|outdated|a poor|worse than|weakest|drawback|doesn''t|does not offer|lacks|limited compared') THEN 'dismissed'
   WHEN regexp_matches(lower(strip_accents(sentence)), 'best|top pick|top choice|i recommend|we recommend|recommended|go with|ideal|excellent choice|strongest|winner|my pick|the standout|first choice|well suited|great choice|good choice|worth choosing|i would choose|preferred') THEN 'recommended'
   WHEN regexp_matches(line, '^\s*(?:\d{{1,2}}\s*[.)]|[-*•])\s+') OR regexp_matches(lower(sentence), 'include|such as|options are|options for|consider|choices|candidates|alternatives are|shortlist|gehören|zählen zu|infrage kommen|zum beispiel|unter anderem|anbieter sind|parmi|notamment|par exemple|tra cui|ad esempio')
     OR (contains(sentence, ',') AND regexp_matches(sentence, '{_CONNECT}')) OR len(string_split(sentence, ',')) > 2
   THEN 'listed' ELSE 'referenced' END AS role FROM mentions)"""


@query("e01_find_mentions", f"""WITH {MENTIONS_SQL}
SELECT d.doc_id AS ord, e.entity_ord, r.count IS NOT NULL AS mentioned, coalesce(r.count, 0) AS count,
  coalesce(r.first_index, -1) AS first_index, round(coalesce(r.sentiment, 0), 6) AS sentiment, coalesce(r.role, 'referenced') AS role,
  coalesce(r.sentence, '') AS role_sentence
FROM documents d CROSS JOIN (SELECT DISTINCT entity_ord FROM ent) e LEFT JOIN roles r ON r.doc_id = d.doc_id AND r.entity_ord = e.entity_ord""", ints="count first_index")
def e01(spark, d):
    found = M.find_mentions(answers(spark, d), entities(spark, d), TEST_LEXICON)
    return M.explode_mentions(found, ["ord"]).select(
        "ord", "entity_ord", "mentioned", "count", "first_index", F.round("sentiment", 6).alias("sentiment"), "role", "role_sentence")


@query("e02_rank_entities", f"""WITH {MENTIONS_SQL}
SELECT d.doc_id AS ord, e.entity_ord, coalesce(r.rank, 0) AS rank
FROM documents d CROSS JOIN (SELECT DISTINCT entity_ord FROM ent) e LEFT JOIN roles r ON r.doc_id = d.doc_id AND r.entity_ord = e.entity_ord""", ints="rank")
def e02(spark, d):
    found = M.find_mentions(answers(spark, d), entities(spark, d), TEST_LEXICON)
    return M.explode_mentions(found, ["ord"]).select("ord", "entity_ord", "rank")


OUTCOME_SQL = f"""{MENTIONS_SQL},
 outc AS (SELECT a.*, p.text AS prompt_text, p.intent, p.lang, p.weight, r.count IS NOT NULL AS mentioned, coalesce(r.rank, 0) AS rank,
   coalesce(r.role, 'referenced') AS role, coalesce(r.sentiment, 0) AS sentiment,
   regexp_matches(lower(cites), '(^| )https?://(www[.])?own[.]example(/| |$)') AS own_cited
   FROM v_docs a JOIN v_prompts p ON p.brand_key = a.brand_key AND p.prompt_id = a.prompt_id
   LEFT JOIN roles r ON r.doc_id = a.ord AND r.entity_ord = 0),
 scored AS (SELECT *, CASE WHEN status <> 'answered' OR NOT mentioned OR role = 'dismissed' THEN 0.0 ELSE greatest(0, least(1,
   0.55::DOUBLE * CASE role WHEN 'recommended' THEN 1.0 WHEN 'listed' THEN 0.7 ELSE 0.45 END + 0.30::DOUBLE / (1 + 0.35::DOUBLE * (rank - 1))
   + greatest(-0.5, least(0.5, sentiment)) * 0.2::DOUBLE + CASE WHEN own_cited THEN 0.15 ELSE 0 END)) END AS score FROM outc)"""


def doc_outcomes(spark, d):
    return M.score_answers(answers(spark, d), view(spark, d, "v_prompts"), entities(spark, d), TEST_LEXICON)


@query("e03_score_answers", f"""WITH {OUTCOME_SQL}
SELECT ord, run_id, brand_key, engine, prompt_id, prompt_text, intent, lang, weight, status, mentioned, rank, role, own_cited,
  substr(text, 1, 900) AS answer_excerpt FROM scored""", ints="rank")
def e03(spark, d):
    return doc_outcomes(spark, d).select(
        "ord", "run_id", "brand_key", "engine", "prompt_id", "prompt_text", "intent", "lang", "weight", "status",
        "brand.mentioned", "brand.rank", "brand.role", "own_cited", "answer_excerpt")


@query("e04_outcome_score", f"""WITH {OUTCOME_SQL} SELECT ord, floor(score * 1000 + 0.5) / 1000 AS score FROM scored""")
def e04(spark, d):
    return doc_outcomes(spark, d).select("ord", round_half_up(F.col("score")).alias("score"))
