"""N and whole audits: streams that must equal their batch, and the end-to-end plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerscope.functions.core import round_half_up
from answerscope.operators import mentions as M
from answerscope.operators import metrics as A
from answerscope.session import scratch_folder
from answerscope.streaming import live as N
from catalog.answers import OUTCOME_SQL, doc_outcomes
from catalog.base import entities, outcomes, query, split_words, view
from catalog.text_queries import TEST_LEXICON


def _landed(df, name):
    """The rows as files of a streaming source folder."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return folder


def _drain(stream, name):
    """Run a stream to its end into files and read them back."""
    spark = stream.sparkSession
    out, mark = scratch_folder(spark, name), scratch_folder(spark, name + "_progress")
    N.run_once(stream.writeStream.format("parquet").option("checkpointLocation", mark).option("path", out))
    return spark.read.parquet(out)


@query("n01_stream_score", f"WITH {OUTCOME_SQL} SELECT ord, mentioned, rank, role, own_cited, floor(score * 1000 + 0.5) / 1000 AS score FROM scored", ints="rank")
def n01(spark, d):
    """Every answer lands twice; the stream scores it once."""
    docs = view(spark, d, "v_docs").withColumns({
        "citations": split_words("cites"), "latency_ms": F.lit(0).cast("long"),
        "captured_at": F.to_timestamp(F.lit("2024-01-01 00:00:00"))}).drop("cites")
    folder = _landed(docs.unionByName(docs), "answers")
    stream = N.stream_answers(spark, folder, "parquet")
    scored = N.stream_score(stream, view(spark, d, "v_prompts"), entities(spark, d), TEST_LEXICON)
    flat = scored.select("ord", "brand.mentioned", "brand.rank", "brand.role", "own_cited", round_half_up(F.col("score")).alias("score"))
    return _drain(flat, "scored")


@query("n02_windowed_mention_rate", """WITH m AS (SELECT o.brand_key, o.engine, o.ts, o.status = 'answered' AS ok, x.mentioned FROM v_outcomes o JOIN v_mentions x ON x.ord = o.ord AND x.entity_ord = 0)
SELECT date_trunc('day', ts)::VARCHAR AS day, brand_key, engine, count(*) FILTER (WHERE ok) AS answered, count(*) FILTER (WHERE ok AND mentioned) AS mentions,
 round(count(*) FILTER (WHERE ok AND mentioned) / nullif(count(*) FILTER (WHERE ok), 0), 9) AS rate FROM m GROUP BY ALL""")
def n02(spark, d):
    rows = outcomes(spark, d).select(
        "brand_key", "engine", F.col("ts").cast("timestamp").alias("ts"), "status", F.col("brand.mentioned").alias("mentioned"))
    # a far later row moves the watermark on, so every window of the data closes in append mode
    late = rows.limit(1).withColumn("ts", F.to_timestamp(F.lit("2031-01-01 00:00:00")))
    folder = _landed(rows, "outcomes")
    late.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(folder)
    out = _drain(N.windowed_mention_rate(stream, time="ts", lateness="60 days"), "rates")
    return out.where("window_start < '2030-01-01'").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("day"), "brand_key", "engine", "answered", "mentions", F.round("rate", 9).alias("rate"))


@query("n02_sliding_mention_rate", """WITH m AS (SELECT o.brand_key, o.ts, o.engine, o.status = 'answered' AS ok, x.mentioned FROM v_outcomes o JOIN v_mentions x ON x.ord = o.ord AND x.entity_ord = 0),
 w AS (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM m)
SELECT s::VARCHAR AS day, brand_key, engine, count(*) FILTER (WHERE ok) AS answered, count(*) FILTER (WHERE ok AND mentioned) AS mentions FROM w GROUP BY ALL""")
def n02b(spark, d):
    rows = outcomes(spark, d).select("brand_key", "engine", "ts", "status", F.col("brand.mentioned").alias("mentioned"))
    out = N.windowed_mention_rate(rows, "2 days", "1 day", time="ts")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("day"), "brand_key", "engine", "answered", "mentions")


@query("n03_history_upsert", "SELECT run_id, brand_key, composite FROM v_runs WHERE event_id % 10 <> 3 UNION ALL SELECT run_id, brand_key, composite + 1 FROM v_runs WHERE event_id % 10 = 3")
def n03(spark, d):
    rows = view(spark, d, "v_runs").select("run_id", "brand_key", "composite", "event_id", F.lit(1).alias("write_ts"))
    again = rows.where("event_id % 10 = 3").withColumns({"composite": F.col("composite") + 1, "write_ts": F.lit(2)})
    folder = _landed(rows, "runs")
    again.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(folder)
    store, mark = scratch_folder(spark, "history"), scratch_folder(spark, "history_progress")
    N.run_once(N.upsert_history(stream, store, mark))
    return N.read_history(spark, store, ["run_id", "brand_key"]).select("run_id", "brand_key", "composite")


@query("share_of_voice_from_text", f"""WITH {OUTCOME_SQL}, ok AS (SELECT run_id, brand_key, ord FROM scored WHERE status = 'answered'),
 e(entity_ord, name) AS (VALUES (0, 'From'), (1, 'With'), (2, 'Ther')), b AS (SELECT DISTINCT run_id, brand_key FROM scored),
 c AS (SELECT b.run_id, b.brand_key, e.entity_ord, e.name, count(r.doc_id) AS count FROM b CROSS JOIN e LEFT JOIN ok ON ok.run_id = b.run_id AND ok.brand_key = b.brand_key
   LEFT JOIN roles r ON r.doc_id = ok.ord AND r.entity_ord = e.entity_ord GROUP BY ALL)
SELECT run_id, brand_key, entity_ord, name, entity_ord = 0 AS is_brand, count, CASE WHEN sum(count) OVER w = 0 THEN 0 ELSE floor(count / sum(count) OVER w * 1000 + 0.5) / 1000 END AS share FROM c WINDOW w AS (PARTITION BY run_id, brand_key)""")
def sov(spark, d):
    """The flagship: raw answer text to share of voice, per run and brand."""
    return A.share_of_voice(doc_outcomes(spark, d), entities(spark, d))


@query("visibility_summary_from_text", f"""WITH {OUTCOME_SQL}
SELECT run_id, brand_key, count(*) AS prompts_run, count(*) FILTER (WHERE status = 'answered') AS prompts_answered, count(*) FILTER (WHERE status = 'answered' AND mentioned) AS mentions,
 coalesce(floor(sum(score * weight) FILTER (WHERE status = 'answered') / sum(weight) FILTER (WHERE status = 'answered') * 1000 + 0.5) / 1000, 0) AS score,
 count(*) FILTER (WHERE status = 'answered' AND role = 'dismissed') AS dismissed_count FROM scored GROUP BY ALL""")
def vis(spark, d):
    return A.summarise(doc_outcomes(spark, d)).select(
        "run_id", "brand_key", "prompts_run", "prompts_answered", "mentions", "score", "dismissed_count")


def _audit_sql(body: str) -> str:
    """The whole audit: outcomes of every host's run, checks of every host, and ``body`` over both."""
    from catalog.metrics import CREDITS, GAPS_SQL, R3, SURF
    from catalog.runs import BUCKET, MEASURED, PRIO, RULES, SEV
    from catalog.sites import ASSESS

    def of_hosts(sql: str) -> str:
        return sql.replace("FROM v_outcomes", "FROM ho")

    n = "count(*) FILTER (WHERE {})"
    answered = n.format("status = 'answered'")
    return f"""WITH {ASSESS},
 ho AS (SELECT v.* REPLACE (h.run_id AS run_id, h.brand_key AS brand_key) FROM v_outcomes v JOIN v_host_runs h ON h.ord = v.ord),
 {of_hosts(GAPS_SQL)}, {of_hosts(SURF)},
 sm AS (SELECT run_id, brand_key, {answered} AS prompts_answered, {R3.format("sum(score * weight) FILTER (WHERE status = 'answered') / sum(weight) FILTER (WHERE status = 'answered')")} AS visibility,
  {R3.format(n.format("mentioned") + " / " + answered)} AS mention_rate, {R3.format(n.format("own_cited AND status = 'answered'") + " / " + answered)} AS citation_rate,
  {n.format("role = 'dismissed'")} AS dismissed_count, {R3.format(n.format("role = 'recommended'") + " / " + n.format("mentioned"))} AS influence_ratio FROM o GROUP BY ALL),
 br_ AS (SELECT run_id, {R3.format("avg(mentioned::INT)")} AS branded_rate FROM a WHERE intent = 'branded' GROUP BY run_id),
 gc AS (SELECT run_id, count(*) AS gap_count FROM gaps GROUP BY run_id),
 ct AS (SELECT run_id, sum(count) AS total_citations, {R3.format("sum(count) FILTER (WHERE surface <> 'owned') / sum(count)")} AS off_site_share FROM s GROUP BY run_id),
 vf AS (SELECT sm.*, coalesce(gap_count, 0) AS gap_count, branded_rate, total_citations, coalesce(off_site_share, 0) AS off_site_share
  FROM sm LEFT JOIN br_ USING (run_id) LEFT JOIN gc USING (run_id) LEFT JOIN ct USING (run_id)),
 tr AS (SELECT host AS run_id, fix_id, min(score) AS score, arg_min(check_id, score * 1000000 + check_ord) AS check_id, min(check_ord) AS first_ord
  FROM chk JOIN bl USING (host) WHERE fix_id IS NOT NULL AND NOT blocked GROUP BY host, fix_id),
 {RULES}, {MEASURED.replace("v_vis", "vf")},
 br AS (SELECT run_id, fix_id AS rec_id, {SEV} AS severity, impact, effort, pillar, score AS evidence, first_ord AS ord
  FROM (SELECT run_id, fix_id, score, first_ord FROM tr UNION ALL SELECT * FROM mt) t JOIN rl ON rule_id = fix_id),
 rec AS (SELECT *, {PRIO} AS priority, {BUCKET} AS bucket FROM (SELECT * FROM br UNION ALL SELECT * FROM mm) z),
 hv AS (SELECT sm.run_id, sm.brand_key, visibility, mention_rate, citation_rate, asmt.overall AS readiness, asmt.blocked FROM sm JOIN asmt ON asmt.host = sm.run_id),
 cp AS (SELECT *, CASE WHEN readiness IS NULL THEN visibility ELSE {R3.format("readiness * 0.55::DOUBLE + visibility * 0.45::DOUBLE")} END AS composite FROM hv)
{body}"""


def _audit(spark, d):
    from answerscope.plans.audit import audit
    from catalog.base import as_of, brands, outcome_entities, pages, sites

    s = sites(spark, d)
    run_sites = s.select(
        F.col("host").alias("run_id"), F.concat(F.lit("b"), (F.col("first_id") % 3).cast("string")).alias("brand_key"), "host",
        F.lit("2024-01-31 00:00:00").cast("timestamp").alias("created_at"))
    of_hosts = outcomes(spark, d).drop("run_id", "brand_key").join(view(spark, d, "v_host_runs"), "ord")
    return audit(of_hosts, outcome_entities(spark, d), s, pages(spark, d), brands(spark, d), run_sites, as_of())


@query("audit_runs", _audit_sql("SELECT *, CASE WHEN composite >= .85 THEN 'A' WHEN composite >= .7 THEN 'B' WHEN composite >= .55 THEN 'C' WHEN composite >= .4 THEN 'D' ELSE 'F' END AS grade, readiness IS NULL AS partial FROM cp"))
def audit_runs(spark, d):
    """Whole audit of every host: one row per run with both halves, composite and grade."""
    return _audit(spark, d).runs.select(
        "run_id", "brand_key", "visibility", "mention_rate", "citation_rate", "readiness", "blocked", "composite", "grade", "partial")


@query("audit_recommendations", _audit_sql("SELECT run_id, rec_id, severity, impact, effort, pillar, round(evidence, 6) AS evidence, priority, bucket FROM rec"))
def audit_recommendations(spark, d):
    """Action plan of every run of the whole audit."""
    return _audit(spark, d).recommendations.select(
        "run_id", "rec_id", "severity", "impact", "effort", "pillar", F.round("evidence", 6).alias("evidence"), "priority", "bucket")
