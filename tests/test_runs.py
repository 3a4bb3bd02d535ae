"""Brands, prompts, fixes, history, retention, sources and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from answerscope.operators import history as K
from answerscope.operators import prompts as H
from answerscope.operators import recommend as J
from answerscope.operators import retention as L
from answerscope.sources import answers as A
from answerscope.sources import brands as B
from answerscope.sources import runs as S
from answerscope.streaming import live as N

PROFILES = [
    {"name": " Acme ", "domain": "https://www.acme.example/home", "category": "tools", "competitors": ["Beta", {"name": "Gamma", "domain": "http://www.g.example/x"}, {"domain": "x"}],
     "location": "Bern", "audience": {"fr": "artisans", "de": "Handwerker"}, "extraPrompts": ["Why  Acme?", "why acme?"], "languages": ["FR ", "xx"]},
    {"name": "Zed", "domain": "zed.example", "category": {"it": "attrezzi", "de": "Werkzeug"}, "competitors": []},
    {"name": "", "domain": 5, "category": {"en": "  "}}, {"domain": "a.example", "name": "A"},
]


def profiles(spark):
    return B.parse_profiles(spark.createDataFrame([(json.dumps(p),) for p in PROFILES] + [("{oops",)], "value string"))


def test_read_and_normalise(spark, tmp_path):
    (tmp_path / "b.json").write_text("\n".join(json.dumps(p) for p in PROFILES) + "\n\n{oops\n")
    valid, bad = B.normalise_brands(B.read_brands(spark, str(tmp_path / "b.json")))
    rows = {r["name"]: r for r in valid.collect()}
    assert rows["Acme"]["domain"] == "acme.example" and rows["Acme"]["brand_key"] == "acme-example"
    assert [(c["name"], c["domain"]) for c in rows["Acme"]["competitors"]] == [("Beta", None), ("Gamma", "www.g.example")]
    assert rows["Acme"]["languages"] == ["fr", "xx"] and rows["Zed"]["languages"] == ["it", "de"]
    assert sorted(map(tuple, (r["errors"] for r in bad.collect()))) == [("category",), ("name", "domain", "category_empty"), ("not_json",)]


def test_localised_text(spark):
    v = B.normalise_brands(profiles(spark))[0]
    got = {r["name"]: (r["x"], r["y"]) for r in v.select(
        "name", B.text_of(F.col("category"), F.col("category_order"), F.lit("fr")).alias("x"),
        B.text_of(F.col("audience"), F.col("audience_order"), F.lit("it")).alias("y")).collect()}
    assert got == {"Acme": ("tools", "artisans"), "Zed": ("attrezzi", None)}


def test_duplicate_entities(spark):
    e = B.entities_of(B.normalise_brands(profiles(spark))[0])
    assert B.duplicate_entities(e).count() == 0
    assert B.duplicate_entities(e.unionByName(e)).count() == 4


def test_prompts_pinned_first_and_balanced(spark):
    v = B.normalise_brands(profiles(spark))[0]
    p = H.generate_prompts(v, H.starter_templates(spark), ["en", "de", "fr", "it"], limit=4)
    acme = sorted((r for r in p.collect() if r["brand_key"] == "acme-example"), key=lambda r: r["prompt_ord"])
    assert [r["text"] for r in acme][0] == "Why  Acme?" and acme[0]["note"] == "operator-supplied" and len(acme) == 4
    assert len({r["intent"] for r in acme}) >= 3  # round-robin over intents
    zed = [r["text"] for r in p.collect() if r["brand_key"] == "zed-example"]
    assert all("{" not in t for t in zed)


def checks(spark, rows):
    return spark.createDataFrame(rows, "run_id string, check_ord int, check_id string, score double, fix_id string")


def test_recommend(spark):
    c = checks(spark, [("r", 0, "https", 0.0, "enable-https"), ("r", 1, "a", 0.6, "add-faq-content"), ("r", 2, "b", 0.2, "add-faq-content"),
                       ("r", 3, "c", 0.9, None), ("r", 4, "d", 0.1, "no-such-rule")])
    ready = spark.createDataFrame([("r", False, False), ("k", True, False), ("z", True, True)], "run_id string, blocked boolean, robots_blocked boolean")
    vis = spark.createDataFrame([("r", 10, 4, 0.1, 0.5, 0.2, 1, 6, 0.9, 0.5), ("k", 0, 0, 0.0, 0.9, 0.0, 3, 9, 1.0, 0.1)],
                                "run_id string, prompts_answered long, gap_count long, citation_rate double, mention_rate double, influence_ratio double, "
                                "dismissed_count long, total_citations long, off_site_share double, branded_rate double")
    rows = J.in_order(J.recommend(c, ready, vis)).collect()
    r = {x["rec_id"]: x for x in rows if x["run_id"] == "r"}
    assert set(r) == {"enable-https", "add-faq-content", "build-comparison-pages", "build-third-party-presence",
                      "convert-mentions-to-recommendations", "address-dismissals", "work-the-off-site-surfaces", "branded-recall-alert"}
    assert r["enable-https"]["severity"] == "critical" and r["enable-https"]["priority"] == 10.25
    assert r["add-faq-content"]["evidence"] == 0.2 and r["add-faq-content"]["severity"] == "critical" and r["add-faq-content"]["bucket"] == "now"
    assert r["build-comparison-pages"]["severity"] == "medium" and r["build-comparison-pages"]["bucket"] == "next"
    assert r["work-the-off-site-surfaces"]["bucket"] == "later"
    # without answers only the crawl finding remains
    assert [x["rec_id"] for x in rows if x["run_id"] == "k"] == ["crawl-blocked"]
    assert [x["rec_id"] for x in rows if x["run_id"] == "z"] == ["robots-disallows-crawling"]
    ranks = [(x["severity_rank"], -x["priority"]) for x in rows if x["run_id"] == "r"]
    assert ranks == sorted(ranks)


def runs(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a%d" % i, "a", t + dt.timedelta(hours=7 * i), 0.5 + i / 20 if i % 3 else None) for i in range(8)]
    rows += [("b0", "b", t, 0.3), ("c0", "c", t, 0.9), ("c1", "c", t + dt.timedelta(days=40), 0.2)]
    return spark.createDataFrame(rows, "run_id string, brand_key string, created_at timestamp, composite double")


def test_previous_lag_asof(spark):
    prev = {r["run_id"]: r["previous_id"] for r in K.previous_run(runs(spark)).collect()}
    assert prev["a7"] == "a6" and prev["a0"] == "a7" and prev["b0"] is None and prev["c0"] == "c1"
    lag = {r["run_id"]: r["previous_id"] for r in K.lag_run(runs(spark)).collect()}
    assert lag["a0"] is None and all(lag[f"a{i}"] == f"a{i - 1}" for i in range(1, 8)) and lag["c1"] == "c0"
    dates = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 7), 1), ("a", dt.datetime(2023, 1, 1), 2), ("c", dt.datetime(2024, 1, 30), 3), ("x", dt.datetime(2024, 1, 30), 4)],
                                  "brand_key string, as_of timestamp, q int")
    assert {r["q"]: r["run_id"] for r in K.as_of_run(dates, runs(spark)).collect()} == {1: "a1", 2: None, 3: "c0", 4: None}


def test_trend(spark):
    t = {r["brand_key"]: r for r in K.trend_summary(runs(spark)).collect()}
    assert t["a"]["direction"] == "up" and t["b"]["direction"] == "one run" and t["c"]["direction"] == "down" and t["a"]["points"] == 5
    pts = sorted((r["x"], r["y"]) for r in K.trend_points(runs(spark)).where("brand_key = 'a'").collect())
    assert [x for x, _ in pts] == [0, 0.25, 0.5, 0.75, 1] and pts[0][1] == 0 and pts[-1][1] == 1
    assert {r["run_id"] for r in K.below_threshold(runs(spark)).collect()} == {"b0", "c1"}


@pytest.mark.parametrize("r, v, want", [(0.8, 0.4, 0.62), (0.8, None, 0.8), (None, 0.4, 0.4), (None, None, None)])
def test_composite(one, r, v, want):
    assert one(K.composite(F.lit(r).cast("double"), F.lit(v).cast("double"))) == want


def test_delta_null_is_zero_unless_strict(spark):
    cols = ", ".join(f"{m} double, previous_{m} double" for m in K.DELTA_METRICS)
    vals = [v for _ in K.DELTA_METRICS for v in (0.5, None)]
    pair = spark.createDataFrame([("r", "p", "2024-01-01", *vals, ["x", "y"], ["y", "z"])], f"run_id string, previous_id string, previous_at string, {cols}, recs array<string>, previous_recs array<string>")
    d = K.compute_delta(pair).collect()[0]
    assert d["composite"] == 0.5 and d["resolved"] == ["z"] and d["introduced"] == ["x"]
    assert K.compute_delta(pair, strict=True).collect()[0]["composite"] is None


def test_retention(spark, tmp_path):
    now = F.lit("2024-02-01").cast("timestamp")
    removed, kept = L.split_expired(runs(spark), now, 30)
    assert removed.count() == 6 and kept.count() == 5
    undated = runs(spark).withColumn("created_at", F.lit(None).cast("timestamp"))
    assert L.split_expired(undated, now, 0)[0].count() == 0
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    S.write_runs(runs(spark), src)
    L.purge_table(spark, src, dst, now, 30)
    assert spark.read.parquet(dst).count() == 5 and "b" not in {r["brand_key"] for r in spark.read.parquet(dst).collect()}
    left, gone = L.erase_subject({"runs": runs(spark)}, "a")
    assert left["runs"].count() == 3 and gone.collect()[0]["runs_deleted"] == 8
    assert L.export_subject({"runs": runs(spark)}, "a").count() == 8
    assert tuple(L.holdings(runs(spark)).collect()[0]) == (3, 11)


def test_store_rewrites_only_its_brands(spark, tmp_path):
    path = str(tmp_path / "runs")
    S.write_runs(runs(spark), path)
    S.write_runs(runs(spark).where("brand_key = 'b'").withColumn("composite", F.lit(0.7)), path)
    back = spark.read.parquet(path)
    assert back.count() == 11 and back.where("brand_key = 'b'").collect()[0]["composite"] == 0.7


def test_csv_quoting(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", ok', ["a", "b"])], "t string, l array<string>")
    S.write_csv(df, str(tmp_path / "c"))
    parts = [p.read_text() for p in (tmp_path / "c").glob("*.csv")]
    assert all(p.startswith("t,l\n") for p in parts)
    assert "".join(p.removeprefix("t,l\n") for p in parts) == '"say ""hi"", ok",a b\n'


def test_payload_errors(spark):
    raw = spark.createDataFrame([("chat", 500, '{"error":{"message":""}}'), ("chat", 429, "not json"), ("grounded", 200, "{}")],
                                "provider string, http_status int, payload string")
    rows = A.normalise_payload(raw).collect()
    assert [(r["status"], r["error"], r["text"], r["citations"]) for r in rows] == [
        ("error", "HTTP 500", "", []), ("error", "HTTP 429", "", []), ("answered", None, "", [])]


def test_history_stream_replay(spark, tmp_path):
    path = str(tmp_path / "h")
    rows = runs(spark).withColumn("write_ts", F.lit(1))
    N.write_batch(rows, path, 0)
    newer = rows.where("brand_key = 'b'").withColumn("composite", F.lit(0.9))
    N.write_batch(newer, path, 1)
    N.write_batch(newer, path, 1)  # a replayed batch lands on its own folder
    back = N.read_history(spark, path, ["run_id", "brand_key"])
    assert back.count() == 11 and back.where("brand_key = 'b'").collect()[0]["composite"] == 0.9


def test_answers_stream_equals_batch(spark, tmp_path):
    import catalog.base as base
    d = "/root/testdata/sf0.001"
    docs = base.view(spark, d, "v_docs").limit(40).withColumns({
        "citations": base.split_words("cites"), "latency_ms": F.lit(1).cast("long"),
        "captured_at": F.lit("2024-01-01").cast("timestamp")}).drop("cites")
    docs.write.json(str(tmp_path / "in"))
    stored = A.read_answers(spark, str(tmp_path / "in"), "json")
    from answerscope.operators.mentions import score_answers
    prompts, ents = base.view(spark, d, "v_prompts"), base.entities(spark, d)
    batch = score_answers(stored, prompts, ents).select("ord", "score", "brand.rank").collect()
    live = N.stream_score(N.stream_answers(spark, str(tmp_path / "in")), prompts, ents).select("ord", "score", "brand.rank")
    N.run_once(live.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) > 0 and sorted(map(tuple, got)) == sorted(map(tuple, batch))


def test_upserts_are_versions_of_the_brands_they_touch(spark, tmp_path):
    path, keys = str(tmp_path / "store"), ["run_id", "brand_key"]
    stored = spark.createDataFrame([("r1", "a", 1.0), ("r2", "a", 2.0), ("r1", "b", 3.0)], "run_id string, brand_key string, composite double")
    S.upsert_runs(stored, path, keys, version=1)
    change = spark.createDataFrame([("r2", "a", 5.0), ("r9", "a", 6.0)], stored.schema)
    for _ in range(2):  # a write that is repeated changes nothing
        S.upsert_runs(change, path, keys, version=2)
        got = sorted((r["run_id"], r["brand_key"], r["composite"]) for r in S.read_runs(spark, path).collect())
        assert got == [("r1", "a", 1.0), ("r1", "b", 3.0), ("r2", "a", 5.0), ("r9", "a", 6.0)]
    assert {p.name for p in (tmp_path / "store" / "version=2").iterdir() if p.is_dir()} == {"brand_key=a"}
