"""Mentions, ranks, outcomes and the metrics on hand-made answers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from answerscope.operators import mentions as M
from answerscope.operators import metrics as A
from answerscope.operators import surfaces as G
from answerscope.plans import joins

ENTITIES = [("b", 0, "Acme Tools", "acme.example", ["AT"], True), ("b", 1, "Beta", "www.beta.example", [], False),
            ("b", 2, "Gamma.io", None, [], False)]


def entities(spark, rows=ENTITIES):
    return spark.createDataFrame(rows, "brand_key string, entity_ord int, name string, domain string, aliases array<string>, is_brand boolean")


def answers(spark, texts, cites=None, status=None):
    rows = [("r", "b", "e", "p%d" % (i % 2), i, i, (status or {}).get(i, "answered"), t, (cites or {}).get(i, [])) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "run_id string, brand_key string, engine string, prompt_id string, sample int, ord long, status string, text string, citations array<string>")


def prompts(spark):
    return spark.createDataFrame([("b", "p0", "Which?", "branded", None, 0.35), ("b", "p1", "Why?", "pricing", "de", 0.7)],
                                 "brand_key string, prompt_id string, text string, intent string, lang string, weight double")


def mentions(spark, text):
    rows = M.explode_mentions(M.find_mentions(answers(spark, [text]), entities(spark)), ["ord"]).collect()
    return {r["entity_ord"]: r for r in rows}


def test_longest_spelling_wins_and_overlaps_collapse(spark):
    m = mentions(spark, "Acme Tools is solid. Later, Acme and acme.example again.")
    assert m[0]["count"] == 3 and m[0]["first_index"] == 0 and m[0]["rank"] == 1
    assert not m[1]["mentioned"] and m[1]["first_index"] == -1 and m[1]["rank"] == 0 and m[1]["role"] == "referenced"


@pytest.mark.parametrize("text, hit", [
    ("Use Gamma.io now", True), ("Use x.Gamma.io now", False), ("Use Gamma.io.", True), ("Gamma.iox", False),
    ("a-Gamma.io", False), ("GAMMA.IO", True), ("Gamma-io", False),
])
def test_name_borders(spark, text, hit):
    assert mentions(spark, text)[2]["mentioned"] is hit


def test_role_comes_from_the_longest_spelling_not_the_first(spark):
    m = mentions(spark, "Avoid Acme right now. Acme Tools is the best.")[0]
    assert m["first_index"] == 6 and m["role"] == "recommended" and m["role_sentence"] == "Acme Tools is the best."
    assert m["sentiment"] == pytest.approx((1 / 3 - 1 / 3) / 2)


def test_rank_follows_first_appearance(spark):
    m = mentions(spark, "Beta first, then Gamma.io, and Acme.")
    assert [m[i]["rank"] for i in range(3)] == [3, 1, 2]
    assert {m[i]["role"] for i in range(3)} == {"listed"}


def test_offsets_survive_letters_that_grow_in_lowercase(spark):
    assert mentions(spark, "İİİ Beta")[1]["first_index"] == 4


def test_short_spellings_close_together(spark):
    # 'AT AT': the second hit starts 3 characters later, nearer than the minimum reach
    assert mentions(spark, "AT AT and AT")[0]["count"] == 2


TEXTS = ["Acme is the best.", "Options include Acme and Beta.", "Avoid Acme.", "Nothing here, Beta wins.", "failed"]


def outcomes(spark):
    cites = {0: ["https://acme.example/a", "https://www.reddit.com/r/x"], 1: ["https://reddit.com/y", "https://reddit.com/z", "bad"],
             3: ["https://beta.example", "https://g2.com/p"]}
    return M.score_answers(answers(spark, TEXTS, cites, {4: "error"}), prompts(spark), entities(spark)).cache()


def test_outcome_scores(spark):
    s = {r["ord"]: r["score"] for r in outcomes(spark).collect()}
    assert s[0] == pytest.approx(min(1, 0.55 + 0.3 + 0.2 / 3 + 0.15))
    assert s[1] == pytest.approx(0.55 * 0.7 + 0.3)
    assert s[2] == s[3] == s[4] == 0


def test_summary(spark):
    r = A.summarise(outcomes(spark)).collect()[0]
    assert (r["prompts_run"], r["prompts_answered"], r["prompts_failed"], r["mentions"]) == (5, 4, 1, 3)
    assert (r["mention_rate"], r["recommendation_rate"], r["dismissed_count"], r["influence_ratio"]) == (0.75, 0.25, 1, 0.333)
    assert r["margin_of_error"] == pytest.approx(0.424) and r["citation_rate"] == 0.25 and r["avg_rank"] == 1.0


def test_summary_keeps_runs_without_outcomes(spark):
    runs = spark.createDataFrame([("r", "b"), ("empty", "b")], "run_id string, brand_key string")
    rows = {r["run_id"]: r for r in A.summarise(outcomes(spark), runs).collect()}
    assert rows["empty"]["prompts_answered"] == 0 and rows["empty"]["score"] == 0


def test_share_gaps_wins(spark):
    o = outcomes(spark)
    sov = {r["name"]: (r["count"], r["share"]) for r in A.share_of_voice(o, entities(spark)).collect()}
    assert sov == {"Acme Tools": (3, 0.6), "Beta": (2, 0.4), "Gamma.io": (0, 0.0)}
    gap = A.find_gaps(o).collect()
    assert [(g["prompt_id"], g["asked"], g["lost"], g["loss_rate"], g["winners"]) for g in gap] == [("p1", 2, 1, 0.5, ["Beta"])]
    wins = {w["prompt_id"]: w for w in A.find_wins(o).collect()}
    assert wins["p0"]["won"] == 2 and wins["p0"]["cited"] and wins["p0"]["sentiment"] == pytest.approx((1 / 3 - 1 / 3) / 2)


def test_stability_needs_samples(spark):
    o = outcomes(spark)
    assert A.prompt_stability(o, 1).count() == 0
    rows = {r["prompt_id"]: r for r in A.prompt_stability(o, 5).collect()}
    assert rows["p0"]["stability"] == "locked" and rows["p1"]["stability"] == "contested" and rows["p1"]["rate"] == 0.5


def test_surfaces(spark):
    hosts = G.classified_hosts(outcomes(spark), entities(spark))
    s = G.surface_summary(hosts).collect()[0]
    assert (s["total_citations"], s["unique_domains"], s["owned_share"], s["off_site_share"]) == (5, 4, 0.2, 0.8)
    assert {r["host"]: r["surface"] for r in hosts.collect()} == {
        "acme.example": "owned", "reddit.com": "community", "beta.example": "competitor", "g2.com": "review"}
    assert [t["host"] for t in sorted(G.outreach_targets(hosts).collect(), key=lambda t: t["pos"])] == ["reddit.com", "g2.com"]


def test_languages_need_two(spark):
    o = outcomes(spark)
    assert {r["lang"] for r in A.by_language(o).collect()} == {"en", "de"}
    assert A.by_language(o.where("lang = 'en'")).count() == 0


def test_half_fold_over_many_wins(spark):
    """The fold of a long series equals a plain loop, although only the newest wins are folded."""
    rng = random.Random(7)
    tones = [rng.choice([-1.0, -1 / 3, 0.0, 1 / 3, 1.0]) for _ in range(2500)]
    rows = [("r", "b", "e", "p", i, "answered", "q", "pricing", False, (True, 1, t)) for i, t in enumerate(tones)]
    o = spark.createDataFrame(rows, "run_id string, brand_key string, engine string, prompt_id string, ord long, status string, "
                              "prompt_text string, intent string, own_cited boolean, brand struct<mentioned:boolean,rank:int,sentiment:double>")
    want = tones[0]
    for t in tones[1:]:
        want = (want + t) / 2
    got = A.find_wins(o).collect()[0]
    assert got["won"] == 2500 and got["sentiment"] == want


def test_order_of_rows_does_not_matter(spark):
    o = outcomes(spark)
    mixed = o.orderBy(F.rand(3)).repartition(7)
    for f in (A.summarise, A.find_gaps, A.find_wins, A.by_intent):
        assert sorted(map(str, f(o).collect())) == sorted(map(str, f(mixed).collect()))


def test_salted_join_equals_broadcast(spark, monkeypatch):
    a, e = answers(spark, TEXTS * 20), entities(spark)
    keys = ["ord", "entity_ord", "count", "rank", "role"]
    small = M.explode_mentions(M.find_mentions(a, e), ["ord"]).select(keys).collect()
    assert joins.is_small(e) and not joins.is_small(e, rows=1) and not joins.is_small(e, size=10)
    monkeypatch.setattr(joins, "is_small", lambda dim: False)
    salted = M.explode_mentions(M.find_mentions(a, e), ["ord"]).select(keys)
    assert sorted(map(str, salted.collect())) == sorted(map(str, small))


def test_many_hits_in_one_answer_take_time_in_proportion(spark):
    took = []
    for n in (500, 4000):
        text = "Acme rocks, they say. " * n
        df = M.explode_mentions(M.find_mentions(answers(spark, [text]), entities(spark)), ["ord"]).select("entity_ord", "count")
        df.collect()
        start = time.perf_counter()
        got = {r["entity_ord"]: r["count"] for r in df.collect()}
        took.append(time.perf_counter() - start)
        assert got[0] == n
    # eight times the hits: sixteen times is slack for a busy machine, in the square it would be sixty-four
    assert took[1] < 16 * took[0] + 4


def test_brands_in_one_job_equal_brands_alone(spark):
    rows = ENTITIES + [("c", 0, "Beta", "beta.example", [], True), ("c", 1, "Acme", "acme.example", [], False)]
    a = answers(spark, TEXTS)
    both = a.unionByName(a.withColumn("brand_key", F.lit("c")))
    together = M.explode_mentions(M.find_mentions(both, entities(spark, rows)), ["brand_key", "ord"])
    alone = M.explode_mentions(M.find_mentions(a, entities(spark)), ["brand_key", "ord"])
    assert sorted(map(str, together.where("brand_key = 'b'").collect())) == sorted(map(str, alone.collect()))


def test_brands_of_many_spellings(spark, monkeypatch):
    """Looking words up gives what searching for every spelling gives, and texts without a hit cost little."""
    rng = random.Random(5)
    parts = ["Acme", "Bolt", "co-op", "x_1", "Ünal", ".net", "A.B", "日本", "Delta", "42", "Zed"]
    names = sorted({rng.choice(["", " ", "-", "."]).join(rng.choice(parts) + (str(rng.randint(0, 60)) if rng.random() < .7 else "") for _ in range(rng.randint(1, 3))) for _ in range(1200)})
    names = [n for n in names if len(n) > 1][:1000]
    rows = [("b", 0, "Own Brand", None, names[:900], True), ("b", 1, "Rival", "rival.example", names[900:], False)]
    texts = [" ".join(rng.choice([rng.choice(names), rng.choice(parts), "and", "so.", "(" + rng.choice(names) + ")", rng.choice(names) + "."]) for _ in range(rng.randint(0, 14))) for _ in range(120)]
    keys = ["ord", "entity_ord", "count", "first_index", "rank", "role", "sentiment"]
    run = lambda: sorted(map(tuple, M.explode_mentions(M.find_mentions(answers(spark, texts), entities(spark, rows)), ["ord"]).select(keys).collect()))
    looked_up = run()
    M._search.cache_clear()
    monkeypatch.setattr(M, "INDEXED_FROM", 10**9)
    assert run() == looked_up and sum(r[2] for r in looked_up) > 300
    M._search.cache_clear()


def test_many_and_few_hits_have_the_same_tone(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["Acme Tools is excellent.", "avoid Acme!", "Beta works", "\n", "and Beta and Acme;", "Nothing here.", "terrible Gamma.io?"]) for _ in range(rng.randint(1, 40))) for _ in range(80)]
    run = lambda: sorted((r["ord"], r["entity_ord"], r["count"], round(r["sentiment"], 9)) for r in M.explode_mentions(M.find_mentions(answers(spark, texts), entities(spark)), ["ord"]).collect())
    both = run()
    for few in (0, 10**6):
        M._search.cache_clear()
        monkeypatch.setattr(M, "FEW_HITS", few)
        assert run() == both
    M._search.cache_clear()
    assert len({r[3] for r in both}) > 10
