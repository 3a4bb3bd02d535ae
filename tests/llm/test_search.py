"""Operators 11 to 13 against brute force, and on awkward rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerscope.llm import lexical, nearest, negatives

VECTORS = "vec_id long, embedding array<float>, label int, place long, rank int, block string, score double, shard int"


def vectors(spark, seed=3, n=900):
    """Clustered vectors; a third are one vector, and the last rows are awkward."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 24))
    rows = [(k, [float(x) for x in np.float32(centres[k % 6] + 0.4 * rng.normal(size=24))] if k % 3 else [0.5] * 24, k % 6) for k in range(n)]
    rows += [(n, None, 1), (n + 100, [], 1), (n + 101, [0.0] * 24, 1), (n + 102, [1.0, None] * 12, 2), (n + 103, [float("nan")] * 24, 2), (n + 104, [float("inf")] * 24, 2),
             (None, [1.0] * 24, 1), (n + 105, [1.0] * 24, None), (n + 106, [1.0, 2.0], 3), (n + 200, [1.0, 2.0], 3), rows[200], rows[200], (100, [2.0] * 24, 4), (n + 300, [-0.0] + [0.5] * 23, 2)]
    return spark.createDataFrame([(*r, 1, 2, "b", 0.5, 7) for r in rows], VECTORS), rows


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_nearest_against_brute_force(spark):
    df, rows = vectors(spark)
    got = nearest.nearest(df, df.where("vec_id % 100 = 0"), shard_rows=200, ef=64).collect()
    plain = {(i, tuple(v)) for i, v, _ in rows if i is not None and usable(v) and any(v)}
    queries = {q for q in plain if q[0] % 100 == 0}
    found, hits, wanted = {}, 0, 0
    for r in got:
        found.setdefault((r["query_id"], r["query_key"]), []).append((r["rank"], r["score"], r["vec_id"]))
    assert len(found) == len(queries)
    taken = set()
    for qid, q in queries:
        exact = sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), i) for i, v in plain if i != qid and len(v) == len(q))
        best = max((k for k in found if k[0] == qid and k not in taken), key=lambda k: len({x[2] for x in found[k]} & {i for _, i in exact[:10]}))
        taken.add(best)
        own = sorted(found[best])
        assert [k for k, _, _ in own] == list(range(1, min(10, len(exact)) + 1))
        assert [(s, i) for _, s, i in own] == sorted((s, i) for _, s, i in own)
        far = {i: s for s, i in exact} if len({i for _, i in exact}) == len(exact) else {}
        assert all(math.isclose(s, far.get(i, s), rel_tol=1e-12) for _, s, i in own)
        hits += len({i for _, _, i in own} & {i for _, i in exact[:10]})
        wanted += min(10, len(exact))
    assert hits >= 0.95 * wanted


def test_query_recall(spark):
    """The registered query's recall on the whole table."""
    from answerscope.llm.queries import QUERIES
    d = "/root/testdata/sf0.1"
    got = QUERIES["op11_nearest"](spark, d).toPandas()
    rows = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    v, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    hits = 0
    queries = np.flatnonzero(ids % 100 == 0)
    for q in queries:
        far = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        exact = ids[np.lexsort((ids, far))[:10]]
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11))
        assert np.allclose(own.score, far[[np.flatnonzero(ids == i)[0] for i in own.vec_id]], rtol=1e-12)
        hits += len(set(own.vec_id) & set(exact))
    assert hits >= 0.95 * 10 * len(queries)


def test_graph_of_few_and_of_clusters():
    rng = np.random.default_rng(1)
    for n in (1, 2, 31, 33, 700):
        v = 1e30 * np.concatenate([rng.normal(size=(n - n // 2, 5)), 1000 + rng.normal(size=(n // 2, 5))])
        ids, far = nearest.Graph(v).nearest(v, 12)
        exact = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
        assert ids.shape == (n, min(12, n)) and all(len(set(r)) == len(r) for r in ids.tolist())
        assert np.allclose(far, np.take_along_axis(exact, ids, 1))
        if n < 40:
            assert np.allclose(np.sort(far, axis=1), np.sort(exact, axis=1)[:, :12], rtol=1e-3)


def test_nearest_of_nothing(spark):
    df, _ = vectors(spark)
    assert nearest.nearest(df.where("false"), df).count() == 0
    assert nearest.nearest(df, df.where("false")).count() == 0


@pytest.mark.parametrize("top", [1, 255, 256, 10**6, 2**40])
def test_scores_are_inner_products(top):
    rng = np.random.default_rng(top % 97)
    for dims in (1, 8, 13, 64):
        c, a = rng.integers(-top, top, (70, dims)), rng.integers(-300, 300, (9, dims))
        planes = negatives.bit_planes(c)
        assert (negatives.scores(planes, negatives._tables(a, planes)) == c @ a.T).all()


def brute_negatives(rows, scale=256):
    used = []
    for i, v, label in sorted({(i, None if v is None else tuple(v), x) for i, v, x in rows}, key=str):
        if i is not None and label is not None and usable(v):
            used.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(scale * float(x)) for x in v)))
    used = sorted(set(used))
    out = Counter()
    for a in used:
        if a[0] % 100:
            continue
        others = sorted((-sum(map(int.__mul__, a[2], c[2])), c[0], c[1]) for c in used if len(c[2]) == len(a[2]))
        for s, pid, _ in [o for o in others if o[1] != a[0] and o[2] == a[1]][:5]:
            fit = [o for o in others if o[2] != a[1] and 30 * -s <= 100 * -o[0] <= 90 * -s][:10]
            out.update((a[0], pid, k + 1, o[1], -s, -o[0]) for k, o in enumerate(fit))
    return out


@pytest.mark.parametrize("block", [100, 5000])
def test_negatives_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", max(2, block // 30))
    df, rows = vectors(spark)
    got = negatives.hard_negatives(df, negatives.ANCHORS, negatives.noisy_label())
    assert Counter(tuple(r)[:6] for r in got.collect()) == brute_negatives(rows)
    assert got.count() > 100


def test_negatives_of_nothing(spark):
    df, _ = vectors(spark)
    assert negatives.hard_negatives(df.where("false"), negatives.ANCHORS).count() == 0
    assert negatives.hard_negatives(df.where("vec_id = 200"), negatives.ANCHORS).count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_lexical(docs, items, most):
    bags = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in wanted.items():
        scores = []
        for doc, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 20 * m)) for t in own if t in bag)
            if s > 0:
                scores.append((-s, doc))
        out += [(i, k + 1, doc, -s) for k, (s, doc) in enumerate(sorted(scores)[:most])]
    return sorted(out)


@pytest.mark.parametrize("size", [lexical.TERM_BYTES, 60])
def test_lexical_against_brute_force(spark, docs, corpus, monkeypatch, size):
    from conftest import awkward
    monkeypatch.setattr(lexical, "TERM_BYTES", size)
    monkeypatch.setattr(lexical, "PAIRS", 50)
    texts = awkward() + [(100 + k, t) for k, t in corpus[:80]] + [(300, "a-a a Aİ É a_b a b  x a\x85b")]
    items = [(1, "a b"), (2, corpus[3][1]), (3, None), (4, ""), (None, "a"), (5, "A a É  x"), (6, corpus[5][1]), (6, "one more row a"), (7, "nowhere-found"), (8, "日本"), (9, "aİ b\x85")]
    df = spark.createDataFrame([(i, t, 1, 2.0, "x") for i, t in texts], "doc_id long, text string, n long, score double, found string")
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id int, terms string")
    got = lexical.search(df.repartition(5), asked, most=7)
    assert sorted(map(tuple, got.collect())) == brute_lexical(texts, items, 7)


def test_lexical_of_nothing(spark, docs):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.where("false"), items).count() == 0
    assert lexical.search(docs, items.where("false")).count() == 0
    assert lexical.search(docs, items.select("item_id", F.lit(None).cast("string").alias("text"))).count() == 0
