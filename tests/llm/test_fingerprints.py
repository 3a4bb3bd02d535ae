import hashlib

import numpy as np

from answerscope.llm import common, fingerprints


def test_edits_by_brute_force(spark, corpus, none):
    got = {r["doc_id"]: r for r in fingerprints.edits(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    texts, hashes, (a, b) = [t for _, t in sorted(corpus, reverse=True)], common.WordHashes(), fingerprints.family()
    ids = sorted((i for i, _ in corpus), reverse=True)
    mark = lambda t: fingerprints.fingerprint(common.shingles(t, hashes, 5), a, b)
    for k, (i, t) in enumerate(zip(ids, texts)):
        after = texts[(k + 1) % len(texts)]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == (mark(t) == mark(edited)).mean() and r["near_next"] == (mark(t) == mark(after)).mean()
        assert r["fingerprint"] == mark(t).astype(">u4").tobytes().hex()
    assert fingerprints.edits(none).count() == 0


def test_awkward_rows(docs):
    got = fingerprints.edits(docs).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] and by_id[4]["fingerprint"] == by_id[6]["fingerprint"] == "f" * 512
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    alone = fingerprints.edits(docs.where("doc_id = 16")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1


def test_least_values_and_likeness():
    rng, (a, b) = np.random.default_rng(1), fingerprints.family()
    x = rng.integers(0, 2**63, 5000, np.uint64)
    own = fingerprints.fingerprint(x, a, b)
    assert own[3] == min(int((int(a[3, 0]) * int(v) + int(b[3, 0])) % 2**64 >> 32) for v in x)
    near = [fingerprints.likeness(fingerprints.fingerprint(y[:300], a, b), fingerprints.fingerprint(y[100:], a, b)) for y in rng.integers(0, 2**63, (30, 400), np.uint64)]
    assert abs(np.mean(near) - 0.5) < 0.05


def test_similar_pairs(spark, corpus):
    got = {(r["a"], r["b"]): r["similarity"] for r in fingerprints.similar(spark.createDataFrame(corpus[120:], "doc_id long, text string")).collect()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, t in corpus[120:] for w in [t.lower().split()]}
    want = {(x, y): len(sets[x] & sets[y]) / len(sets[x] | sets[y]) for x in sets for y in sets if x < y}
    for pair, value in got.items():
        assert abs(value - want[pair]) < 1e-9 and value >= 0.8
    strong = [p for p, v in want.items() if 0.85 <= v < 1]
    assert sum(p in got for p in strong) >= 0.95 * len(strong)


def test_similar_keeps_long_near_copies_and_members(spark):
    mark = lambda t: fingerprints.fingerprint(common.shingles(t, common.WordHashes(), 5), *fingerprints.family())
    words = [f"w{k}" for k in range(2000)]
    long = " ".join(words)
    # a text that differs in one word and has the same 64 least values
    near = next(t for k in range(20, 1980) for t in [" ".join([*words[:k], "other", *words[k + 1:]])] if (mark(t) == mark(long)).all())
    small = " ".join(words[:60])
    rows = [(1, long), (2, near), (3, long), (4, near), (5, near), (6, small), (6, long), (7, small), (7, small), (8, "alone"), (None, long), (9, None)]
    got = fingerprints.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = {t: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for t in (long, near) for w in [t.split()]}
    value = len(sets[long] & sets[near]) / len(sets[long] | sets[near])
    assert sorted((r["a"], r["b"], round(r["similarity"], 9)) for r in got) == sorted(
        [(1, 2, round(value, 9)), (1, 3, 1.0), (1, 6, 1.0), (2, 4, 1.0), (2, 5, 1.0), (6, 7, 1.0)])
    assert all((r["a_set"] == r["b_set"]) == (r["similarity"] == 1) for r in got)


def test_similar_of_one_id_with_two_texts(spark):
    words = [f"w{k}" for k in range(200)]
    one, two = " ".join(words), " ".join([*words[:199], "other"])
    got = fingerprints.similar(spark.createDataFrame([(1, one), (1, two), (2, one), (3, two)], "doc_id long, text string")).collect()
    assert sorted((r["a"], r["b"], r["similarity"] == 1) for r in got) == [(1, 1, False), (1, 2, True), (1, 3, True)]
    assert len({r["a_set"] for r in got if r["similarity"] == 1}) == 2
