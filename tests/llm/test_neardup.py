import random

import numpy as np
import pytest

from answerscope.llm import common, neardup


def words_of(text):
    return text.encode().lower().split() if text else []


def brute(texts, width):
    """Least id reachable over links of full sets, for every id."""
    sets = {}
    for i, t in texts:
        w = words_of(t)
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    found = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(found[a], found[b])
            changed |= found[a] != low or found[b] != low
            found[a] = found[b] = low
    return {i: (len(sets[i]), found[i]) for i in sets}


@pytest.mark.parametrize("width", [4, 5])
def test_components_by_brute_force(spark, corpus, width):
    got = neardup.neardup(spark.createDataFrame(corpus, "doc_id long, text string"), width).collect()
    want = brute(corpus, width)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len({c for _, c in want.values()}) < len(want) - 40


def group(rng, base, most):
    """A copy of ``base`` with up to ``most`` changed words."""
    words = list(base)
    for _ in range(rng.randint(0, most)):
        words[rng.randrange(len(words))] = "w%d" % rng.randrange(10**6)
    return " ".join(words)


@pytest.mark.parametrize("hub", ["least", "late", "none"])
def test_a_large_group_of_near_copies(spark, hub, monkeypatch):
    """Copies of one text at all distances from it, whether the text itself is there or not."""
    rng = random.Random(hub)
    base = ["v%d" % k for k in range(110)]
    texts = [group(rng, base, 9) for _ in range(260)] + [group(rng, ["u%d" % k for k in range(40)], 4) for _ in range(60)]
    chain = ["c%d" % k for k in range(100)]
    for k in range(14):
        chain[k * 7] = "d%d" % k
        texts.append(" ".join(chain))
    if hub == "least":
        texts.insert(0, " ".join(base))
    elif hub == "late":
        texts.append(" ".join(base))
    rows = list(enumerate(texts))
    seen = []
    plain = neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, *rest: (seen.append(pairs.count()), plain(pairs, *rest))[1])
    got = neardup.neardup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 4).collect()
    want = brute(rows, 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) < len(rows) and len(seen) >= 2
    # candidates stay far below all pairs (56,000)
    assert sum(seen) < 9000


def test_candidates_are_rare_in_both(spark):
    """Nodes meet by shingles that are rare in both: no link is missed, and pairs that only share passages do not meet."""
    rng = np.random.default_rng(8)
    sets = []
    for k in range(150):
        # passages that many hold, some that few hold, some of its own; every third is a near copy of the one before
        own = np.concatenate([np.arange(60), *(1000 * (p + 1) + np.arange(6) for p in rng.choice(25, 9, replace=False)), 10**6 + 100 * k + np.arange(rng.integers(2, 30))])
        if k % 3 == 2:
            own = np.concatenate([sets[-1][rng.integers(0, 2, len(sets[-1])) + rng.integers(0, 11, len(sets[-1])) > 0], 10**8 + 100 * k + np.arange(rng.integers(0, 9))])
        sets.append(own)
    hashed = [np.unique(common.mixed(x.astype(np.uint64))) for x in sets]
    open_ = spark.createDataFrame([(b, k, k if k % 10 else 0) for b in (1, 2) for k in range(150)], "bucket long, node long, component long")
    stored = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(hashed)], "node long, shingles binary")
    got = [tuple(r) for r in neardup.candidates(open_, stored, 80, spark.createDataFrame([(2, 1)], "a long, b long")).collect()]
    links = set()
    for a in range(150):
        for b in range(a + 1, 150):
            shared = len(np.intersect1d(hashed[a], hashed[b]))
            if 100 * shared >= 80 * (len(hashed[a]) + len(hashed[b]) - shared) and (a % 10 or b % 10) and (a, b) != (1, 2):
                links.add((a, b))
    assert len(got) == len(set(got)) and links <= set(got) and (1, 2) not in got
    assert len(links) > 20 and len(got) < 1500, (len(links), len(got))


def test_repeated_ids_are_documents_of_their_own(spark):
    base = " ".join("v%d" % k for k in range(60))
    other = " ".join("o%d" % k for k in range(400))
    rows = [(5, base), (5, other), (3, base + " end"), (9, other + " more"), (2, "alone it stands here"), (5, "")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.neardup(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect())
    assert got == [(2, 1, 2, True), (3, 58, 3, True), (5, 0, 5, True), (5, 57, 3, False), (5, 397, 5, True), (9, 398, 5, False)]


def test_awkward_rows(docs, none):
    rows = neardup.neardup(docs).collect()
    assert len(rows) == docs.count()
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in rows}
    for i in (2, 3, 12):
        assert next(c for (d, _), c in got.items() if d == i) == (1, False)
    assert got[4, 0] == (4, True) and got[5, 0] == (5, True) and got[6, 0] == (6, True) and got[7, 1] == (7, True)
    assert got[11, 1] == (10, False) and got[10, 1] == (10, True)
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert neardup.neardup(none).count() == 0
    assert neardup.neardup(docs.where("doc_id IN (4, 16)")).count() == 2


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 540)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_signatures_estimate_similarity():
    rng, late = np.random.default_rng(3), neardup.borrowing()
    for n, shared in ((400, 320), (40, 32), (12, 9)):
        same = []
        for _ in range(40):
            x = rng.integers(0, 2**63, 2 * n - shared, np.uint64)
            same.append((neardup.signature(x[:n], late) == neardup.signature(x[n - shared:], late)).mean())
        assert abs(np.mean(same) - shared / (2 * n - shared)) < 0.06
    assert len(set(neardup.bands(neardup.signature(np.array([5], np.uint64), late)).tolist())) == neardup.BINS // neardup.ROWS


def test_short_texts_are_one_shingle():
    hashes = common.WordHashes()
    assert len(common.shingles("", hashes, 4)) == 0
    assert len(common.shingles("a b", hashes, 4)) == 1 and len(common.shingles("a b c d e", hashes, 4)) == 2
    assert common.shingles("A b", hashes, 4) == common.shingles("a\tB ", hashes, 4)
