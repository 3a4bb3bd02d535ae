import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from answerscope.llm import katz


def brute(rows, folds=10):
    """Every quantity from its definition, with words instead of hashes."""
    tokens = [(i, (t or "").encode().lower().split() + [katz.END]) for i, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % folds == 0 for i, _ in rows]
    c1, c2 = Counter(), Counter()
    for (_, t), h in zip(tokens, held):
        if not h:
            c1.update(t)
            c2.update(zip([katz.END, *t], t))
    few = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.LARGEST + 2)]
    total, words = sum(c1.values()), len(c1)
    model = katz.Model.of([words, total, *few(c1)], [len(c2), sum(c2.values()), *few(c2)])
    p = lambda w: float(model.word_probability(np.array([c1[w]]))[0])
    mass = lambda n: float(model.discounted(np.array([n]), model.pair_discounts)[0])
    after = defaultdict(list)
    for (a, b), n in c2.items():
        after[a].append((b, n))
    if words:
        assert sum(map(p, c1)) + model.unknown == pytest.approx(1)

    def alpha(a):
        if not c1[a]:
            return 1.0
        value = (1 - sum(mass(n) for _, n in after[a]) / c1[a]) / (1 - sum(p(b) for b, _ in after[a]))
        assert value > 0
        assert sum(mass(n) / c1[a] for _, n in after[a]) + value * (1 - sum(p(b) for b, _ in after[a])) == pytest.approx(1)
        return value

    out = []
    for (i, t), h in zip(tokens, held):
        score = sum(math.log10(mass(c2[a, w]) / c1[a]) if c2[a, w] else math.log10(alpha(a)) + math.log10(p(w)) for a, w in zip([katz.END, *t], t))
        base = sum(math.log10((c1[w] + 0.1) / (total + 0.1 * (words + 1))) for w in t)
        out.append((i, h, len(t), sum(c1[w] > 0 for w in t), total, base, score))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[6]))


def same(got, want):
    got = sorted((tuple(r) for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[6]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], abs=1e-6)


@pytest.mark.parametrize("block,bucket", [(katz.BLOCK_BYTES, katz.BUCKET_ENTRIES), (3000, 500)])
def test_scores_by_brute_force(spark, corpus, block, bucket):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    same(katz.scores(df, block_bytes=block, bucket_entries=bucket).collect(), brute(corpus))


def test_awkward_rows(docs, none):
    same(katz.scores(docs).collect(), brute([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert katz.scores(none).count() == 0
    assert katz.scores(docs.where("doc_id = 4")).count() == 1


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = katz.scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert row["held_out"] and row["train_tokens"] == 0 and row["score"] == 0


def test_discounts():
    d = katz.discounts([1000, 400, 220, 150, 110, 90])
    assert d[0] == 0 and all(0 < x < 1 for x in d[1:]) and list(d[1:]) == sorted(d[1:])
    assert all(0 < x < 1 for x in katz.discounts([0, 0, 5, 0, 0, 0])[1:])


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 2**63, n, np.uint64))
        assert (katz.expand_sorted(katz.squeeze_sorted(keys)) == keys).all()
        assert (katz.expand(katz.squeeze(keys.astype(np.float64)), np.float64) == keys).all()
    edges = katz.cuts(np.array([0, 1, 2**63, 2**64 - 1], np.uint64), 2)
    assert edges.tolist() == [0, 2, 4]


def test_stored_tables_make_a_model(spark, corpus):
    """The tables hold the counts, and the backoff weights that make every word's followers add up to one."""
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    blocks = katz.blocks_of(df, 10, 5000)
    answers = katz.answer(katz.send(blocks, 4, 64)).cache()
    model_rows = answers.where("block IS NULL").collect()
    counts = Counter()
    for r in model_rows:
        counts.update(dict(zip(katz.expand_sorted(r["words"]).tolist(), katz.expand(r["word_totals"], np.uint64).tolist())))
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in corpus]
    words = Counter(w for (_, t), h in zip(corpus, held) if not h for w in t.encode().lower().split() + [katz.END])
    assert sorted(counts.values()) == sorted(words.values())
    pairs = sum(katz.expand(r["pair_totals"], np.uint64).sum() for r in model_rows)
    assert pairs == sum(words.values())
    stats = np.sum([r["stats"] for r in model_rows], axis=0).tolist()
    width = len(stats) // 2
    scored = katz.score_blocks(blocks, answers, katz.Model.of(stats[:width], stats[width:]), 4, 64)
    table = [r for r in katz.alphas(scored).where("block IS NULL").collect()]
    assert sum(len(katz.expand_sorted(r["words"])) for r in table) == len(words)
    assert all((katz.expand(r["alphas"], np.float64) < 0).any() for r in table)
