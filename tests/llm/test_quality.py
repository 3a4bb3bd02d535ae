import numpy as np

from answerscope.llm import common, quality
from answerscope.llm.queries import QUERIES


def test_features_by_brute_force():
    words = ["a", "word", "ñandú", "$$$", "\U0001F600"]
    rows, sizes = quality.features(words)
    at = 0
    for word, n in zip(words, sizes):
        alone, size = quality.features([word])
        assert n == size[0] == 1 + sum(max(0, len(word) + 2 - g + 1) for g in quality.GRAMS)
        assert sorted(rows[at:at + n]) == sorted(alone)
        at += n
    assert quality.repeats("a b c d a b c".split()) == 1
    assert quality.repeats(["a"]) == 0


def test_folded_model_scores_as_the_vectors_do():
    rng = np.random.default_rng(2)
    memory = common.Memory(quality.rows_by_word)
    texts = ["good fine prose here", "*** $$$ bad bad bad bad ###"] * 5
    model = quality.train([(*quality.counted(t, memory), k % 2) for k, t in enumerate(texts)])
    scores = model.scores(texts[:2] + [""], common.Memory(model.sums_by_word))
    assert scores[0] < 0.3 < 0.7 < scores[1]
    rows, counts = quality.counted(texts[1], memory)
    want = 1 / (1 + np.exp(-(model.weights[rows] @ counts / counts.sum() + model.bias)))
    assert abs(scores[1] - want) < 1e-4
    assert 0 <= scores[2] <= 1 and rng is not None


def test_held_out_accuracy(spark):
    dir_ = "/root/testdata/sf0.01"
    got = QUERIES["op3_quality"](spark, dir_).join(common.table(spark, dir_, "labels"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.9
    assert got[got["quality"] == 1]["predicted"].mean() > 0.97


def test_awkward_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (14, 0), (16, 1), (3, None), (None, 1), (12, 7)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({round(r["score"], 12) for r in got if r["doc_id"] in (4, 5, 6)}) == 1
    assert quality.classify(none, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}
