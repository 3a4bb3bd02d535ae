"""Operator 3: a quality classifier on learned subword embeddings.

A document is the average of the learned vectors of its words, their character n-grams and a
mark for every three-word window it repeats, all hashed into a fixed number of rows; a softmax
layer turns the average into probabilities.  Rows and layer are trained by stochastic gradient
descent in numpy on a bounded sample of labelled rows (``SAMPLE``).  For scoring, each row's
vector is folded with the output layer into one number, so a document costs a sum over words,
and a worker remembers the sums of the words it has met.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerscope.llm import common

ROWS, DIMENSIONS, EPOCHS, RATE = 1 << 17, 8, 10, 1.0
GRAMS = (3, 4)
#: the most labelled documents that are learned from: the first in order of a hash of their id
SAMPLE = 3000
#: row of the mark for a repeated window
REPEAT = 0


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all words one after another (the whole word, then its n-grams), and how many each word has."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.cumsum(sizes) - sizes
    word_of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[word_of]
    whole = np.add.reduceat(common.mixed(codes + (place.astype(np.uint64) << np.uint64(32))), starts) if len(words) else codes
    rows, owner = [whole], [np.arange(len(words))]
    for n in GRAMS:
        if len(codes) < n:
            continue
        inside = place[:len(codes) - n + 1] + n <= sizes[word_of[:len(codes) - n + 1]]
        key = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k:len(codes) - n + 1 + k]
        rows.append(key[inside])
        owner.append(word_of[:len(codes) - n + 1][inside])
    owner = np.concatenate(owner)
    rows = common.mixed(np.concatenate(rows)) % np.uint64(ROWS - 1) + np.uint64(1)
    order = np.argsort(owner, kind="stable")
    return rows[order].astype(np.int32), np.bincount(owner, minlength=len(words))


def repeats(words: list[str]) -> int:
    """How many three-word windows are equal to an earlier one."""
    return max(0, len(words) - 2) - len(set(zip(words, words[1:], words[2:])))


def words_of(text: str) -> list[str]:
    """Words between ASCII white space."""
    return text.encode().split()


def counted(text: str, memory: common.Memory) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a text and how often it has each."""
    words = words_of(text)
    memory.learn(set(words))
    rows = np.concatenate([np.full(repeats(words), REPEAT, np.int32), *map(memory.__getitem__, words)])
    return np.unique(rows, return_counts=True)


def rows_by_word(words: list[bytes]) -> list[np.ndarray]:
    rows, sizes = features([w.decode() for w in words])
    return np.split(rows, np.cumsum(sizes)[:-1])


@dataclass
class Model:
    """Per row its vector folded with the output layer, and the layer's own term."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str], memory: common.Memory) -> list[float]:
        cut = [words_of(t) for t in texts]
        memory.learn(set().union(*cut))
        out = []
        for words in cut:
            sums, n = np.array([memory[w] for w in words], float).reshape(-1, 2).sum(axis=0) if words else (0.0, 0.0)
            again = repeats(words)
            average = (sums + again * float(self.weights[REPEAT])) / max(1.0, n + again)
            out.append(float(1 / (1 + np.exp(-(average + self.bias)))))
        return out

    def sums_by_word(self, words: list[bytes]) -> list[tuple[float, float]]:
        rows, sizes = features([w.decode() for w in words])
        ends = np.cumsum(sizes)
        total = np.concatenate([[0.0], np.cumsum(self.weights[rows], dtype=float)])
        return list(zip((total[ends] - total[ends - sizes]).tolist(), sizes.astype(float).tolist()))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 5) -> Model:
    """Stochastic gradient descent, one document at a time, the rate falling to nothing; no example gives even odds."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (ROWS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            rows, counts, label = examples[k]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            share = (counts / max(1, counts.sum())).astype(np.float32)
            own = vectors[rows]
            average = share @ own
            odds = layer @ average + bias
            wrong = np.exp(odds - odds.max())
            wrong /= wrong.sum()
            wrong[label] -= 1
            back = layer.T @ wrong
            layer -= rate * np.outer(wrong, average)
            bias -= rate * np.float32(0.1) * wrong
            vectors[rows] = own - (rate * share * len(rows) ** 0.5)[:, None] * back
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> Model:
    """A model of ``labels.quality`` from at most ``sample`` rows whose id is not held out.

    An id labelled twice counts with its least label; null labels and labels other than 0 and 1
    are left out.  The labelled rows are chosen by a hash of the id, the same at every run.
    """
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
              .where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~common.held_out(folds)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def work(batches):
        memory = common.Memory(rows_by_word, 200_000)
        for batch in common.slices(batches):
            got = [counted(t, memory) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array([r.astype(np.int32).tobytes() for r, _ in got], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in got], pa.binary())],
                names=["doc_id", "quality", "rows", "counts"])

    held = common.texts_of(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(work, "doc_id long, quality int, rows binary, counts binary")
    found = sorted(held.collect(), key=lambda r: (r["doc_id"], r["quality"], bytes(r["rows"])))
    return train([(np.frombuffer(r["rows"], np.int32), np.frombuffer(r["counts"], np.int32), r["quality"]) for r in found])


def score(docs: DataFrame, model: Model, row: bool = False) -> DataFrame:
    """``doc_id``, ``score`` of every whole text, and all its columns in ``row`` if asked for.

    Null and empty texts get the score of the bias alone.
    """
    texts = common.texts_of(docs, row)
    kept = texts.columns[2:]

    def work(batches):
        memory = common.Memory(model.sums_by_word, 400_000)
        for batch in common.slices(batches):
            found = pa.array(model.scores(batch.column("text").to_pylist(), memory), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found, *[batch.column(c) for c in kept]], names=["doc_id", "score", *kept])

    return texts.mapInArrow(work, T.StructType([texts.schema["doc_id"], T.StructField("score", T.DoubleType()), *[texts.schema[c] for c in kept]]))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, least: float = 0.3) -> DataFrame:
    """Every document's score and verdict; repeated rows and null ids are carried, other columns ignored."""
    scored = score(docs, learn(docs, labels, folds))
    return scored.select("doc_id", common.held_out(folds).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
