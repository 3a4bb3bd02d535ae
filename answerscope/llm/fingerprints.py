"""Operator 6: MinHash fingerprints by many universal hash functions.

A text's fingerprint is, for each of ``PERMUTATIONS`` functions x -> (a x + b) mod 2^64 >> 32,
the least value over its shingles of five words; the share of equal places estimates Jaccard
similarity.  ``similar`` joins bands of fingerprints in Spark and verifies the pairs on full
sets.  ``edits`` pairs each document with the next in order of ids without a global sort in one
task: rows are dealt by ranges of ids, and each range is handed the first text of the next.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.llm import common

PERMUTATIONS, WIDTH = 64, 5
#: rows a band: 16 bands of 4 find a pair of similarity 0.8 with probability 0.9998
ROWS = 4


def family(n: int = PERMUTATIONS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.random.default_rng(seed).integers(0, 2**63, (2, n, 1), np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def fingerprint(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of every function; all ones for an empty set.  Long texts go through in blocks."""
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(shingles), 2048):
        values = a * shingles[k:k + 2048]
        values += b
        least = np.minimum(least, (values.min(axis=1) >> np.uint64(32)).astype(np.uint32))
    return least


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float((x == y).mean())


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) of every whole text; texts without a word all have the same."""
    def work(batches):
        hashes, (a, b) = common.WordHashes(), family()
        for batch in common.slices(batches):
            found = [fingerprint(common.shingles(t, hashes, WIDTH), a, b).astype(">u4").tobytes().hex() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return common.texts_of(docs).mapInArrow(work, "doc_id long, fingerprint string")


MARKED = "doc_id long, n_shingles long, digest string, fingerprint string"


def marked(docs: DataFrame) -> DataFrame:
    """Every document's set size, SHA-256 of its sorted set of shingles, and fingerprint."""
    def work(batches):
        hashes, (a, b) = common.WordHashes(), family()
        for batch in common.slices(batches):
            sets = [np.unique(common.shingles(t, hashes, WIDTH)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.sha256(s.tobytes()).hexdigest() for s in sets], pa.string()),
                                              pa.array([fingerprint(s, a, b).astype(">u4").tobytes().hex() for s in sets], pa.string())], names=["doc_id", "n_shingles", "digest", "fingerprint"])

    return common.texts_of(docs).mapInArrow(work, MARKED)


def similar(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs of documents whose five-word shingle sets have Jaccard similarity ``least`` or more.

    ``a``, ``b``, ``similarity`` and the digests of the two sets, ``a_set`` and ``b_set``.  Documents
    of equal sets are a class, named by its least id.  Different sets are paired by those ids, and
    each such pair stands for all members of both classes; every other member has one row with its
    class's least id (similarity 1, the same digest twice).  Sets are told apart by their digest,
    never by their fingerprint: long texts that differ in a word mostly share all of it.

    ``a`` < ``b``; they are equal only where an id is repeated with different texts.  Texts without
    a word and rows without an id pair with nothing.
    """
    percent = round(least * 100)
    rows = common.written(marked(docs).where("n_shingles > 0 AND doc_id IS NOT NULL"), "marks")
    classes = rows.groupBy("digest").agg(*[F.min(c).alias(c) for c in ("doc_id", "n_shingles", "fingerprint")])
    classes = common.written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    step = 8 * ROWS
    bands = classes.select("node", "n_shingles", F.posexplode(F.expr(f"transform(sequence(0, {PERMUTATIONS // ROWS - 1}), i -> substring(fingerprint, i * {step} + 1, {step}))")).alias("band", "value"))
    bands = common.written(bands, "bands")
    # sets whose sizes alone keep them below the bound are not paired
    near = 100 * F.least("x.n_shingles", "y.n_shingles") >= percent * F.greatest("x.n_shingles", "y.n_shingles")
    pairs = bands.alias("x").join(bands.alias("y"), ["band", "value"]).where((F.col("x.node") < F.col("y.node")) & near)
    pairs = common.written(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "pairs")
    paired = classes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    # an id may stand for several sets: those of the classes are picked by digest
    sets = shingle_sets(common.texts_of(docs).join(paired.select("doc_id").distinct(), "doc_id", "left_semi"), WIDTH).withColumn("digest", F.sha2("shingles", 256))
    sets = sets.join(paired.select("digest", "node"), "digest").groupBy("node").agg(F.first("shingles").alias("shingles"))
    links = verified(pairs, sets.withColumnRenamed("node", "doc_id"), percent)
    end = lambda c: classes.select(F.col("node").alias(c), F.struct("doc_id", "digest").alias(f"{c}_end"))
    links = links.join(end("a"), "a").join(end("b"), "b").select(F.least("a_end", "b_end").alias("x"), F.greatest("a_end", "b_end").alias("y"), "similarity")
    heads = classes.select("digest", F.col("doc_id").alias("head"))
    copies = rows.select("doc_id", "digest").distinct().join(heads, "digest").where("doc_id > head").select(
        F.struct(F.col("head").alias("doc_id"), "digest").alias("x"), F.struct("doc_id", "digest").alias("y"), F.lit(1.0).alias("similarity"))
    return links.unionByName(copies).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), "similarity", F.col("x.digest").alias("a_set"), F.col("y.digest").alias("b_set"))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id`` and its set of shingles: sorted distinct 64-bit hashes, as bytes."""
    def work(batches):
        hashes = common.WordHashes()
        for batch in common.slices(batches):
            found = [np.unique(common.shingles(t, hashes, width)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "shingles"])

    return common.texts_of(docs).mapInArrow(work, "doc_id long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 x intersection >= percent x union, with their similarity."""
    def work(batches):
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.sort(np.concatenate([x, y]))
                common_ = int((both[1:] == both[:-1]).sum())
                union = len(both) - common_
                if 100 * common_ >= percent * union and union:
                    rows.append((a, b, common_ / union))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])

    held = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b"))
    return held.select("a", "b", "x", "y").mapInArrow(work, "a long, b long, similarity double")


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit by the next document in descending order of ids.

    The next of the last is the first; a single document is its own next.  Rows of one id are
    ordered by text; null ids come last; an empty table gives no row.
    """
    spark = docs.sparkSession
    texts = common.texts_of(docs)
    ranges = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = np.unique(np.array(texts.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.1 / ranges) or [], np.int64))

    def deal(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            part = len(bounds) - np.searchsorted(bounds, ids.fill_null(-2**63).to_numpy(zero_copy_only=False), "right")
            part[ids.is_null().to_numpy(zero_copy_only=False)] = len(bounds) + 1
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], names=["part", *batch.schema.names])

    # the first row of each range, in order; as many as ranges
    ids = texts.select("doc_id").mapInArrow(deal, "part int, doc_id long").groupBy("part").agg(F.max("doc_id").alias("doc_id"))
    heads = sorted(((r["part"], r["doc_id"]) for r in ids.collect()))
    if not heads:
        return spark.createDataFrame([], EDITS)
    # which range is handed the head of which: one small row a range
    handed = spark.createDataFrame([(part, doc_id, heads[k - 1][0]) for k, (part, doc_id) in enumerate(heads)], "of int, head long, to int")
    dealt = texts.mapInArrow(deal, "part int, doc_id long, text string")
    guests = dealt.join(F.broadcast(handed), (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head")))
    guests = guests.groupBy("to", "doc_id").agg(F.min("text").alias("text")).select(F.col("to").alias("part"), F.lit(1).alias("guest"), "doc_id", "text")
    rows = dealt.select("part", F.lit(0).alias("guest"), "doc_id", "text").unionByName(guests)
    rows = rows.repartition(F.col("part")).sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def work(batches):
        hashes, (a, b) = common.WordHashes(), family()
        held = None
        for batch in common.slices(batches):
            out = []
            for part, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text"))):
                mark = fingerprint(common.shingles(text, hashes, WIDTH), a, b)
                if held and held[0] == part:
                    _, last_id, last, last_mark = held
                    half = len(last) // 2
                    edited = last[:len(last) - half] + text[:half]
                    edited_mark = fingerprint(common.shingles(edited, hashes, WIDTH), a, b)
                    out.append((last_id, len(last), hashlib.sha256(edited.encode()).hexdigest(), last_mark.astype(">u4").tobytes().hex(),
                                edited_mark.astype(">u4").tobytes().hex(), likeness(last_mark, edited_mark), likeness(last_mark, mark)))
                held = None if guest else (part, doc_id, text, mark)
            if out:
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                                 names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.mapInArrow(work, EDITS)
