"""Operator 7: near duplicates by one-permutation hashing.

One hash of every shingle both picks a bin and gives the value; a bin's least value is its
signature and empty bins borrow from the first occupied one in a fixed random order of their
own (optimal densification).  Documents with equal sets are one node.  Nodes meet in the buckets
of banded signatures, and a bucket yields star-shaped candidate edges (centre to member), which are
verified on full sets.  The centre of a bucket is the node that shares most buckets with most
others.  First every node is tested with one centre, that of the bucket whose centre is the most
common; then with its other centres, where these are in another component by then.

A bucket that still holds several components is left to an exact way: nodes of such buckets meet by
their rarest shingles, as many of each node as any partner must share one of, where these are rare
enough in both and the sizes of both allow it.  Work is linear in members but for these lists, which
pair a component's nodes only with those of others.  No bucket is capped and none is gathered in a
task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from answerscope.llm import common

#: bins and bins a band: 42 bands of 6 miss a pair of similarity 0.8 with probability 3e-6
BINS, ROWS = 252, 6


def borrowing(bins: int = BINS, seed: int = 11) -> np.ndarray:
    """``[i, j]``: how late bin i asks bin j for a value."""
    return np.random.default_rng(seed).random((bins, bins)).argsort(axis=1).argsort(axis=1).astype(np.int32)


def signature(hashes: np.ndarray, late: np.ndarray) -> np.ndarray:
    """One value per bin of a non-empty set of distinct 64-bit hashes."""
    bins = len(late)
    bin_of = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    values = np.full(bins, np.uint64(2**64 - 1))
    order = np.argsort(hashes)  # bins ascend with the hash, so the first of each bin is its least
    occupied, first = np.unique(bin_of[order], return_index=True)
    values[occupied] = hashes[order][first]
    empty = np.setdiff1d(np.arange(bins), occupied, assume_unique=True)
    if len(empty):
        values[empty] = values[occupied[late[np.ix_(empty, occupied)].argmin(axis=1)]]
    return values


def bands(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One bucket key per band of ``rows`` values, different bands having different keys."""
    grid = values.reshape(-1, rows)
    key = common.mixed(np.arange(len(grid), dtype=np.uint64) + np.uint64(1))
    for k in range(rows):
        key = common.mixed(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
    return key.view(np.int64)


SIGNED = "doc_id long, mark long, n_shingles long, high long, low long, bands array<long>"


def signed(docs: DataFrame, width: int) -> DataFrame:
    """Every document's set size, 128-bit digest of its set and bucket keys (none for an empty set); ``mark`` is a hash of its text."""
    def work(batches):
        hashes, late = common.WordHashes(), borrowing()
        for batch in common.slices(batches):
            sizes, digests, keys = [], [], []
            for text in batch.column("text").to_pylist():
                own = np.unique(common.shingles(text, hashes, width))
                sizes.append(len(own))
                digests.append(digest(own))
                keys.append(bands(signature(own, late)) if len(own) else np.empty(0, np.int64))
            high, low = np.array(digests).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(np.ascontiguousarray(high)), pa.array(np.ascontiguousarray(low)),
                 common.list_array(np.concatenate(keys), [len(k) for k in keys], pa.int64())], names=["doc_id", "mark", "n_shingles", "high", "low", "bands"])

    return common.texts_of(docs).withColumn("mark", text_mark()).mapInArrow(work, SIGNED)


def text_mark() -> Column:
    """What tells rows of one id apart: a hash of the text, null counting as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def digest(own: np.ndarray) -> np.ndarray:
    return np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)


def sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node`` and its set of shingles (sorted distinct 64-bit hashes, as bytes), of nodes (node, doc_id, high, low)."""
    def work(batches):
        hashes = common.WordHashes()
        for batch in common.slices(batches):
            own = [np.unique(common.shingles(t, hashes, width)) for t in batch.column("text").to_pylist()]
            high, low = np.array([digest(x) for x in own]).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.ascontiguousarray(high)), pa.array(np.ascontiguousarray(low)), pa.array([x.tobytes() for x in own], pa.binary())],
                                             names=["doc_id", "high", "low", "shingles"])

    # an id may stand for several texts: theirs are told apart by digest
    texts = common.texts_of(docs).join(nodes.select("doc_id").distinct(), "doc_id", "left_semi")
    found = texts.mapInArrow(work, "doc_id long, high long, low long, shingles binary").join(nodes.select("node", "doc_id", "high", "low"), ["doc_id", "high", "low"])
    return found.groupBy("node").agg(F.first("shingles").alias("shingles")).select("node", "shingles")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the least node reachable) of the nodes of edges ``a``, ``b``.

    Alternating large and small stars (each node hooks its neighbours to its least one); every
    round is a written table, and the number of rounds grows with the logarithm of the longest path.
    """
    state = {"n": F.count(F.lit(1)), "hash": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    now, before = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), None
    while True:
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.a", "e.b")
        now, after = common.written_and_told(small.where("a <> b").distinct(), "edges", **state)
        if after == before:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = after


#: a centre's pairs are shared by so many groups, each of which gets the centre's set once
SALTS = 1024


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 x intersection >= percent x union.

    A set of ``a`` is sent once to each group of its pairs, not with every pair, so that a centre of
    many costs no more than its members.
    """
    def work(batches):
        centre, own = None, None
        for batch in batches:
            found = []
            for a, salt, b, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "shingles"))):
                x = np.frombuffer(raw, np.uint64)
                if b is None:
                    centre, own = (a, salt), x
                elif centre == (a, salt) and 100 * min(len(x), len(own)) >= percent * max(len(x), len(own)):
                    both = np.sort(np.concatenate([x, own]))
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(both) - shared):
                        found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    heads = dealt.select("a", "salt").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    tails = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "shingles")
    return heads.unionByName(tails).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(work, "a long, b long")


def linked(docs: DataFrame, base: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame | None:
    """``node``, ``component`` of all nodes with a verified link."""
    keyed = base.where("n_shingles > 0").join(nodes.select("node", "doc_id", "high", "low"), ["doc_id", "high", "low"]).select("node", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("bucket", "size")
    members, told = common.written_and_told(keyed.join(shared, "bucket").select("bucket", "node", "size").distinct(), "members", n=F.count(F.lit(1)))
    if not told["n"]:
        return None
    sets = common.written(sets_of(docs, nodes.join(members.select("node").distinct(), "node", "left_semi"), width), "sets")
    common_ = members.groupBy("node").agg(F.sum("size").alias("total"))
    rank = F.struct("total", (-F.col("node")).alias("least"), "node")
    centres = members.join(common_, "node").groupBy("bucket").agg(F.max(rank).alias("c")).select("bucket", F.col("c.node").alias("centre"), F.col("c.total").alias("total"))
    stars = common.written(members.join(centres, "bucket").select("bucket", "node", "centre", "total"), "stars")

    first = stars.groupBy("node").agg(F.max(F.struct("total", (-F.col("centre")).alias("least"), "centre")).alias("c")).select(F.col("c.centre").alias("a"), F.col("node").alias("b"))
    tested = common.written(first.where("a <> b"), "pairs")
    found = common.written(verified(tested, sets, percent), "links")

    def placed(rows: DataFrame, found: DataFrame) -> DataFrame:
        """Rows (node, ...) with the component of the node."""
        return rows.join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node"))

    def others(rows: DataFrame) -> DataFrame:
        """Rows of buckets that hold several components."""
        mixed = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        return rows.join(mixed.select("bucket"), "bucket")

    open_, told = common.written_and_told(others(placed(stars.select("bucket", "node", "centre"), found)), "open", n=F.count(F.lit(1)))
    if told["n"]:
        # stars between components: the component of a centre is that of the bucket's row of it
        of = open_.where("node = centre").select("bucket", F.col("component").alias("of"))
        more = open_.join(of, "bucket").where("component <> of").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        more = common.written(more, "pairs")
        tested = tested.unionByName(more)
        found = found.unionByName(common.written(verified(more, sets, percent), "links"))
        # a centre has been tested with every member of its bucket: only pairs of others are left
        rest = placed(open_.where("node <> centre").select("bucket", "node"), found)
        open_, told = common.written_and_told(others(rest), "open", n=F.count(F.lit(1)))
    if told["n"]:
        rest = common.written(candidates(open_, sets, percent, tested), "pairs")
        found = found.unionByName(common.written(verified(rest, sets, percent), "links"))
    return components(found)


#: sizes within this factor share a band; candidates meet where each is in a band the other allows
BAND = 1.1


def candidates(open_: DataFrame, sets: DataFrame, percent: int, tested: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of open buckets (bucket, node, component) that may be linked, are in different components and were not tested.

    All nodes order shingles alike: those held by fewer nodes first, those held by the same nodes
    (one changed word changes several) side by side as one run.  The first run that two nodes have in
    common starts early in both: they share no more than what either has from there on, and a link to
    a set of m shingles takes percent / (100 + percent) x (n + m) common ones.  So a run of a node
    tells which sizes of a partner it may be the first common run with; runs too late for any size
    are left out, and two nodes meet where both allow the other's size.  Of the components that hold
    a run every pair has a side outside the largest, so one side is always such a node.
    """
    def work(batches):
        for batch in batches:
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist()):
                own = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node)), pa.array(own)], names=["node", "shingle"])

    sized = sets.select("node", (F.octet_length("shingles") / 8).cast("long").alias("n"))
    nodes = open_.select("node", "component").distinct().join(sized, "node")
    shingles = common.written(sets.join(nodes.select("node"), "node", "left_semi").mapInArrow(work, "node long, shingle long"), "shingles")
    held = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.bit_xor(F.xxhash64("node")).alias("list")).where("df > 1")
    runs = shingles.join(held, "shingle").groupBy("node", "df", "list").agg(F.min("shingle").alias("shingle"), F.count(F.lit(1)).alias("length"))
    # shingles of the run and of all later ones: what a pair that first meets here can share at most
    later = Window.partitionBy("node").orderBy(F.desc("df"), F.desc("list")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.join(nodes, "node").withColumn("most_shared", F.sum("length").over(later))
    least = F.ceil(F.col("n") * percent / 100)
    most = F.least(F.floor(F.col("n") * 100 / percent), F.floor(F.col("most_shared") * (100 + percent) / percent) - F.col("n"))
    early = common.written(runs.select("shingle", "node", "component", "n", least.alias("least"), most.alias("most")).where("least <= most"), "runs")
    per = early.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = per.groupBy("shingle").agg(F.max(F.struct("size", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    band = lambda size: F.floor(F.log(size) / math.log(BAND))
    rows = early.join(mixed.select("shingle", F.col("top.component").alias("top")), "shingle").withColumn("outer", F.col("component") != F.col("top"))
    rows = rows.select("*", band("n").alias("band"), F.explode(F.sequence(band("least"), band("most"))).alias("to"))
    one = rows.where("outer").select("shingle", F.col("band").alias("x"), F.col("to").alias("y"), F.col("node").alias("i"), F.col("component").alias("of"), "n", "least", "most")
    other = rows.select("shingle", F.col("to").alias("x"), F.col("band").alias("y"), F.col("node").alias("j"), "component", "outer", F.col("n").alias("m"), F.col("least").alias("low"), F.col("most").alias("high"))
    fits = F.expr("component <> of AND m BETWEEN least AND most AND n BETWEEN low AND high AND (i < j OR NOT outer)")
    met = one.join(other, ["shingle", "x", "y"]).where(fits)
    near = met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    either = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return near.join(either, ["a", "b"], "left_anti")


def neardup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``mark``, ``component`` of every row.

    Words are ASCII lower-cased; documents are linked when 100 x intersection >= percent x union
    of their shingle sets.  ``component_id`` is the least id of the component.  Null texts and texts
    without words have the empty set and stand alone; rows that repeat an id with different texts are
    documents of their own, told apart by ``mark`` (a hash of the text); a row without an id has no
    component and is kept.  ``component`` numbers components (null where a row stands alone).  An
    empty table gives no row.  Sets are compared by 64-bit hashes of their shingles.
    """
    base = common.written(signed(docs, width), "signed")
    nodes = base.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("high", "low").agg(F.min("doc_id").alias("doc_id"))
    nodes = common.written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = linked(docs, base, nodes, width, percent)
    placed = nodes if labels is None else nodes.join(labels, "node", "left")
    placed = placed.withColumn("component", F.col("node") if labels is None else F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(least, "component").select("high", "low", "component", "component_id")
    known = F.col("doc_id").isNotNull()
    out = base.select("doc_id", "mark", "n_shingles", "high", "low").join(named, ["high", "low"], "left")
    out = out.select("doc_id", "n_shingles", F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"), "mark", F.when(known, F.col("component")).alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).select("doc_id", "n_shingles", "component_id", "kept", "mark", "component")


def oracle(width: int, documents: str = "documents") -> str:
    """The same links by comparing all sets that share a shingle, in DuckDB."""
    window = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return rf"""
nd_words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {documents}),
nd_sets AS (
  SELECT DISTINCT doc_id, {window} AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM nd_words WHERE len(w) >= {width})
  UNION ALL SELECT doc_id, '#' || len(w) || ' ' || array_to_string(w, ' ') FROM nd_words WHERE len(w) BETWEEN 1 AND {width - 1}),
nd_sizes AS (SELECT doc_id, count(*) AS n FROM nd_sets GROUP BY doc_id),
nd_pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM nd_sets x JOIN nd_sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
nd_links AS (SELECT a, b FROM nd_pairs p JOIN nd_sizes x ON x.doc_id = a JOIN nd_sizes y ON y.doc_id = b WHERE 100 * both_have >= 80 * (x.n + y.n - both_have)),
nd_reach AS (SELECT doc_id AS node, doc_id AS found FROM {documents} UNION SELECT r.node, l.b FROM nd_reach r JOIN nd_links l ON l.a = r.found),
nd_found AS (SELECT node, min(found) AS component_id FROM nd_reach GROUP BY node)"""


ORACLE = f"""WITH RECURSIVE {oracle(4)}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN nd_sizes USING (doc_id) JOIN nd_found ON node = d.doc_id"""
