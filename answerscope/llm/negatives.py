"""Operator 12: hard negatives by exact integer scores from subset-sum tables (Four Russians).

Candidates are dealt to blocks and kept as packed bit planes: plane b holds bit b of every
component in two's complement, eight components a byte.  For eight components of an anchor a table
holds the sums of all 256 subsets, so a candidate's byte is an index into it; the sums of a plane
are added over the groups of eight and the planes by doubling, highest first and with its sign.
That is the whole inner product, exact to the bit.

Anchors come in blocks too, and every candidate block is handed every block of them.  A first
pass finds each anchor's positives among the rows of its label, a second one its negatives among
the others; both leave each block with the few best rows of an anchor, merged by windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from answerscope.llm import common
from answerscope.llm.nearest import matrix

#: rows a block of candidates or anchors holds on average, and candidates scored at a time
BLOCK_ROWS, ANCHOR_ROWS, SLICE = 16384, 256, 2048


def bit_planes(values: np.ndarray) -> np.ndarray:
    """``[plane, row, group]``: the bits of 64-bit integers, lowest plane first, the highest being the sign."""
    top = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1)
    planes = top.bit_length() + 1
    padded = np.pad(values, ((0, 0), (0, -values.shape[1] % 8))).view(np.uint64)
    return np.stack([np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little") for b in range(planes)])


def subset_sums(anchors: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """``[group, subset, anchor]``: sums of each anchor's components over all subsets of eight."""
    padded = np.pad(anchors, ((0, 0), (0, -anchors.shape[1] % 8))).astype(kind).T
    tables = []
    for group in padded.reshape(-1, 8, len(anchors)):
        sums = np.zeros((1, len(anchors)), kind)
        for x in group:
            sums = np.concatenate([sums, sums + x])
        tables.append(sums)
    return np.stack(tables) if tables else np.zeros((0, 256, len(anchors)), kind)


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """``[row, anchor]``: inner products.  Sums wrap at the table's width, so they are exact wherever the product fits."""
    out = []
    for at in range(0, planes.shape[1], SLICE):
        total = None
        for plane in planes[::-1, at:at + SLICE]:
            own = np.zeros((len(plane), tables.shape[2]), tables.dtype)
            for group, table in enumerate(tables):
                own += table.take(plane[:, group], axis=0)
            total = -own if total is None else (total << 1) + own
        out.append(total)
    return np.concatenate(out) if out else np.zeros((0, tables.shape[2]), tables.dtype)


def rows_of(rows: DataFrame, label: Column, scale: int) -> DataFrame:
    """``vec_id``, ``label``, ``vector`` (floor of ``scale`` times the components) and ``key`` of the rows that take part, equal rows once.

    Rows without an id, a label or a vector and those with a null or non-finite component take no
    part.  Integers beyond 64 bits are held at the bound.
    """
    common.importable(rows.sparkSession)
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    used = plain.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    bound = lambda x: F.least(F.greatest(x, F.lit(-9.2e18)), F.lit(9.2e18))
    whole = used.select("vec_id", "label", F.transform("vector", lambda x: bound(F.lit(float(scale)) * x)).alias("v"))
    return whole.select("vec_id", "label", F.transform("v", lambda x: F.floor(x).cast("long")).alias("vector")).distinct().withColumn("key", F.xxhash64("label", "vector"))


PACKED = "block int, dims int, kind int, part int, ids binary, keys binary, labels binary, data binary, wanted binary"


def _packed(rows: DataFrame, blocks: int, kind: int) -> DataFrame:
    """Rows (block, dims, vec_id, key, label, vector) as one row per block and length, ordered by label and id; ``wanted`` (low, high, id, key) rides along."""
    def work(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                cols = [own.column(c).to_numpy() for c in ("label", "vec_id", "key")]
                wanted = [matrix(own.column("wanted"))] if "wanted" in own.schema.names else []
                held.setdefault((own.column("block")[0].as_py(), int(d)), []).append((*cols, matrix(own.column("vector")), *wanted))
        for (block, d), parts in sorted(held.items()):
            label, ids, keys, vectors, *wanted = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort((keys, ids, label))
            data = bit_planes(vectors[order]) if kind == 0 else vectors[order]
            rest = wanted[0][order] if wanted else np.empty(0, np.int64)
            place = (block, 0) if kind == 0 else (0, block)
            yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int32()) for x in (place[0], d, kind, place[1])], *[pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (ids[order], keys[order], label[order], data, rest)]],
                                             names=["block", "dims", "kind", "part", "ids", "keys", "labels", "data", "wanted"])

    return common.written(rows.repartitionById(blocks, "block").mapInArrow(work, PACKED), "packed")


def _met(candidates: DataFrame, anchors: DataFrame, blocks: int, of_block, schema: str) -> DataFrame:
    """``of_block(candidates, anchors)`` of every block of candidates with every block of anchors of the same length."""
    def work(batches):
        held = None
        for batch in batches:
            for r in batch.to_pylist():
                read = {c: np.frombuffer(r[c], np.int64) for c in ("ids", "keys", "labels")}
                n, d = len(read["ids"]), max(1, r["dims"])
                if r["kind"] == 0:
                    held = (r["block"], r["dims"]), read | {"planes": np.frombuffer(r["data"], np.uint8).reshape(-1, n, -(-d // 8))}
                elif held and held[0] == (r["block"], r["dims"]):
                    read |= {"vectors": np.frombuffer(r["data"], np.int64).reshape(n, d), "wanted": np.frombuffer(r["wanted"], np.int64)}
                    found = list(of_block(held[1], read))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=[f.split()[0] for f in schema.split(", ")])

    handed = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # a block of candidates comes first in its partition, the blocks of anchors stream past it
    return candidates.unionByName(handed).repartitionById(blocks, "block").sortWithinPartitions("dims", "kind", "part").mapInArrow(work, schema)


def _tables(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Subset sums, 32 bits wide where every product surely fits."""
    most = (int(np.abs(vectors).max(initial=0)) + 1) * vectors.shape[1] << len(planes)
    return subset_sums(vectors, np.int32 if most < 2**31 else np.int64)


def _positives(most: int):
    def of_block(c: dict, a: dict):
        for label in np.unique(a["labels"]):
            lo, hi = int(np.searchsorted(c["labels"], label, "left")), int(np.searchsorted(c["labels"], label, "right"))
            if lo == hi:
                continue
            who, planes, ids, keys = np.flatnonzero(a["labels"] == label), c["planes"][:, lo:hi], c["ids"][lo:hi], c["keys"][lo:hi]
            found = scores(planes, _tables(a["vectors"][who], planes))
            for i, s in zip(who, found.T):
                at = np.flatnonzero(ids != a["ids"][i])
                s = s[at].astype(np.int64)
                if len(s) > most:
                    few = np.flatnonzero(s >= np.partition(s, len(s) - most)[len(s) - most])
                    at, s = at[few], s[few]
                best = np.lexsort((keys[at], ids[at], -s))[:most]
                if len(best):
                    yield np.full(len(best), a["ids"][i]), np.full(len(best), a["keys"][i]), ids[at][best], keys[at][best], s[best]

    return of_block


def _negatives(most: int):
    def of_block(c: dict, a: dict):
        n = len(a["ids"])
        wanted = a["wanted"].reshape(n, -1, 4)
        for label in np.unique(a["labels"]):
            lo, hi = int(np.searchsorted(c["labels"], label, "left")), int(np.searchsorted(c["labels"], label, "right"))
            other = np.r_[0:lo, hi:len(c["labels"])]
            if not len(other):
                continue
            who, planes, ids, keys = np.flatnonzero(a["labels"] == label), c["planes"][:, other], c["ids"][other], c["keys"][other]
            found = scores(planes, _tables(a["vectors"][who], planes))
            for i, s in zip(who, found.T):
                s = s.astype(np.int64)
                for least, greatest, positive, positive_key in wanted[i]:
                    at = np.flatnonzero((s >= least) & (s <= greatest))
                    if len(at) > most:
                        own = s[at]
                        at = at[own >= np.partition(own, len(at) - most)[len(at) - most]]
                    best = at[np.lexsort((keys[at], ids[at], -s[at]))[:most]]
                    if len(best):
                        same = lambda x: np.full(len(best), x)  # noqa: B023, E731
                        yield same(a["ids"][i]), same(a["keys"][i]), same(positive), same(positive_key), ids[best], keys[best], s[best]

    return of_block


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, anchor_key long, positive_key long"


def hard_negatives(rows: DataFrame, anchors: str, label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor and positive the first ``negatives`` rows of other labels whose scores are ``low`` to ``high`` percent of the positive's.

    ``rows`` holds vec_id, embedding and label; ``anchors`` is a condition on vec_id that anchors meet.  A score is
    the inner product of the components' integers; higher ones come first, ties by smaller vec_id.
    Positives are the first ``positives`` rows of the anchor's label under other ids.

    Rows without an id, label or vector and those with a null or non-finite component take no part
    (see ``rows_of``); equal rows count once; rows that share an id with another label or vector are
    rows of their own, told apart by ``anchor_key`` and ``positive_key``.  Vectors of different length have
    no score.  Empty vectors score 0.  An empty table gives no row.
    """
    spark = rows.sparkSession
    label = F.col("label") if label is None else label
    used, told = common.written_and_told(rows_of(rows, label, scale), "rows", n=F.count(F.lit(1)), asked=F.count_if(F.expr(anchors)))
    if not told["asked"]:
        return spark.createDataFrame([], RESULT)
    blocks, parts = (max(1, -(-told[k] // size)) for k, size in (("n", BLOCK_ROWS), ("asked", ANCHOR_ROWS)))
    # an empty vector is held as one zero
    dealt = lambda df, n: df.withColumn("block", F.pmod(F.xxhash64("vec_id", "key"), F.lit(n)).cast("int")).withColumn("dims", F.size("vector")).withColumn(
        "vector", F.when(F.col("dims") > 0, F.col("vector")).otherwise(F.array(F.lit(0).cast("long"))))
    candidates = _packed(dealt(used, blocks), blocks, 0)
    asked = used.where(anchors)
    mine = ["anchor_id", "anchor_key"]

    found = _met(candidates, _packed(dealt(asked, parts), parts, 1), blocks, _positives(positives), "anchor_id long, anchor_key long, positive_id long, positive_key long, positive_score long")
    place = F.row_number().over(Window.partitionBy(*mine).orderBy(F.col("positive_score").desc(), "positive_id", "positive_key"))
    best = common.written(found.withColumn("place", place).where(F.col("place") <= positives).drop("place"), "positives")

    # bounds as whole numbers: 100 x score >= low x positive and <= high x positive; decimals hold the products
    wide = lambda percent: F.col("positive_score").cast("decimal(20,0)") * F.lit(percent) / F.lit(100)
    held = lambda c: F.least(F.greatest(c, F.lit(-2**63).cast("decimal(20,0)")), F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long")
    bounds = best.select(*mine, F.array(held(F.ceil(wide(low))), held(F.floor(wide(high))), "positive_id", "positive_key").alias("w"))
    # an anchor has a handful of positives; empty places are bounds that nothing meets
    empty = F.array(*[F.lit(x).cast("long") for x in (1, 0, 0, 0)])
    per = bounds.groupBy(*mine).agg(F.collect_list("w").alias("w")).select(*mine, F.flatten(F.concat("w", F.array_repeat(empty, F.lit(positives) - F.size("w")))).alias("wanted"))
    joined = asked.join(per, (F.col("vec_id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key"))).drop(*mine)
    found = _met(candidates, _packed(dealt(joined, parts), parts, 1), blocks, _negatives(negatives), "anchor_id long, anchor_key long, positive_id long, positive_key long, negative_id long, negative_key long, negative_score long")
    pair = [*mine, "positive_id", "positive_key"]
    rank = F.row_number().over(Window.partitionBy(*pair).orderBy(F.col("negative_score").desc(), "negative_id", "negative_key"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return ranked.join(best, pair).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "anchor_key", "positive_key")


#: the query: ids divisible by 100 are anchors; every seventh id's label is moved on by one
ANCHORS = "vec_id % 100 = 0"


def noisy_label() -> Column:
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))


ORACLE = """WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score FROM used a JOIN used c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM pos JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10"""
