"""Operator 11: approximate nearest neighbours by navigable small-world graphs.

Vectors are dealt to shards by their hash.  Each shard is one hierarchical graph, built in one
task and kept as one row of flat arrays (ids, vectors, neighbours of every layer), so an index is
an ordinary table.  Queries come in blocks; every shard is handed every block, walks its layers
for all queries of a block at once, and gives each query its nearest rows by exact distance.  The
shards' rows are merged by a window that keeps the first few of each query.

Equal vectors are one node of a graph with the least ``k + 1`` of their ids: no answer of ``k`` rows
can need more of them, and a vector that a third of all rows share weighs no more than another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from answerscope.llm import common

#: links a node keeps in upper layers (twice as many in the lowest); a layer has this many times the nodes of the one above
M = 16
#: how many nodes a search holds while building and while answering
EF_BUILD, EF = 80, 128
#: vectors a shard holds on average, and queries a block
SHARD_ROWS, BLOCK_ROWS = 8192, 256
#: nodes that one step of a search opens
WIDE = 4


class Graph:
    """The layers over ``vectors``, highest first in order of nodes: layer l holds the first ``sizes[l]`` nodes.

    ``links[l]`` has a row of neighbours for each of its nodes, -1 where there are fewer.  Walks use
    32-bit vectors scaled to the largest component.
    """

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray] | None = None):
        top = np.abs(vectors).max(initial=0.0)
        self.exact, self.scale = vectors, top if top > 0 else 1.0
        self.vectors = self.scaled(vectors)
        self.links = links if links is not None else self.built()

    def scaled(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors / self.scale).astype(np.float32)

    def built(self) -> list[np.ndarray]:
        sizes = [len(self.vectors)]
        while sizes[-1] > 2 * M:
            sizes.append(sizes[-1] // M)
        layers: list[np.ndarray] = []
        for size in reversed(sizes):
            layer = np.full((size, M if size < sizes[0] else 2 * M), -1, np.int32)
            if not layers:
                # the highest layer is small: all its nodes are linked
                layer = np.full((size, max(layer.shape[1], size - 1)), -1, np.int32)
                for i in range(size):
                    layer[i, :size - 1] = [j for j in range(size) if j != i]
                done = size
            else:
                above = layers[0]
                done, kept = len(above), min(above.shape[1], layer.shape[1])
                nearest = self._order(np.arange(done), above)
                layer[:done, :kept] = nearest[:, :kept]
            self.links = [layer, *layers]
            while done < size:
                stop = min(size, done + max(32, min(BLOCK_ROWS, done // 2)))
                self._insert(done, stop)
                done = stop
            layers = self.links
        return layers

    def _distances(self, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of nodes ``rows`` to ``ids`` (one row of them each), infinite for -1."""
        gap = self.vectors[ids] - self.vectors[rows][:, None]
        return np.where(ids < 0, np.float32(np.inf), np.einsum("ijk,ijk->ij", gap, gap))

    def _order(self, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.take_along_axis(ids, self._distances(rows, ids).argsort(axis=1, kind="stable"), axis=1)

    def _chosen(self, ids: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
        """``most`` of each row's candidates: first those nearer to the node than to any one chosen before, then the nearest others."""
        out = []
        for at in range(0, len(ids), 512):
            near, d = ids[at:at + 512], far[at:at + 512]
            order = d.argsort(axis=1, kind="stable")
            near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
            # seen from the nearest one, so that distances do not vanish beside the vectors' lengths
            held = self.vectors[near] - self.vectors[near[:, :1]]
            norms = np.einsum("ijk,ijk->ij", held, held)
            between = norms[:, :, None] + norms[:, None, :] - 2 * (held @ held.transpose(0, 2, 1))
            barred, picked, count = near < 0, np.zeros(near.shape, bool), np.zeros(len(near), int)
            for c in range(near.shape[1]):
                take = ~barred[:, c] & (count < most)
                picked[:, c] = take
                count += take
                barred |= take[:, None] & (between[:, c] < d)
            places = (~picked).argsort(axis=1, kind="stable")[:, :most]
            out.append(np.take_along_axis(near, places, 1))
        return np.concatenate(out)

    def _insert(self, start: int, stop: int) -> None:
        """Add nodes ``start`` to ``stop`` to the lowest layer present."""
        layer, new = self.links[0], np.arange(start, stop)
        found, far = self.walk(self.vectors[new], EF_BUILD)
        # nodes that come together may be near one another too
        peers = min(M, len(new) - 1)
        if peers:
            held = self.vectors[new] - self.vectors[new].mean(axis=0)
            norms = np.einsum("ij,ij->i", held, held)
            among = norms[:, None] + norms - 2 * held @ held.T
            np.fill_diagonal(among, np.inf)
            close = np.argpartition(among, peers - 1, axis=1)[:, :peers]
            found = np.concatenate([found, new[close].astype(np.int32)], 1)
            far = np.concatenate([far, np.take_along_axis(among, close, 1)], 1)
        chosen = self._chosen(found, far, M)
        layer[new, :chosen.shape[1]] = chosen
        # links back, the nearest first
        to, of = chosen.ravel(), np.repeat(new, chosen.shape[1])
        to, of = to[to >= 0], of[to >= 0]
        d = self._distances(to, of[:, None])[:, 0]
        order = np.lexsort((d, to))
        to, of = to[order], of[order]
        nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, counts)
        width = min(layer.shape[1], int(counts.max()))
        fresh = np.full((len(nodes), width), -1, np.int32)
        row, near = np.repeat(np.arange(len(nodes)), counts), place < width
        fresh[row[near], place[near]] = of[near]
        both = np.concatenate([layer[nodes], fresh], 1)
        # a link that stands already is not added twice
        repeated = (fresh[:, :, None] == layer[nodes][:, None, :]).any(axis=2)
        both[:, layer.shape[1]:][repeated] = -1
        full = (both >= 0).sum(axis=1) > layer.shape[1]
        packed = np.take_along_axis(both, (both < 0).argsort(axis=1, kind="stable"), 1)[:, :layer.shape[1]]
        if full.any():
            packed[full] = self._chosen(both[full], self._distances(nodes[full], both[full]), layer.shape[1])
        layer[nodes] = packed

    def walk(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` nodes found nearest to each query in the lowest layer present, nearest first (-1 where there are fewer)."""
        entry = np.zeros((len(queries), 1), np.int32)
        for layer in self.links[:0:-1]:
            entry = self._beam(layer, queries, entry, WIDE)[0]
        return self._beam(self.links[0], queries, entry, ef)

    def _beam(self, layer: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        # the last column is that of -1
        seen = np.zeros((len(queries), len(layer) + 1), bool)
        ids = np.full((len(queries), ef), -1, np.int32)
        far = np.full((len(queries), ef), np.inf, np.float32)
        shut = np.ones((len(queries), ef), bool)
        rows, fresh = np.arange(len(queries)), entry
        while len(rows):
            # the distances of nodes met for the first time
            seen[rows[:, None], fresh] = True
            r, c = np.nonzero(fresh >= 0)
            near = np.full(fresh.shape, np.inf, np.float32)
            met = fresh[r, c]
            gap = self.vectors[met] - queries[rows[r]]
            near[r, c] = np.einsum("ij,ij->i", gap, gap)
            both = np.concatenate([far[rows], near], 1)
            keep = np.argpartition(both, ef - 1, axis=1)[:, :ef]
            far[rows] = np.take_along_axis(both, keep, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], fresh], 1), keep, 1)
            shut[rows] = np.take_along_axis(np.concatenate([shut[rows], fresh < 0], 1), keep, 1)
            # open the nearest nodes that are still shut out
            ahead = np.where(shut[rows], np.float32(np.inf), far[rows])
            wide = min(WIDE, ef)
            best = np.argpartition(ahead, wide - 1, axis=1)[:, :wide]
            open_ = np.isfinite(np.take_along_axis(ahead, best, 1))
            going = open_.any(axis=1)
            rows, best, open_ = rows[going], best[going], open_[going]
            if not len(rows):
                break
            nodes = np.where(open_, np.take_along_axis(ids[rows], best, 1), -1)
            r, c = np.nonzero(open_)
            shut[rows[r], best[r, c]] = True
            fresh = np.where((nodes >= 0)[:, :, None], layer[nodes], -1).reshape(len(rows), -1)
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            fresh = np.where(seen[rows[:, None], fresh], -1, fresh)
        order = far.argsort(axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)

    def nearest(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and exact distances, ``ef`` of each query; a query whose walk met fewer, though there are more, meets all nodes."""
        ef = min(ef, len(self.exact))
        ids, _ = self.walk(self.scaled(queries), ef)
        short = (ids < 0).any(axis=1)
        for i in np.flatnonzero(short):
            ids[i] = np.argsort(((self.exact - queries[i]) ** 2).sum(axis=1), kind="stable")[:ef]
        gap = self.exact[ids] - queries[:, None, :]
        return ids, np.sqrt((gap * gap).sum(axis=2))


def vectors_of(rows: DataFrame) -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of the rows that take part, equal rows once.

    Rows without an id and vectors that are null, empty, zero or hold a null or non-finite component
    take no part.  Other columns are ignored.
    """
    common.importable(rows.sparkSession)
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    used = plain.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    # minus zero equals zero, as bytes too
    return used.select("vec_id", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector")).distinct()


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


INDEX = "shard int, dims int, kind int, part int, ids binary, starts binary, vectors binary, links binary, sizes binary"


def _row(shard: int, dims: int, kind: int, part: int, *arrays: np.ndarray) -> pa.RecordBatch:
    names = ["shard", "dims", "kind", "part", "ids", "starts", "vectors", "links", "sizes"]
    return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int32()) for x in (shard, dims, kind, part)], *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], names=names)


def build_index(rows: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index: one row per shard and vector length, holding its graph.  It serves searches for up to ``k`` rows.

    Every row of ``rows`` that takes part (see ``vectors_of``) is indexed.  Vectors of different length
    are in different graphs and never compared.
    """
    first = Window.partitionBy("vector").orderBy("vec_id")
    # Spark cuts each task's rows to the first ones of a vector before it shuffles them
    nodes = vectors_of(rows).withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).drop("place")
    nodes, told = common.written_and_told(nodes, "vectors", n=F.count(F.lit(1)))
    shards = max(1, -(-told["n"] // shard_rows))
    dealt = nodes.select(F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), F.size("vector").alias("dims"), "vec_id", "vector")

    def work(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                held.setdefault((own.column("shard")[0].as_py(), int(d)), []).append((own.column("vec_id").to_numpy(), matrix(own.column("vector"))))
        for (shard, d), parts in sorted(held.items()):
            ids, vectors = np.concatenate([p[0] for p in parts]), np.ascontiguousarray(np.concatenate([p[1] for p in parts]))
            kinds, node = np.unique(vectors.view(np.dtype((np.void, 8 * d))).ravel(), return_inverse=True)
            # nodes in an order that says nothing about their place
            order = np.random.default_rng(shard).permutation(len(kinds))
            node = np.argsort(order)[node]
            sort = np.lexsort((ids, node))
            starts = np.searchsorted(node[sort], np.arange(len(kinds) + 1))
            vectors = np.frombuffer(kinds[order].tobytes(), np.float64).reshape(-1, d)
            graph = Graph(vectors)
            yield _row(shard, d, 0, 0, ids[sort], starts.astype(np.int64), vectors, np.concatenate([x.ravel() for x in graph.links]), np.array([x.shape for x in graph.links], np.int64))

    return common.written(dealt.repartitionById(shards, "shard").mapInArrow(work, INDEX), "index")


def search(index: DataFrame, queries: DataFrame, k: int = 10, ef: int = EF) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``, ``query_key``: the nearest ``k`` rows found for each query, other than those of its own id.

    ``score`` is the Euclidean distance in doubles; equal ones rank by id.  Queries that repeat an
    id with different vectors are queries of their own, told apart by ``query_key``.
    """
    spark = queries.sparkSession
    asked, told = common.written_and_told(vectors_of(queries), "queries", n=F.count(F.lit(1)))
    shards = index.agg((F.max("shard") + 1).alias("n")).first()["n"] or 0
    blocks = max(1, -(-told["n"] // BLOCK_ROWS))
    if not shards or not told["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_key long")

    def pack(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                held.setdefault((own.column("part")[0].as_py(), int(d)), []).append((own.column("vec_id").to_numpy(), matrix(own.column("vector")), own.column("key").to_numpy()))
        none = np.empty(0, np.int64)
        for (part, d), parts in sorted(held.items()):
            ids, vectors, keys = (np.concatenate(p) for p in zip(*parts))
            yield _row(0, d, 1, part, ids, keys, vectors, none, none)

    block = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int").alias("part")
    packed = asked.select(block, F.size("vector").alias("dims"), "vec_id", "vector", F.xxhash64("vector").alias("key")).repartitionById(blocks, "part").mapInArrow(pack, INDEX)
    packed = common.written(packed, "blocks")
    handed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def work(batches):
        graph = None
        for batch in batches:
            for r in batch.to_pylist():
                read = lambda name, kind=np.int64: np.frombuffer(r[name], kind)
                vectors, ids = read("vectors", np.float64).reshape(-1, r["dims"]), read("ids")
                if r["kind"] == 0:
                    links, shapes = read("links", np.int32), read("sizes").reshape(-1, 2)
                    ends = np.cumsum(shapes.prod(axis=1))
                    graph = (r["shard"], r["dims"]), Graph(vectors, [links[e - a * b:e].reshape(a, b) for e, (a, b) in zip(ends, shapes)]), read("starts"), ids
                elif graph and graph[0] == (r["shard"], r["dims"]):
                    yield answers(graph[1], graph[2], graph[3], ids, read("starts"), vectors)

    def answers(graph, starts, members, ids, keys, vectors):
        nodes, far = graph.nearest(vectors, max(ef, k + 1))
        out = []
        for i, own in enumerate(ids):
            counts = starts[nodes[i] + 1] - starts[nodes[i]]
            at = np.arange(counts.sum()) + np.repeat(starts[nodes[i]] - np.cumsum(counts) + counts, counts)
            found, score = members[at], np.repeat(far[i], counts)
            found, score = found[found != own], score[found != own]
            best = np.lexsort((found, score))[:k]
            out.append((np.full(len(best), own), np.full(len(best), keys[i]), found[best], score[best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "query_key", "vec_id", "score"])

    # a shard's graph comes first in its partition, the blocks of queries stream past it
    rows = index.unionByName(handed).repartitionById(shards, "shard").sortWithinPartitions("dims", "kind", "part")
    found = rows.mapInArrow(work, "query_id long, query_key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_key")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, ef: int = EF) -> DataFrame:
    """The ``k`` nearest of ``rows`` for each of ``queries``, both (vec_id, embedding, ...): see ``build_index`` and ``search``.

    Null, empty, zero and non-finite vectors and rows without an id take no part, equal rows count
    once, an empty table on either side gives no row.
    """
    return search(build_index(rows, k, shard_rows), queries, k, ef)
