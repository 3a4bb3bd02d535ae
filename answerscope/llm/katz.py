"""Operator 5: a Katz backoff model of words, and the probability of every text under it.

    p(w | v) = d(c) c(v w) / c(v)      if the pair was seen c > 0 times
             = alpha(v) p(w)           otherwise

with Good-Turing discounts d from the counts of counts and alpha(v) such that the probabilities
after every word add up to one.  Words and pairs are 64-bit hashes.  Texts stay in blocks, the
rows of which hold some tens of megabytes of text as numbers; what has to meet from all blocks
are sorted lists of n-grams, cut by hash into buckets whose number grows with the corpus:

1. every block sends each bucket its words and pairs with their training counts; the bucket adds
   them up, answers with the totals in the block's own order, and notes the counts of counts;
2. every block scores its seen pairs; for the pairs it owns (one block owns each) it sends the
   masses that make up alpha, and asks for the alphas of the words its unseen pairs follow;
3. the buckets answer with alphas, and the blocks add them to their documents' scores.

No row, word or document is ever shuffled by itself, and a frequent word costs a bucket one
entry per block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.llm import common

#: counts up to this one are discounted by Good-Turing
LARGEST = 5
#: what larger counts give up, so that no word is left without mass for unseen followers
SLIGHT = 0.01
BLOCK_BYTES, BUCKET_ENTRIES = 16_000_000, 3_000_000
END = b"\n"  # no word: words have no white space


def squeeze(a: np.ndarray) -> bytes:
    """Numbers as bytes, the like bytes of all of them side by side, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def expand(b: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).reshape(-1)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b, np.uint64), dtype=np.uint64)


BLOCKS = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, tokens binary, words binary"


class _Ids(dict):
    def __missing__(self, word):
        self[word] = found = len(self)
        return found


def blocks_of(docs: DataFrame, folds: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents as blocks: ids, fold, sizes, tokens (numbers into ``words``, the end mark after each text) and word hashes."""
    def work(batches):
        import xxhash
        from pyspark import TaskContext

        state = {"k": 0}

        def begin():
            state.update(ids=_Ids({END: 0}), docs=[], held=[], tokens=[], bytes=0)

        def row():
            tokens = np.concatenate(state["tokens"])
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, state["ids"]), np.uint64, len(state["ids"]))
            order = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")  # frequent words get small numbers
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order), dtype=np.uint32)
            block = TaskContext.get().partitionId() << 24 | state["k"]
            state["k"] += 1
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            values = (block, state["docs"], state["held"], [len(t) for t in state["tokens"]], squeeze(number[tokens]), squeeze(hashes[order]))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["block", "doc_ids", "held", "sizes", "tokens", "words"])

        begin()
        for batch in common.slices(batches):
            for doc_id, text, held in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "held"))):
                data = text.encode().lower()
                words = data.split()
                words.append(END)
                state["tokens"].append(np.fromiter(map(state["ids"].__getitem__, words), np.uint32, len(words)))
                state["docs"].append(doc_id)
                state["held"].append(held)
                state["bytes"] += len(data)
                if state["bytes"] >= block_bytes:
                    yield row()
                    begin()
        if state["docs"]:
            yield row()

    return common.texts_of(docs).withColumn("held", common.held_out(folds)).mapInArrow(work, BLOCKS)


class Block:
    """The n-grams of one block, in the order in which they are sent."""

    def __init__(self, held: list[bool], sizes: list[int], tokens: bytes, words: bytes, bits: int):
        self.sizes = np.array(sizes, np.int64)
        self.tokens = expand(tokens, np.uint32).astype(np.int64)
        self.words = expand(words, np.uint64)
        self.train = ~np.repeat(np.array(held, bool), self.sizes)
        # every text ends with the mark, which is therefore the word before a text's first one; the block's last is it too
        self.codes = (np.concatenate([self.tokens[-1:], self.tokens[:-1]]) * len(self.words) + self.tokens).astype(np.uint64)
        marked = np.sort(self.codes << np.uint64(1) | self.train)
        first = np.flatnonzero(np.diff(marked >> np.uint64(1), prepend=np.uint64(2**64 - 1)))
        self.pairs = marked[first] >> np.uint64(1)
        self.pair_counts = np.add.reduceat((marked & np.uint64(1)).astype(np.int64), first)
        self.word_counts = np.bincount(self.tokens[self.train], minlength=len(self.words))
        self.before, self.after = np.divmod(self.pairs.astype(np.int64), len(self.words))
        self.word_order = np.argsort(self.words)
        keys = common.mixed(self.words[self.before] * np.uint64(0x9E3779B97F4A7C15) + common.mixed(self.words[self.after]))
        self.pair_keys = keys >> np.uint64(64 - bits) << np.uint64(64 - bits)
        self.pair_order = np.argsort(self.pair_keys)


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys, and their end."""
    edges = (np.arange(buckets + 1, dtype=object) * 2**64 + buckets - 1) // buckets
    return np.append(np.searchsorted(keys, np.array(edges[:-1].tolist(), np.uint64)), len(keys))


SENT = "bucket int, block long, words binary, word_counts binary, pairs binary, pair_counts binary"


def send(blocks: DataFrame, buckets: int, bits: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            for block, held, sizes, tokens, words in zip(*(batch.column(c).to_pylist() for c in ("block", "held", "sizes", "tokens", "words"))):
                b = Block(held, sizes, tokens, words, bits)
                w, wc, p, pc = b.words[b.word_order], b.word_counts[b.word_order], b.pair_keys[b.pair_order], b.pair_counts[b.pair_order]
                at, to = cuts(w, buckets), cuts(p, buckets)
                rows = [(k, block, squeeze_sorted(w[at[k]:at[k + 1]]), squeeze(wc[at[k]:at[k + 1]].astype(np.uint32)),
                         squeeze_sorted(p[to[k]:to[k + 1]]), squeeze(pc[to[k]:to[k + 1]].astype(np.uint32))) for k in range(buckets) if at[k] < at[k + 1] or to[k] < to[k + 1]]
                kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "block", "words", "word_counts", "pairs", "pair_counts"])

    return blocks.mapInArrow(work, SENT)


def totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every entry its key's total and whether it is the first that has some; the distinct keys and their totals."""
    key, count = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(key, kind="stable")
    first = np.diff(key[order], prepend=key[order[:1]] ^ np.uint64(1)) != 0 if len(key) else np.empty(0, bool)
    group, starts = np.cumsum(first) - 1, np.flatnonzero(first)
    sums = np.add.reduceat(count[order], starts) if len(starts) else np.empty(0, np.int64)
    some = np.flatnonzero(count[order] > 0)
    _, owners = np.unique(group[some], return_index=True)
    total, owner = np.empty(len(key), np.int64), np.zeros(len(key), bool)
    total[order] = sums[group]
    owner[order[some[owners]]] = True
    return total, owner, key[order][starts], sums


ANSWERED = "bucket int, block long, word_totals binary, pair_totals binary, words binary, pairs binary, stats array<long>"


def answer(sent: DataFrame) -> DataFrame:
    """Totals for every block in its own order, the lowest bit of a pair's marking its owner.

    One row per bucket (block null) is its part of the model: the n-grams, their counts and the
    counts of counts.  These rows are the partitioned tables of the model.
    """
    def work(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        out, stats, answers, model = [], [], [], []
        for name in ("word", "pair"):
            keys = [expand_sorted(r[f"{name}s"]) for r in rows]
            total, owner, distinct, sums = totals(keys, [expand(r[f"{name}_counts"], np.uint32) for r in rows])
            distinct, sums = distinct[sums > 0], sums[sums > 0]
            model += [squeeze(sums.astype(np.uint64)), squeeze_sorted(distinct)]
            stats += [len(sums), int(sums.sum()), *np.bincount(sums[sums <= LARGEST + 1], minlength=LARGEST + 2)[1:].tolist()]
            value = total if name == "word" else total << 1 | owner
            answers.append(np.split(value.astype(np.uint64), np.cumsum([len(k) for k in keys])[:-1]))
        for r, w, p in zip(rows, *answers):
            out.append((r["bucket"], r["block"], squeeze(w), squeeze(p), None, None, None))
        out.append((rows[0]["bucket"], None, model[0], model[2], model[1], model[3], stats))
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["bucket", "block", "word_totals", "pair_totals", "words", "pairs", "stats"])

    return sent.groupBy("bucket").applyInArrow(work, ANSWERED)


def discounts(counts: list[int]) -> np.ndarray:
    """d(0..LARGEST) from the number of n-grams seen 1, 2, ... LARGEST + 1 times.

    Katz's formula; where counts of counts are too few for it (a value outside 0 < d < 1), an
    absolute discount estimated from the n-grams seen once and twice.
    """
    n = [0, *counts]
    with np.errstate(all="ignore"):
        tail = (LARGEST + 1) * n[LARGEST + 1] / n[1] if n[1] else 1.0
        d = [((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail != 1 else 0.0 for r in range(1, LARGEST + 1)]
    if not all(0 < x < 1 for x in d):
        less = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [(r - min(max(less, 0.1), 0.9)) / r for r in range(1, LARGEST + 1)]
    return np.array([0.0, *d])


@dataclass
class Model:
    """What all blocks need: training tokens and words, discounts of words and pairs, mass of the unknown word."""

    tokens: int
    words: int
    word_discounts: np.ndarray
    pair_discounts: np.ndarray
    seen_mass: float  # the sum of discounted counts of words

    @staticmethod
    def of(word_stats: list[int], pair_stats: list[int]) -> Model:
        words, tokens, *few = word_stats
        d = discounts(few)
        seen = sum(n * r * d[r] for r, n in enumerate(few[:LARGEST], 1))
        many_words, many_tokens = words - sum(few[:LARGEST]), tokens - sum(r * n for r, n in enumerate(few[:LARGEST], 1))
        return Model(tokens, words, d, discounts(pair_stats[2:]), seen + many_tokens - SLIGHT * many_words)

    @staticmethod
    def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
        """d(c) c."""
        return np.where(counts > LARGEST, counts - SLIGHT, counts * d[np.minimum(counts, LARGEST)])

    @property
    def unknown(self) -> float:
        """The probability of an unknown word: what discounting left."""
        return max(1 - self.seen_mass / self.tokens, 1 / (self.tokens + self.words + 1)) if self.tokens else 1.0

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        """p(w) by the word's count; adds up to one with the unknown word's."""
        seen = (1 - self.unknown) * self.discounted(counts, self.word_discounts) / max(self.seen_mass, 1e-300)
        return np.where(counts > 0, seen, self.unknown)


SCORED = ("kind string, block long, bucket int, doc_ids array<long>, held array<boolean>, sizes array<int>, known array<long>, base array<double>, score array<double>, "
          "keys binary, masses binary, numbers binary, asked binary, events binary")


def _scored(kind, block, bucket=None, **more):
    kinds = {"kind": pa.string(), "block": pa.int64(), "bucket": pa.int32(), "doc_ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int32()), "known": pa.list_(pa.int64()),
             "base": pa.list_(pa.float64()), "score": pa.list_(pa.float64()), "keys": pa.binary(), "masses": pa.binary(), "numbers": pa.binary(), "asked": pa.binary(), "events": pa.binary()}
    row = {"kind": kind, "block": block, "bucket": bucket} | more
    return pa.RecordBatch.from_arrays([pa.array([row.get(k)], t) for k, t in kinds.items()], names=list(kinds))


def score_blocks(blocks: DataFrame, answers: DataFrame, model: Model, buckets: int, bits: int) -> DataFrame:
    """Scores but for the alphas; the masses of owned pairs by word; the words whose alphas are asked for."""
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,), out = left.to_pylist(), []
        b = Block(row["held"], row["sizes"], row["tokens"], row["words"], bits)
        replies = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        counts, sums = np.empty(len(b.words), np.int64), np.empty(len(b.pairs), np.int64)
        counts[b.word_order] = np.concatenate([expand(r["word_totals"], np.uint64) for r in replies]).astype(np.int64)
        sums[b.pair_order] = np.concatenate([expand(r["pair_totals"], np.uint64) for r in replies]).astype(np.int64)
        owned, sums = (sums & 1).astype(bool), sums >> 1
        p = model.word_probability(counts)
        mass = model.discounted(sums, model.pair_discounts)
        seen = sums > 0
        gain = np.where(seen, np.log10(np.where(seen, mass, 1)) - np.log10(np.maximum(counts[b.before], 1)), np.log10(p[b.after]))
        base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
        starts = np.cumsum(b.sizes) - b.sizes
        at = np.searchsorted(b.pairs, b.codes)
        add = lambda x: np.add.reduceat(x, starts)
        # unseen pairs after known words wait for an alpha
        waiting = np.flatnonzero(~seen[at] & (counts[b.before[at]] > 0))
        doc_of = np.repeat(np.arange(len(b.sizes)), b.sizes)[waiting]
        ahead = b.before[at[waiting]]
        asked, place = np.unique(b.words[ahead], return_inverse=True)
        out.append(_scored("docs", row["block"], doc_ids=row["doc_ids"], held=row["held"], sizes=row["sizes"], known=add((counts[b.tokens] > 0).astype(np.int64)).tolist(),
                           base=add(base[b.tokens]).tolist(), score=add(gain[at]).tolist(), events=squeeze(doc_of.astype(np.uint32)), asked=squeeze(place.astype(np.uint32))))
        # masses of owned pairs, by the word before
        p_sum = np.bincount(b.before[owned], p[b.after[owned]], len(b.words))
        d_sum = np.bincount(b.before[owned], mass[owned], len(b.words))
        order = b.word_order[d_sum[b.word_order] > 0]
        to, ask = cuts(b.words[order], buckets), cuts(asked, buckets)
        for k in range(buckets):
            own = order[to[k]:to[k + 1]]
            if len(own) or ask[k] < ask[k + 1]:
                out.append(_scored("masses", row["block"], k, keys=squeeze_sorted(b.words[own]), masses=squeeze(np.concatenate([p_sum[own], d_sum[own]])), numbers=squeeze(counts[own].astype(np.uint64)),
                                   asked=squeeze_sorted(asked[ask[k]:ask[k + 1]])))
        return pa.Table.from_batches(out)

    return blocks.groupBy("block").cogroup(answers.where("block IS NOT NULL").select("bucket", "block", "word_totals", "pair_totals").groupBy("block")).applyInArrow(work, SCORED)


ALPHAS = "bucket int, block long, alphas binary, words binary"


def alphas(scored: DataFrame) -> DataFrame:
    """log10 alpha of the words each block asked for, in its order.

    One row per bucket (block null) is its part of the backoff table: all words and their alphas.
    """
    def work(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        keys = np.concatenate([expand_sorted(r["keys"]) for r in rows])
        halves = [expand(r["masses"], np.float64).reshape(2, -1) for r in rows]
        word, first, place = np.unique(keys, return_index=True, return_inverse=True)
        p_sum, d_sum = (np.bincount(place, np.concatenate([h[k] for h in halves]), len(word)) for k in range(2))
        number = np.concatenate([expand(r["numbers"], np.uint64) for r in rows])[first].astype(np.float64)
        value = np.log10((1 - d_sum / number) / (1 - p_sum))
        out = []
        for r in rows:
            asked = expand_sorted(r["asked"])
            if len(asked):
                out.append((r["bucket"], r["block"], squeeze(value[np.searchsorted(word, asked)]), None))
        out.append((rows[0]["bucket"], None, squeeze(value), squeeze_sorted(word)))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["bucket", "block", "alphas", "words"])

    return scored.where("kind = 'masses'").select("bucket", "block", "keys", "masses", "numbers", "asked").groupBy("bucket").applyInArrow(work, ALPHAS)


FINAL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def finish(scored: DataFrame, found: DataFrame, model: Model) -> DataFrame:
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        replies = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        value = np.concatenate([np.empty(0), *[expand(r["alphas"], np.float64) for r in replies]])
        doc, place = expand(row["events"], np.uint32), expand(row["asked"], np.uint32)
        score = np.array(row["score"]) + np.bincount(doc, value[place], len(row["sizes"]))
        n = len(score)
        return pa.Table.from_arrays(
            [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(row["sizes"], pa.int64()), pa.array(row["known"], pa.int64()),
             pa.array([model.tokens] * n, pa.int64()), pa.array(row["base"], pa.float64()), pa.array(score, pa.float64())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    docs = scored.where("kind = 'docs'").select("block", "doc_ids", "held", "sizes", "known", "base", "score", "asked", "events")
    return docs.groupBy("block").cogroup(found.where("block IS NOT NULL").select("bucket", "block", "alphas").groupBy("block")).applyInArrow(work, FINAL)


def scores(docs: DataFrame, folds: int = 10, block_bytes: int = BLOCK_BYTES, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """log10 probability of every text under a model of those not held out, and the unigram base score.

    Words are ASCII lower-cased runs between ASCII white space, with one end mark after each
    text, which also stands before its first word.  Null and empty texts are the end mark alone;
    repeated rows each count and are each scored; null ids are carried.  Without any training
    row every probability is that of the unknown word (one) and the base score is over one
    unseen type.  An empty table gives no row.
    """
    spark = docs.sparkSession
    blocks = common.written(blocks_of(docs, folds, block_bytes), "lm-blocks")
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    if not size:
        return spark.createDataFrame([], FINAL)
    # pair hashes keep so many bits that fewer than one collision is to be expected
    bits = min(64, 2 * max(20, math.ceil(math.log2(size))))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / bucket_entries))
    answers = common.written(answer(send(blocks, buckets, bits).repartition(buckets, "bucket")), "lm-counts")
    width = 2 + LARGEST + 1
    stats = answers.where("block IS NULL").agg(*[F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(2 * width)]).first()
    model = Model.of(list(stats)[:width], list(stats)[width:])
    scored = common.written(score_blocks(blocks, answers, model, buckets, bits), "lm-scored")
    found = common.written(alphas(scored), "lm-alphas")
    return finish(scored, found, model)


#: the same model and scores over ``documents`` in DuckDB, with words instead of hashes; crc32 is spelled out bit by bit
ORACLE = r"""
WITH d AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 10 = 0 AS held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) AS w FROM documents),
t AS (SELECT doc_id, held_out, w[i] AS w, CASE WHEN i = 1 THEN chr(10) ELSE w[i - 1] END AS v FROM (SELECT doc_id, held_out, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c1 AS (SELECT w, count(*) AS n FROM t WHERE NOT held_out GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM t WHERE NOT held_out GROUP BY v, w),
few AS (SELECT 'w' AS k, [(count(*) FILTER (WHERE n = 1))::DOUBLE, (count(*) FILTER (WHERE n = 2))::DOUBLE, (count(*) FILTER (WHERE n = 3))::DOUBLE, (count(*) FILTER (WHERE n = 4))::DOUBLE, (count(*) FILTER (WHERE n = 5))::DOUBLE, (count(*) FILTER (WHERE n = 6))::DOUBLE] AS n FROM c1 UNION ALL SELECT 'p', [(count(*) FILTER (WHERE n = 1))::DOUBLE, (count(*) FILTER (WHERE n = 2))::DOUBLE, (count(*) FILTER (WHERE n = 3))::DOUBLE, (count(*) FILTER (WHERE n = 4))::DOUBLE, (count(*) FILTER (WHERE n = 5))::DOUBLE, (count(*) FILTER (WHERE n = 6))::DOUBLE] FROM c2),
gt AS (SELECT k, n, 6 * n[6] / n[1] AS tail FROM few),
dk AS (SELECT k, n, list_transform([1, 2, 3, 4, 5], lambda r: ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)) AS d,
  list_transform([1, 2, 3, 4, 5], lambda r: (r - least(greatest(n[1] / (n[1] + 2 * n[2]), 0.1), 0.9)) / r) AS other FROM gt),
ds AS (SELECT k, CASE WHEN len(list_filter(d, lambda x: x > 0 AND x < 1)) = 5 THEN d ELSE other END AS d FROM dk),
m1 AS (SELECT w, n, CASE WHEN n > 5 THEN n - 0.01 ELSE n * ds.d[n] END AS mass FROM c1, ds WHERE k = 'w'),
tot AS (SELECT sum(n)::BIGINT AS tokens, count(*) AS words, sum(mass) AS mass, greatest(1 - sum(mass) / sum(n), 1 / (sum(n) + count(*) + 1)) AS unknown FROM m1),
p AS (SELECT w, m1.n, (1 - unknown) * m1.mass / tot.mass AS p FROM m1, tot),
m2 AS (SELECT v, c2.w, CASE WHEN c2.n > 5 THEN c2.n - 0.01 ELSE c2.n * ds.d[c2.n] END AS mass, p.p FROM c2 JOIN p ON p.w = c2.w, ds WHERE k = 'p'),
al AS (SELECT v, log10((1 - sum(mass) / any_value(c1.n)) / (1 - sum(m2.p))) AS alpha FROM m2 JOIN c1 ON c1.w = m2.v GROUP BY v),
e AS (SELECT t.*, p.n, CASE WHEN m2.mass IS NOT NULL THEN log10(m2.mass) - log10(cv.n) ELSE coalesce(alpha, 0) + log10(coalesce(p.p, unknown)) END AS s,
  log10((coalesce(p.n, 0) + 0.1) / (tokens + 0.1 * (words + 1))) AS b
  FROM t LEFT JOIN p ON p.w = t.w LEFT JOIN m2 ON m2.v = t.v AND m2.w = t.w LEFT JOIN c1 cv ON cv.w = t.v LEFT JOIN al ON al.v = t.v, tot)
SELECT doc_id, held_out, count(*) AS n_tokens, count(n) AS n_known, any_value(tokens) AS train_tokens, sum(b) AS base_score, sum(s) AS score FROM e, tot GROUP BY doc_id, held_out"""
