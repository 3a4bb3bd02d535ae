"""Operator 13: ranked lexical search by one scan of the documents with an Aho-Corasick automaton.

The terms of all items form one automaton; every term is guarded by a separator on both sides and
every text is spelled with one separator in place of each character that no term holds, so that
only whole terms are found.  A document is read once: its number of terms and the occurrences of
each term of the items are counted from its text, and nothing else of it is kept.  No index of the
documents is built.  What was counted gives the weights, then each task adds up its documents'
scores by the items that hold a term and keeps the first few of each item; windows merge these.

Items beyond ``TERM_BYTES`` of terms are taken in blocks, one scan each, so the automaton that every
task holds is bounded.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from answerscope.llm import common

#: bytes of distinct terms of the items that share an automaton (an item with more has one of its own)
TERM_BYTES = 4_000_000
#: documents scored at a time hold so many pairs of document and item
PAIRS = 2_000_000

#: bytes of terms, A-Z lower-cased; every other byte is the separator.  All bytes of characters beyond ASCII belong to terms
SPELLED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def spelled(text: str) -> str:
    """The text with one separator in place of each character outside terms, and one at either end, a byte a character."""
    return f" {text.encode('utf-8', 'surrogatepass').translate(SPELLED).decode('latin-1')} "


def terms_of(text: str) -> list[str]:
    return spelled(text).split(" ")


def automaton(terms: list[str]):
    """Finds the numbers of the terms in a spelled text.  Guards are shared by neighbours, so no occurrence hides another."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        found.add_word(f" {term} ", k)
    found.make_automaton()
    return found


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id``, ``terms``: each item's distinct terms.  Rows that repeat an id are one item with the terms of all of them; rows without an id are none."""
    common.importable(items.sparkSession)

    def work(batches):
        for batch in common.slices(batches):
            found = [sorted({t for t in terms_of(x) if t}) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.string()))], names=["item_id", "terms"])

    texts = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.mapInArrow(work, "item_id long, terms array<string>")
    single = rows.select("item_id", F.explode("terms").alias("term")).distinct()
    return single.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def counted(docs: DataFrame, terms) -> DataFrame:
    """``doc_id``, ``n`` (all its terms), ``found`` and ``tf`` (numbers of the terms in it and their occurrences) of every document with a term; ``terms`` is a broadcast list."""
    def work(batches):
        machine = automaton(terms.value)
        for batch in common.slices(batches):
            sizes, lengths, found, tf = [], [], [], []
            for text in batch.column("text").to_pylist():
                text = spelled(text)
                sizes.append(len(text.split()) if text.isascii() else sum(map(bool, text.split(" "))))
                own = Counter(k for _, k in machine.iter(text)) if len(machine) else {}
                lengths.append(len(own))
                found.extend(own.keys())
                tf.extend(own.values())
            n = np.array(sizes, np.int64)
            rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), common.list_array(np.array(found, np.int32), lengths, pa.int32()), common.list_array(np.array(tf, np.int64), lengths, pa.int64())],
                                              names=["doc_id", "n", "found", "tf"])
            yield rows.filter(pa.array(n > 0))

    return common.texts_of(docs).where("doc_id IS NOT NULL").mapInArrow(work, "doc_id long, n long, found array<int>, tf array<long>")


def scored(rows: DataFrame, weights, ids, starts, holders, n_docs: int, n_terms: int, most: int) -> DataFrame:
    """``item_id``, ``doc_id``, ``score``: of each task's documents the first ``most`` of every item.

    ``weights`` are by number of the term, ``holders[starts[t]:starts[t + 1]]`` the places in ``ids`` of the items with term t; all broadcast.
    """
    def work(batches):
        w, ids_, starts_, holders_ = (b.value for b in (weights, ids, starts, holders))
        held_item, held_doc, held_score = (np.empty(0, np.int64) for _ in range(3))
        step = max(1, PAIRS // max(1, len(ids_)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n = part.column("n").to_pylist()
                m = np.array([50 + 50 * x * n_docs // n_terms for x in n], np.int64)
                lists = part.column("found")
                counts = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                term, tf = lists.flatten().to_numpy(), part.column("tf").flatten().to_numpy()
                doc = np.repeat(np.arange(len(n)), counts)
                gain = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                # every occurrence of a term in a document counts for each item that holds the term
                each = starts_[term + 1] - starts_[term]
                place = np.arange(each.sum()) + np.repeat(starts_[term] - np.cumsum(each) + each, each)
                total = np.zeros(len(n) * len(ids_), np.int64)
                np.add.at(total, np.repeat(doc, each) * len(ids_) + holders_[place], np.repeat(gain, each))
                pairs = np.flatnonzero(total)
                doc, item = np.divmod(pairs, len(ids_)) if len(ids_) else (pairs, pairs)
                held_item = np.concatenate([held_item, item])
                held_doc = np.concatenate([held_doc, part.column("doc_id").to_numpy()[doc]])
                held_score = np.concatenate([held_score, total[pairs]])
                if len(held_item) > 2 * PAIRS:
                    held_item, held_doc, held_score = _first(held_item, held_doc, held_score, most)
        held_item, held_doc, held_score = _first(held_item, held_doc, held_score, most)
        yield pa.RecordBatch.from_arrays([pa.array(ids_[held_item]), pa.array(held_doc), pa.array(held_score)], names=["item_id", "doc_id", "score"])

    return rows.mapInArrow(work, "item_id long, doc_id long, score long")


def _first(item: np.ndarray, doc: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((doc, -score, item))
    item, doc, score = item[order], doc[order], score[order]
    starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.empty(0, np.int64)
    place = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
    return item[place < most], doc[place < most], score[place < most]


def search(docs: DataFrame, items: DataFrame, most: int = 50) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``most`` documents of highest score above 0 of each item, equal scores by id.

    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.
    Null and empty texts have none and count as no document; an item without a term finds nothing.
    Rows that repeat a doc_id are documents of their own (equal ones rank next to each other); rows
    without a doc_id are left out, as are items without an item_id.  Empty tables give no row.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    known, _ = common.written_and_told(item_terms(items), "items", n=F.count(F.lit(1)))
    sized = known.select("item_id", F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t)).alias("bytes"))
    blocks = -(-(sized.agg(F.sum("bytes")).first()[0] or 0) // TERM_BYTES)
    out = None
    for block in range(blocks):
        own = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        terms = sorted({t for r in own for t in r["terms"]})
        number = {t: k for k, t in enumerate(terms)}
        of = np.array([number[t] for r in own for t in r["terms"]], np.int64)
        holder = np.repeat(np.arange(len(own)), [len(r["terms"]) for r in own])
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(len(terms) + 1))
        rows, told = common.written_and_told(counted(docs, sc.broadcast(terms)), "counts", n=F.count(F.lit(1)), terms=F.sum("n"))
        if not told["n"]:
            break
        df = np.zeros(len(terms), np.int64)
        for r in rows.select(F.explode("found").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * told["n"] + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        hand = [sc.broadcast(x) for x in (weights, np.array([r["item_id"] for r in own], np.int64), starts, holder[order])]
        found = scored(rows, *hand, told["n"], told["terms"], most)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"
ORACLE = f"""WITH words AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents),
tfs AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY t),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
lengths AS (SELECT doc_id, 100 - 50 + ((50 * n * n_docs) // n_terms) AS m FROM sizes, totals),
sums AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM wanted JOIN tfs USING (t) JOIN weights USING (t) JOIN lengths USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM sums WHERE score > 0
QUALIFY rank <= 50"""
