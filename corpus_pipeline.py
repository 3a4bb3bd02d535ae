"""The corpus pipeline: line rules, quality classifier, near-duplicate removal, secret removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return the columns of ``documents``.  ``run`` writes every stage's rows as Parquet in the
shared folder and reads them back, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from answerscope.llm import common, neardup, packing, quality, rules, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failed lines.  Null and empty texts fail.

    The judged rows are written before they are filtered: a filter on an unwritten verdict would
    be pushed down as one expression that repeats all its parts.
    """
    judged = common.written(rules.rules(docs, row=True).select("row", "cleaned", "kept"), "judged")
    return common.with_text(judged.where("kept"), "cleaned")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more by a model of the labelled rows of the whole table.

    The model learns from ``documents`` rather than from ``docs``: the stage before has already
    taken most rows of label 0.  Without labels every score is one half, and all rows stay.
    """
    model = quality.learn(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return quality.score(docs, model, row=True).where("score >= 0.3").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates (five words, similarity 0.8).

    Rows that repeat an id are documents of their own where their texts are no near duplicates; else
    the one of least text hash stays.  Rows without an id all stay.
    """
    rows = common.written(neardup.neardup(docs).where("doc_id IS NOT NULL").select("doc_id", "mark", "component", "kept"), "rows")
    # of rows with one id in one group (or of one text, where a row stands alone) the first
    first = Window.partitionBy("doc_id", F.coalesce("component", "mark"), F.col("component").isNull()).orderBy("mark")
    twice = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = rows.where("kept").join(twice, "doc_id", "left_semi").withColumn("place", F.row_number().over(first))
    out = rows.where("NOT kept").select("doc_id", "mark").unionByName(again.where("place > 1").select("doc_id", "mark"))
    # repeats of one text share a mark: they go together below, not here
    out = out.join(again.where("place = 1").select("doc_id", "mark"), ["doc_id", "mark"], "left_anti").distinct()
    gone = (docs["doc_id"].cast("long") == out["doc_id"]) & (neardup.text_mark() == out["mark"])
    left = docs.join(out, gone, "left_anti")
    if twice.isEmpty():
        return left
    same = Window.partitionBy("doc_id", neardup.text_mark(), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).orderBy(F.xxhash64(*[left[c] for c in left.columns]))
    place = "_".join([*left.columns, "place"])  # no column of the table has this name
    return left.withColumn(place, F.row_number().over(same)).where(F.col(place) == 1).drop(place)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each stretch of secrets replaced by a mark."""
    return common.with_text(secrets.redacted(docs, row=True), "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: document, start, length, checksum, sequence and offset."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", pack)]

#: SQL cannot express the trained classifier nor the packing; the stages are tested one by one
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
