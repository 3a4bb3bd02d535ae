"""The registered queries of the operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from answerscope.llm import chat, common, fingerprints, katz, lexical, licenses, nearest, neardup, negatives, packing, pieces, quality, rules, secrets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return add


@query("op1_pieces")
def op1(spark, sf_dir):
    return pieces.digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op2_packing")
def op2(spark, sf_dir):
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


@query("op4_line_rules", rules.ORACLE)
def op4(spark, sf_dir):
    return rules.verdicts(common.table(spark, sf_dir, "documents"))


@query("op6_fingerprints")
def op6(spark, sf_dir):
    return fingerprints.edits(common.table(spark, sf_dir, "documents"))


@query("op7_neardup", neardup.ORACLE)
def op7(spark, sf_dir):
    return neardup.neardup(common.table(spark, sf_dir, "documents"), width=4).drop("mark", "component")


@query("op8_licenses")
def op8(spark, sf_dir):
    return licenses.summary(common.table(spark, sf_dir, "documents"))


@query("op9_secrets")
def op9(spark, sf_dir):
    return secrets.summary(common.table(spark, sf_dir, "documents"))


@query("op10_chat")
def op10(spark, sf_dir):
    return chat.repair(common.table(spark, sf_dir, "conversations"))


@query("op3_quality")
def op3(spark, sf_dir):
    return quality.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@query("op5_katz", katz.ORACLE)
def op5(spark, sf_dir):
    return katz.scores(common.table(spark, sf_dir, "documents"))


@query("op11_nearest")
def op11(spark, sf_dir):
    rows = common.table(spark, sf_dir, "embeddings")
    return nearest.nearest(rows, rows.where("vec_id % 100 = 0"))


@query("op12_negatives", negatives.ORACLE)
def op12(spark, sf_dir):
    rows = common.table(spark, sf_dir, "embeddings")
    return negatives.hard_negatives(rows, negatives.ANCHORS, negatives.noisy_label()).drop("anchor_key", "positive_key")


@query("op13_lexical", lexical.ORACLE)
def op13(spark, sf_dir):
    return lexical.search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
