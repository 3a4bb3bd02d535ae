"""Captured answers: reading and normalising provider payloads (A1, A2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.functions.urls import ascii_url, extract_urls

ANSWERS = (
    "run_id STRING, brand_key STRING, engine STRING, engine_ord INT, prompt_id STRING, sample INT, "
    "ord BIGINT, status STRING, text STRING, citations ARRAY<STRING>, latency_ms BIGINT, error STRING, "
    "captured_at TIMESTAMP"
)


def clean_answers(rows: DataFrame) -> DataFrame:
    """Null text becomes '', citations are distinct and non-empty."""
    return rows.withColumns({
        "text": F.coalesce("text", F.lit("")),
        "citations": F.array_distinct(F.filter(
            F.coalesce("citations", F.array().cast("array<string>")),
            lambda c: F.coalesce(c, F.lit("")) != ""))}).withColumn(
        "citations", F.transform("citations", lambda c: ascii_url(c)))


def read_answers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Answer rows of any engine (A1) with the declared schema; nothing is inferred."""
    return clean_answers(spark.read.schema(ANSWERS).format(fmt).load(path))


def _ddl(payload: Column, ddl: str) -> Column:
    return F.from_json(payload, ddl)


def _join(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda t: F.coalesce(t, F.lit("")) != ""), "\n")


def normalise_payload(raw: DataFrame) -> DataFrame:
    """Provider responses (provider, http_status, payload) -> status, text, citations, error (A2).

    Providers: ``chat`` (completion choices), ``messages`` (content blocks), ``search``
    (completion with cited pages), ``grounded`` (candidates with grounding chunks).
    """
    p = F.col("payload")
    chat = _ddl(p, "choices ARRAY<STRUCT<message STRUCT<content STRING>>>")
    blocks = _ddl(p, "content ARRAY<STRUCT<type STRING, text STRING>>")["content"]
    search = _ddl(p, "citations ARRAY<STRING>, search_results ARRAY<STRUCT<url STRING>>")
    cand = F.get(_ddl(
        p, "candidates ARRAY<STRUCT<content STRUCT<parts ARRAY<STRUCT<text STRING>>>, "
           "groundingMetadata STRUCT<groundingChunks ARRAY<STRUCT<web STRUCT<uri STRING>>>>>>")["candidates"],
        F.lit(0))
    none = F.array().cast("array<string>")
    text = (
        F.when(F.col("provider").isin("chat", "search"),
               F.get(chat["choices"], F.lit(0))["message"]["content"])
        .when(F.col("provider") == "messages", F.array_join(F.transform(
            F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n"))
        .when(F.col("provider") == "grounded",
              _join(F.transform(cand["content"]["parts"], lambda x: x["text"]))))
    cited = (
        F.when(F.col("provider") == "search", F.coalesce(
            search["citations"], F.transform(search["search_results"], lambda r: r["url"])))
        .when(F.col("provider") == "grounded", F.transform(
            cand["groundingMetadata"]["groundingChunks"], lambda g: g["web"]["uri"])))
    ok = F.col("http_status").between(200, 299)
    message = _ddl(p, "error STRUCT<message STRING>")["error"]["message"]
    read = raw.withColumns({
        "status": F.when(ok, "answered").otherwise("error"),
        "text": F.when(ok, F.coalesce(text, F.lit(""))).otherwise(""),
        "cited": F.when(ok, F.coalesce(cited, none)).otherwise(none),
        "error": F.when(~ok, F.coalesce(F.nullif(message, F.lit("")), F.concat(
            F.lit("HTTP "), F.col("http_status").cast("string"))))})
    return read.withColumn("citations", F.array_distinct(F.filter(
        F.concat("cited", extract_urls("text")), lambda c: F.coalesce(c, F.lit("")) != ""))
    ).drop("cited", "payload", "http_status")
