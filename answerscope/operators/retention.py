"""Retention and data-subject operations (L1-L4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope import fixed


def is_expired(created_at: Column, as_of: Column, days: int = fixed.RETENTION_DAYS) -> Column:
    """Older than the window; rows without a readable date are kept."""
    return F.coalesce(created_at < as_of - F.make_dt_interval(F.lit(days)), F.lit(False))


def split_expired(runs: DataFrame, as_of: Column, days: int = fixed.RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """(removed, kept) of a purge; taking only this is the dry run (L1)."""
    gone = is_expired(F.col("created_at"), as_of, days)
    return runs.where(gone), runs.where(~gone)


def purge_report(runs: DataFrame, as_of: Column, days: int = fixed.RETENTION_DAYS) -> DataFrame:
    """Per brand: removed, kept, and whether the brand disappears (L1)."""
    gone = is_expired(F.col("created_at"), as_of, days)
    return runs.groupBy("brand_key").agg(
        F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept")).withColumn(
        "brand_gone", F.col("kept") == 0)


def purge_details(details: DataFrame, removed: DataFrame) -> DataFrame:
    """Detail rows of the surviving runs (L1)."""
    return details.join(removed.select("brand_key", "run_id"), ["brand_key", "run_id"], "left_anti")


def purge_table(spark: SparkSession, src: str, dst: str, as_of: Column, days: int = fixed.RETENTION_DAYS) -> None:
    """Write the survivors of a run table to a new location (swap it in afterwards)."""
    _, kept = split_expired(spark.read.parquet(src), as_of, days)
    kept.write.mode("overwrite").partitionBy("brand_key").parquet(dst)


def erase_subject(tables: dict[str, DataFrame], brand_key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the brand, and how many runs go (L2)."""
    left = {name: t.where(F.col("brand_key") != brand_key) for name, t in tables.items()}
    gone = tables["runs"].where(F.col("brand_key") == brand_key).agg(
        F.lit(brand_key).alias("brand_key"), F.count(F.lit(1)).alias("runs_deleted"))
    return left, gone


def export_subject(tables: dict[str, DataFrame], brand_key: str) -> DataFrame:
    """All rows held about a brand as (table, row JSON) (L3); write with ``write.json``."""
    out = None
    for name, t in sorted(tables.items()):
        rows = t.where(F.col("brand_key") == brand_key).select(
            F.lit(name).alias("table"), F.to_json(F.struct(*t.columns)).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def holdings(runs: DataFrame) -> DataFrame:
    """Brands and runs held (L4)."""
    per_brand = runs.groupBy("brand_key").agg(F.count(F.lit(1)).alias("n"))
    return per_brand.agg(F.count(F.lit(1)).alias("brands_held"), F.coalesce(F.sum("n"), F.lit(0)).alias("runs_held"))
