"""Run store and exports on Parquet, CSV and JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def newest_version(rows: DataFrame, keys: list[str], version: str = "write_ts") -> DataFrame:
    """Last written row per key: an argmax with map-side partials, no sort of a hot key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")


def save_run(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by run id (A9): rows of ``incoming`` replace stored rows with the same key."""
    kept = existing.join(incoming.select(keys).distinct(), keys, "left_anti")
    return kept.unionByName(incoming)


def upsert_runs(incoming: DataFrame, path: str, keys: list[str], version: int, partition: str = "brand_key") -> None:
    """Write an upsert as a new version (A9): all rows of the brands it touches, and of no others.

    ``version`` grows with every write; one that is repeated after a failure overwrites itself.
    Older versions stay as they are, so nothing is read and rewritten in the same place.
    """
    state = incoming
    try:
        stored = read_runs(incoming.sparkSession, path, partition, before=version)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        touched = stored.join(incoming.select(partition).distinct(), partition, "left_semi")
        state = save_run(touched.select(*incoming.columns), incoming, keys)
    state.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition).parquet(f"{path}/version={version}")


def read_runs(spark: SparkSession, path: str, partition: str = "brand_key", before: int | None = None) -> DataFrame:
    """The current runs: of every brand the rows of the newest version that has it."""
    rows = spark.read.option("basePath", path).parquet(path)
    if before is not None:
        rows = rows.where(F.col("version") < before)
    newest = rows.groupBy(partition).agg(F.max("version").alias("version"))
    return rows.join(newest, [partition, "version"]).drop("version")


def write_runs(table: DataFrame, path: str, partition: str = "brand_key") -> None:
    """Write whole brand partitions; brands not in ``table`` keep their files."""
    (table.hint("rebalance", partition).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))


def flat(df: DataFrame) -> DataFrame:
    """Columns a CSV file can hold: arrays space-joined, structs as JSON."""
    def one(name: str, kind: str) -> Column:
        if kind.startswith("array<string"):
            return F.array_join(name, " ").alias(name)
        if kind.startswith(("array", "struct", "map")):
            return F.to_json(name).alias(name)
        return F.col(f"`{name}`")

    return df.select(*[one(n, t) for n, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180 quoting: cells with commas, quotes or newlines are quoted, quotes doubled (A10)."""
    flat(df).write.mode("overwrite").option("header", True).option("quote", '"').option(
        "escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)

