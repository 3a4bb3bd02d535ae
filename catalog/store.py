"""A9, L1, L2, N3 through the store's log: versions, index, erasure, purge, compaction."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql.window import Window

from answerscope.session import scratch_folder
from answerscope.sources.store import RunStore
from answerscope.streaming import live as N
from catalog.base import query, view

CUT = "2024-01-31 00:00:00"


def as_of():
    return F.lit(CUT).cast("timestamp")


COLUMNS = ["run_id", "brand_key", "created_at", "composite", "event_id"]

#: what the two writes leave: every tenth run changed, and new runs
CHANGED = """st AS (SELECT run_id, brand_key, created_at, CASE WHEN event_id % 10 = 3 THEN composite + 1 ELSE composite END AS composite, event_id FROM v_runs
  UNION ALL SELECT 'new' || run_id, brand_key, created_at, composite, event_id FROM v_runs WHERE event_id % 10 = 4)"""


def stored(spark, d) -> RunStore:
    """A store of two versions and a third that was never published."""
    runs = view(spark, d, "v_runs").select(*COLUMNS)
    store = RunStore(spark, scratch_folder(spark, "store"))
    store.upsert(runs)
    again = runs.where("event_id % 10 = 3").withColumn("composite", F.col("composite") + 1)
    store.upsert(again.unionByName(runs.where("event_id % 10 = 4").withColumn("run_id", F.concat(F.lit("new"), "run_id"))))
    store._write(runs.withColumn("composite", F.lit(-1.0)))  # a job that dies before it publishes
    return store


@query("a09_store_versions", f"WITH {CHANGED} SELECT 1 AS version, run_id, brand_key, created_at, composite, event_id FROM v_runs UNION ALL SELECT 2, * FROM st")
def a09_versions(spark, d):
    store = stored(spark, d)
    rows = [store.read(v).select(F.lit(v).alias("version"), *COLUMNS) for v in store.versions()]
    return rows[0].unionByName(rows[1])


@query("a09_store_index", f"WITH {CHANGED} SELECT brand_key, run_id, composite, row_number() OVER (PARTITION BY brand_key ORDER BY created_at DESC, run_id) AS place FROM st", ints="place")
def a09_index(spark, d):
    newest_first = Window.partitionBy("brand_key").orderBy(F.col("created_at").desc(), "run_id")
    return stored(spark, d).index().select("brand_key", "run_id", "composite", F.row_number().over(newest_first).alias("place"))


@query("l02_erase_store", f"WITH {CHANGED} SELECT brand_key, count(*) AS n, sum(composite) AS total FROM st WHERE brand_key <> 'b7' GROUP BY brand_key UNION ALL SELECT 'erased b7', count(*), NULL FROM st WHERE brand_key = 'b7'")
def l02_store(spark, d):
    store = stored(spark, d)
    had = store.erase("b7")
    store.compact()
    left = store.read().groupBy("brand_key").agg(F.count(F.lit(1)).alias("n"), F.sum("composite").alias("total"))
    return left.unionByName(spark.createDataFrame([("erased b7", had, None)], "brand_key string, n long, total double"))


@query("l01_purge_store", f"WITH {CHANGED} SELECT brand_key, run_id, composite FROM st WHERE NOT coalesce(created_at < TIMESTAMP '{CUT}' - INTERVAL 10 DAY, false)")
def l01_store(spark, d):
    store = stored(spark, d)
    expected = store.expired(as_of(), 10).count()
    assert store.purge(as_of(), 10) == expected  # the dry run told the same
    return store.read().select("brand_key", "run_id", "composite")


@query("n03_store_stream", f"WITH {CHANGED} SELECT run_id, brand_key, composite FROM st")
def n03_store(spark, d):
    """A stream into a store, stopped after some batches, started again; compacted on the way."""
    runs = view(spark, d, "v_runs").select(*COLUMNS)
    folder = scratch_folder(spark, "runs")
    runs.repartition(6).write.parquet(folder)
    store, mark = RunStore(spark, scratch_folder(spark, "store")), scratch_folder(spark, "progress")
    stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    N.run_once(N.upsert_store(stream, store, "runs", mark, keep=2))
    again = runs.where("event_id % 10 = 3").withColumn("composite", F.col("composite") + 1)
    again.unionByName(runs.where("event_id % 10 = 4").withColumn("run_id", F.concat(F.lit("new"), "run_id"))).write.mode("append").parquet(folder)
    N.run_once(N.upsert_store(stream, store, "runs", mark, keep=2))
    return store.read().select("run_id", "brand_key", "composite")
