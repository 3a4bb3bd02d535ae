"""Streams that stop and start again: repeated files, late rows, bounded state."""

import datetime as dt

from pyspark.sql import functions as F

import catalog.base as base
from answerscope.operators.mentions import score_answers
from answerscope.streaming import live as N

D = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def landed(rows, path, hour):
    """One file of answers captured in an hour."""
    rows.withColumn("captured_at", F.lit(T0 + dt.timedelta(hours=hour)).cast("timestamp")).coalesce(1).write.mode("append").json(path)


def test_scoring_goes_on_from_its_checkpoint(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    docs = base.view(spark, D, "v_docs").withColumns({"citations": base.split_words("cites"), "latency_ms": F.lit(1).cast("long")}).drop("cites")
    part = lambda k: docs.where(F.col("ord") % 8 == k).limit(12)
    prompts, ents = base.view(spark, D, "v_prompts"), base.entities(spark, D)
    state = []

    def drain():
        live = N.stream_score(N.stream_answers(spark, src, files_per_batch=1), prompts, ents, lateness="2 hours").select("ord", "run_id", "score", "brand.rank")
        q = live.writeStream.format("parquet").option("checkpointLocation", mark).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
        state.append([(p["numInputRows"], p["stateOperators"][0]["numRowsTotal"], p["stateOperators"][0]["numRowsDroppedByWatermark"]) for p in q.recentProgress if p["stateOperators"]])

    for hour in (0, 1):
        landed(part(hour), src, hour)
    drain()
    # the stream has stopped; files come again, and new ones
    landed(part(0), src, 1)  # a repeat whose keys are still held
    landed(part(2), src, 2)
    landed(part(3), src, 40)  # moves the watermark far on
    landed(part(4), src, 41)
    drain()
    landed(part(5), src, 1)  # later than the watermark allows
    landed(part(6), src, 42)
    drain()
    drain()  # nothing new: nothing is written twice
    wanted = part(0)
    for k in (1, 2, 3, 4, 6):
        wanted = wanted.unionByName(part(k))
    batch = score_answers(wanted.withColumn("captured_at", F.lit(T0).cast("timestamp")), prompts, ents).select("ord", "run_id", "score", "brand.rank")
    got = spark.read.parquet(out).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.collect())) and len(got) > 20
    flat = [s for run in state for s in run]
    held = [n for _, n, _ in flat]
    assert sum(late for *_, late in flat) == part(5).count()
    # keys of the first hours are dropped once the watermark has passed them
    assert max(held) >= 24 and held[-1] <= 24 + 12 and held[-1] < sum(n for n, *_ in flat) / 2


def test_rates_of_a_stopped_stream(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = [(T0 + dt.timedelta(hours=h), "b%d" % (h % 2), "e", "answered" if h % 5 else "error", h % 3 == 0) for h in range(24 * 6)]
    df = spark.createDataFrame(rows, "captured_at timestamp, brand_key string, engine string, status string, mentioned boolean")
    want = {(r["window_start"], r["brand_key"]): (r["answered"], r["mentions"]) for r in N.windowed_mention_rate(df).collect()}
    for day in range(6):
        df.where(F.dayofmonth("captured_at") == day + 1).coalesce(1).write.mode("append").parquet(src)
        stream = N.windowed_mention_rate(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src), lateness="1 hour")
        N.run_once(stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", mark).option("path", out))
    got = {(r["window_start"], r["brand_key"]): (r["answered"], r["mentions"]) for r in spark.read.parquet(out).collect()}
    assert len(got) >= 8 and all(want[k] == v for k, v in got.items())
    assert spark.read.parquet(out).count() == len(got)  # every window closed once
