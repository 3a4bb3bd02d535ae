"""Answers as they arrive: scoring, windowed rates, history upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from answerscope.operators.mentions import score_answers
from answerscope.sources.answers import ANSWERS, clean_answers
from answerscope.sources.store import CHANGES_KEPT, RunStore

JOB_KEYS = ["run_id", "brand_key", "engine", "prompt_id", "sample"]


def stream_answers(spark: SparkSession, path: str, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    """Answer files as they land."""
    return clean_answers(
        spark.readStream.schema(ANSWERS).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path))


def stream_score(
    answers: DataFrame, prompts: DataFrame, entities: DataFrame, lexicon: dict | None = None,
    lateness: str = "1 hour",
) -> DataFrame:
    """Outcomes of streamed answers (N1): the batch expression unchanged, repeats dropped.

    Ranks are array expressions inside the answer's row, so no window is needed on the
    stream; state holds only the job keys within the watermark.
    """
    once = answers.withWatermark("captured_at", lateness).dropDuplicatesWithinWatermark(JOB_KEYS)
    return score_answers(once, prompts, entities, lexicon)


def windowed_mention_rate(
    outcomes: DataFrame, width: str = "1 day", slide: str | None = None, time: str = "captured_at",
    lateness: str | None = None,
) -> DataFrame:
    """Mention rate per brand, engine and event-time window.

    Pass ``lateness`` for a batch or a stream that carries no watermark yet.
    """
    rows = outcomes if lateness is None else outcomes.withWatermark(time, lateness)
    ok = F.col("status") == "answered"
    return rows.groupBy(F.window(time, width, slide or width), "brand_key", "engine").agg(
        F.count_if(ok).alias("answered"),
        F.count_if(ok & F.col("mentioned")).alias("mentions")).select(
        F.col("window.start").alias("window_start"), "brand_key", "engine", "answered", "mentions",
        F.when(F.col("answered") > 0, F.col("mentions") / F.col("answered")).alias("rate"))


def upsert_history(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Sink for run rows (N3): each micro-batch lands in its own ``batch=<id>`` folder.

    A batch replayed after a failure overwrites its own folder, so nothing is doubled, and
    the cost of a batch does not grow with the history.  ``read_history`` resolves upserts.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def write_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    batch.write.mode("overwrite").partitionBy("brand_key").parquet(f"{path}/batch={batch_id}")


def read_history(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current state of the history: per key the row of the latest batch, then latest write."""
    rows = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    version = F.struct("batch", *(["write_ts"] if "write_ts" in rest else []))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")


def upsert_store(stream: DataFrame, store: RunStore, name: str, checkpoint: str, keep: int = CHANGES_KEPT) -> DataStreamWriter:
    """Sink for run rows (N3) into a store: each micro-batch is one published change of the stream ``name``.

    A batch replayed after a failure finds itself published and changes nothing.  When more than
    ``keep`` changes lie on the base they are folded into a new one, so a reader meets one base and
    at most ``keep`` changes however long the stream runs; old files stay until ``store.vacuum``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if len(store.upsert(batch, name, batch_id).changes) > keep:
            store.compact()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def run_once(writer: DataStreamWriter, done: Callable[[], None] | None = None) -> None:
    """Drain everything available and stop (tests, scheduled jobs)."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if done:
        done()
