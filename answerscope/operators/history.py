"""Run history: composite, deltas, latest and previous runs, trends (K1-K9).

A brand may own a third of all runs, so order within a brand is resolved in two levels:
inside a (brand, day) bucket first, then over one summary row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerscope import fixed
from answerscope.functions.core import grade_for, round_half_up

METRICS = ["composite", "readiness", "visibility", "mention_rate"]


def composite(readiness: Column, visibility: Column) -> Column:
    """Headline score from the halves that were measured (K1); null when none was."""
    both = round_half_up(readiness * fixed.READINESS_SHARE + visibility * fixed.VISIBILITY_SHARE)
    return F.when(readiness.isNotNull() & visibility.isNotNull(), both).otherwise(
        F.coalesce(readiness, visibility))


def roll_up(halves: DataFrame) -> DataFrame:
    """halves: run_id, brand_key, ..., readiness, visibility (nullable)."""
    score = composite(F.col("readiness"), F.col("visibility"))
    return halves.withColumn("composite", score).withColumns({
        "grade": grade_for("composite"),
        "partial": F.col("readiness").isNull() | F.col("visibility").isNull()})


def _diff(a: Column, b: Column, strict: bool) -> Column:
    if strict:
        return round_half_up(a - b)
    return round_half_up(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))


DELTA_METRICS = ["composite", "readiness", "visibility", "mention_rate", "citation_rate", "brand_share"]


def compute_delta(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """Differences between a run and its previous run (K2).

    ``pairs``: run_id, previous_id, previous_at, each metric as <m> and previous_<m>, and the
    recommendation ids of both as arrays ``recs`` and ``previous_recs`` (a few dozen each).
    Unmeasured counts as 0 unless ``strict``.
    """
    return pairs.select(
        "run_id", "previous_id", "previous_at",
        *[_diff(F.col(m), F.col(f"previous_{m}"), strict).alias(m) for m in DELTA_METRICS],
        F.array_except("previous_recs", "recs").alias("resolved"),
        F.array_except("recs", "previous_recs").alias("introduced"))


def history(runs: DataFrame, brand_key: str | None = None) -> DataFrame:
    """Newest first (K3); with a brand only its partition is read."""
    chosen = runs if brand_key is None else runs.where(F.col("brand_key") == brand_key)
    return chosen.orderBy("brand_key", F.col("created_at").desc(), F.col("run_id").desc())


def _recency() -> Column:
    return F.struct("created_at", "run_id")


def brands_list(runs: DataFrame) -> DataFrame:
    """Latest run and run count per brand (K4)."""
    return runs.groupBy("brand_key").agg(
        F.count(F.lit(1)).alias("runs"),
        F.max_by(F.struct(*[c for c in runs.columns if c != "brand_key"]), _recency()).alias("latest"))


def previous_run(runs: DataFrame) -> DataFrame:
    """Newest run with another id (K5): the latest run, or the one before it for the latest.

    Only the two newest runs per brand matter; they come from a per-partition group limit.
    """
    w = Window.partitionBy("brand_key").orderBy(F.col("created_at").desc(), F.col("run_id").desc())
    two = (
        runs.select("brand_key", "run_id", "created_at").withColumn("pos", F.row_number().over(w))
        .where(F.col("pos") <= 2).groupBy("brand_key").agg(
            F.max(F.when(F.col("pos") == 1, F.col("run_id"))).alias("newest"),
            F.max(F.when(F.col("pos") == 2, F.col("run_id"))).alias("second")))
    return runs.join(two, "brand_key").withColumn(
        "previous_id", F.when(F.col("run_id") == F.col("newest"), F.col("second")).otherwise(F.col("newest"))
    ).drop("newest", "second")


def _bucketed(runs: DataFrame) -> DataFrame:
    """Hours: short enough that a backfill of a day is shared by tasks, and few beside the runs."""
    return runs.withColumn("bucket", F.date_trunc("hour", "created_at"))


def lag_run(runs: DataFrame) -> DataFrame:
    """Chronologically preceding run of the same brand (K5): previous_id, previous_at.

    lag() inside a (brand, hour) bucket; the first run of an hour takes the last run of the
    brand's preceding bucket, found over one row per bucket.
    """
    rows = _bucketed(runs)
    inside = Window.partitionBy("brand_key", "bucket").orderBy("created_at", "run_id")
    mine = F.struct("created_at", "run_id")
    lasts = rows.groupBy("brand_key", "bucket").agg(F.max(mine).alias("last"))
    across = Window.partitionBy("brand_key").orderBy("bucket")
    carried = lasts.select("brand_key", "bucket", F.lag("last").over(across).alias("carried"))
    return (
        rows.withColumn("prev", F.lag(mine).over(inside)).join(carried, ["brand_key", "bucket"])
        .withColumn("prev", F.coalesce("prev", "carried"))
        .select(*runs.columns, F.col("prev.run_id").alias("previous_id"), F.col("prev.created_at").alias("previous_at")))


def as_of_run(dates: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest run of a brand at or before each date (K5, as-of form).

    ``dates``: brand_key, as_of, and any other columns.  Dates and runs are merged into one
    stream per (brand, hour) and the last run seen so far is carried forward; hours without an
    earlier run in the bucket take the last run of an earlier one.
    """
    extra = [c for c in dates.columns if c != "brand_key"]
    run = F.struct("created_at", "run_id")
    no_run = F.lit(None).cast(runs.select(run.alias("r")).schema["r"].dataType)
    points = dates.select(
        "brand_key", F.date_trunc("hour", "as_of").alias("bucket"), F.col("as_of").alias("at"), F.lit(1).alias("kind"),
        no_run.alias("run"), F.struct(*extra).alias("row"))
    stream = points.unionByName(runs.select(
        "brand_key", F.date_trunc("hour", "created_at").alias("bucket"), F.col("created_at").alias("at"),
        F.lit(0).alias("kind"), run.alias("run"),
        F.lit(None).cast(points.schema["row"].dataType).alias("row")))
    inside = Window.partitionBy("brand_key", "bucket").orderBy("at", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy("brand_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = stream.groupBy("brand_key", "bucket").agg(F.max("run").alias("last")).select(
        "brand_key", "bucket", F.max("last").over(across).alias("carried"))
    seen = stream.withColumn("found", F.max("run").over(inside)).where("kind = 1").join(
        carried, ["brand_key", "bucket"]).withColumn("found", F.coalesce("found", "carried"))
    return seen.select(
        "brand_key", "row.*", F.col("found.run_id").alias("run_id"), F.col("found.created_at").alias("created_at"))


def trend(runs: DataFrame) -> DataFrame:
    """Oldest-first series (K6)."""
    present = [m for m in METRICS if m in runs.columns]
    return runs.select("brand_key", "run_id", "created_at", *present).orderBy("brand_key", "created_at", "run_id")


def trend_summary(runs: DataFrame) -> DataFrame:
    """Ends, range and direction per brand (K7); a single point is 'one run'."""
    scored = runs.where(F.col("composite").isNotNull())
    value = F.col("composite")
    agg = scored.groupBy("brand_key").agg(
        F.count(F.lit(1)).alias("points"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.min_by(value, _recency()).alias("first"), F.max_by(value, _recency()).alias("last"))
    return agg.withColumn(
        "direction", F.when(F.col("points") < 2, "one run")
        .when(F.col("last") >= F.col("first"), "up").otherwise("down"))


def trend_points(runs: DataFrame) -> DataFrame:
    """Points of the sparkline scaled to 0..1 on both axes (K7)."""
    scored = _bucketed(runs.where(F.col("composite").isNotNull()))
    inside = Window.partitionBy("brand_key", "bucket").orderBy("created_at", "run_id")
    across = Window.partitionBy("brand_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = scored.groupBy("brand_key", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "brand_key", "bucket", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    ends = trend_summary(runs).where("points >= 2")
    span = F.col("high") - F.col("low")
    placed = scored.withColumn("i", F.row_number().over(inside) - 1).join(before, ["brand_key", "bucket"])
    return (
        placed.join(ends, "brand_key")
        .select("brand_key", "run_id", "created_at",
                ((F.col("i") + F.col("before")) / (F.col("points") - 1)).alias("x"),
                ((F.col("composite") - F.col("low")) / F.when(span == 0, 1.0).otherwise(span)).alias("y")))


def below_threshold(runs: DataFrame, limit: float = 0.5) -> DataFrame:
    """Runs that fail the gate (K8); unmeasured runs never do."""
    return runs.where(F.col("composite") < limit)


def provenance(answers: DataFrame, engines: DataFrame, runs: DataFrame) -> DataFrame:
    """Where a run's numbers come from (K9).

    ``engines``: engine, offline (a handful of rows).  ``runs``: run_id, brand_key,
    readiness, visibility, blocked.
    """
    used = answers.groupBy("run_id", "brand_key", "engine", "prompt_id").agg(F.count(F.lit(1)).alias("n"))
    facts = used.join(engines, "engine", "left").groupBy("run_id", "brand_key").agg(
        F.array_sort(F.collect_set("engine")).alias("engines"),
        F.min(F.coalesce("offline", F.lit(False))).alias("simulated"),
        F.count_distinct("prompt_id").alias("prompt_count"))
    return runs.join(facts, ["run_id", "brand_key"], "left").select(
        "run_id", "brand_key", F.coalesce("engines", F.array().cast("array<string>")).alias("engines"),
        F.coalesce("simulated", F.lit(False)).alias("simulated"),
        (F.col("readiness").isNull() | F.col("visibility").isNull()).alias("partial"),
        F.col("blocked").alias("crawl_blocked"), F.coalesce("prompt_count", F.lit(0)).alias("prompt_count"))
