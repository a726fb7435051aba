"""Calibration of the process model from real revisions: intervals, deltas, rates by minute, and fits to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlens import vocab
from draftlens.operators.ordering import exact_median, sequenced

TOKENS_PER_MINUTE = 50
LEAST_RATE, MOST_RATE = 0.990, 0.9999


def steps(revisions: DataFrame, grain: int = 4096) -> DataFrame:
    """revisions (doc_id, revision_index, ts, text) -> what passed since the one before: interval_ms, delta, minute of the session.

    A document's revisions are cut by their numbers, so a long one is not one task.
    """
    rows = revisions.select("doc_id", "revision_index", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.char_length(F.coalesce("text", F.lit(""))).alias("size"))
    first = rows.groupBy("doc_id").agg(F.min_by("us", "revision_index").alias("first"))
    rows = sequenced(rows, "doc_id", ts="revision_index", tie="revision_index", carry=("us", "size"), grain=grain).join(first, "doc_id")
    since = lambda c: F.col(c) - F.col(f"prev.{c}")
    out = rows.select("doc_id", "revision_index", (since("us") / 1000.0).alias("interval_ms"), since("size").alias("delta"), F.floor((F.col("us") - F.col("first")) / 60_000_000).cast("long").alias("minute"))
    return out.filter("interval_ms > 0")


def minute_rates(found: DataFrame) -> DataFrame:
    """Characters added in each minute of a document's session, and that over its first such minute."""
    made = found.filter("delta > 0").groupBy("doc_id", "minute").agg(F.sum("delta").alias("chars"))
    base = F.first("chars").over(Window.partitionBy("doc_id").orderBy("minute"))
    return made.withColumn("relative", F.col("chars") / base)


def depletion(rates: DataFrame) -> DataFrame:
    """Rate and R2 of a log-linear decline of relative rates within 0.1 and 2; the default rate where nothing declines."""
    kept = rates.filter(F.col("relative").between(0.1, 2.0)).select(F.col("minute").cast("double").alias("x"), F.log("relative").alias("y"))
    fit = kept.agg(F.count("*").alias("n"), F.max("x").alias("hi"), F.min("x").alias("lo"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"))
    known = (F.col("n") >= 5) & (F.col("hi") > F.col("lo"))
    rate = F.when(known & (F.col("slope") < 0), F.greatest(F.lit(LEAST_RATE), F.least(F.lit(MOST_RATE), F.exp(F.col("slope") / TOKENS_PER_MINUTE)))).otherwise(vocab.GLUCOSE_DECAY)
    return fit.select("n", F.round(rate, 6).alias("rate"), F.round(F.when(known, F.greatest(F.lit(0.0), F.coalesce("r2", F.lit(0.0)))).otherwise(0.0), 6).alias("r2"))


def fatigue_divisor(rates: DataFrame) -> DataFrame:
    """Median of what had been produced, over one half, where the rate fell by more than a twentieth: per document."""
    w = Window.partitionBy("doc_id").orderBy("minute")
    rows = rates.withColumns({"_b": F.lag("chars").over(w), "_c": F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.count("*").over(Window.partitionBy("doc_id"))})
    falls = (F.col("_n") >= 10) & ((F.col("chars") - F.col("_b")) / F.col("_b") < -0.05)
    return rows.groupBy("doc_id").agg(F.coalesce(F.median(F.when(falls, F.col("_c") / 0.5)), F.lit(vocab.FATIGUE_TOKENS)).alias("divisor"))


def report(found: DataFrame) -> DataFrame:
    """Spread of intervals and absolute deltas; deviations are zero for one value."""
    d = F.abs("delta").cast("double")
    sums = found.agg(
        F.count("*").alias("n"),
        F.round(F.avg("interval_ms"), 3).alias("mean_ms"),
        F.round(F.coalesce(F.stddev_samp("interval_ms"), F.lit(0.0)), 3).alias("sd_ms"),
        F.round(F.avg(F.when(d > 0, d)), 6).alias("mean_delta"),
    )
    middle = exact_median(found, F.col("interval_ms"), "median_ms").select(F.round("median_ms", 3).alias("median_ms"))
    return sums.join(middle, how="cross").select("n", "mean_ms", "median_ms", "sd_ms", "mean_delta")  # one row by one row
