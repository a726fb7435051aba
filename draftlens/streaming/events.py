"""Streams of edit events: ingest with defaults and consent, windows, and sessions closed by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlens.sources.readers import ACTIVITY


def read_events(spark: SparkSession, path: str, schema: str = ACTIVITY, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def ingest(events: DataFrame, consented: DataFrame) -> DataFrame:
    """Defaults for missing fields, the kind of event, its time; only of projects that consent.

    consented is static: it is read anew by each micro-batch that reads it from a table.
    """
    kind = F.when(F.col("onkey").isin("copy", "paste", "undo"), F.col("onkey")).otherwise("keystroke")
    rows = events.withColumns({"line": F.coalesce("line", F.lit(-1)), "message": F.coalesce("message", F.lit("No Message")), "kind": kind, "ts": F.timestamp_millis("timestamp")})
    return rows.join(consented.select("project").distinct(), "project", "left_semi")


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "10 minutes", slide: str | None = None, *keys: str) -> DataFrame:
    """Counts in tumbling or sliding windows; works on batches too."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def gap_sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a project closed by a gap alone."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "project")
        .agg(F.count("*").alias("n"))
        .select("project", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def append_to(rows: DataFrame, path: str, checkpoint: str):
    """Start an append of rows to Parquet; the checkpoint makes it exactly-once."""
    return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
