"""Sinks: JSON lines (replaced or appended), metrics as CSV and JSON, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlens.sources.readers import relative_checksums


def nest_revisions(revisions: DataFrame) -> DataFrame:
    """Flat revisions -> one row a document with its revisions in order."""
    fields = [c for c in revisions.columns]
    ordered = F.array_sort(F.collect_list(F.struct("revision_index", F.struct(*fields).alias("r"))))
    return revisions.groupBy("doc_id").agg(F.transform(ordered, lambda x: x["r"]).alias("revisions"))


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def append_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("append").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """metric, value sorted by name: a report of some dozen rows, computed once, so one file."""
    rows = sorted(metrics.collect(), key=lambda r: r["metric"])
    one = metrics.sparkSession.createDataFrame(rows, metrics.schema).coalesce(1)
    one.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    one.write.mode("overwrite").json(f"{path}/json")


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_failures(bad: DataFrame, path: str) -> None:
    bad.write.mode("append").json(path)


def write_manifest(spark: SparkSession, path: str, manifest: str, pattern: str = "*") -> None:
    """The checksum and size of every file below path that is not empty, by its name from there, for verify_manifest()."""
    relative_checksums(spark, path, pattern).write.mode("overwrite").json(manifest)
