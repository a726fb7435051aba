"""Keyed tables that streams write to: upserts by batch that can be replayed, and consent that is read anew with each batch.

A table is a folder with a part for each batch, batch=N, and each part may be written again without effect on others, so that a batch
that is replayed after a failure changes nothing. Readers take the last row of a key by its order, and by the batch where that
is equal. compact() folds the parts up to a batch into one, and leaves one that a later replay of them would not change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlens.session import is_written, remove

_BATCH = "_batch"


def _parts(spark: SparkSession, path: str) -> list[int]:
    """Batches whose parts were written to their end."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    found = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
    return [n for n in found if is_written(spark, f"{path}/batch={n}")]


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by (order, batch): partial aggregation, so a key with many rows is no task of its own."""
    own = [c for c in rows.columns if c not in keys and c != _BATCH]
    # of rows of one order and batch the greatest stays, whichever order they come in
    last = F.max(F.struct(F.col(order).alias("_o"), F.col(_BATCH).alias("_b"), *own)).alias("_l")
    return rows.groupBy(*keys).agg(last).select(*keys, *(F.col(f"_l.{c}").alias(c) for c in own))


def upsert_batch(rows: DataFrame, batch_id: int, path: str, keys: list[str], order: str) -> None:
    """Write one batch's last row of each key as its part; again for the same batch, it replaces the part by itself.

    A batch that has been folded in by compact() is passed over.
    """
    if any(n > batch_id and is_written(rows.sparkSession, f"{path}/batch={n}/_folded") for n in _parts(rows.sparkSession, path)):
        return
    latest(rows.withColumn(_BATCH, F.lit(batch_id).cast("long")), keys, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_upserted(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The table as it stands: one row a key."""
    parts = _parts(spark, path)
    if not parts:
        raise FileNotFoundError(f"no batch is written in {path}")
    frames = [spark.read.parquet(f"{path}/batch={n}").withColumn(_BATCH, F.lit(n).cast("long")) for n in parts]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    return latest(rows, keys, order)


def compact(spark: SparkSession, path: str, keys: list[str], order: str) -> None:
    """Fold all parts into the last one. The table stays whole at every moment: the folded rows are written beside it first."""
    parts = _parts(spark, path)
    if len(parts) < 2:
        return
    last = parts[-1]
    folded = f"{path}/folding"
    read_upserted(spark, path, keys, order).write.mode("overwrite").parquet(folded)
    again = spark.read.parquet(folded)
    again.write.mode("overwrite").parquet(f"{path}/batch={last}")
    again.limit(0).write.mode("overwrite").parquet(f"{path}/batch={last}/_folded")
    for n in parts[:-1]:
        remove(spark, f"{path}/batch={n}")
    remove(spark, folded)


def consenting(rows: DataFrame, consent: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """Rows of the projects that consent has now."""
    return rows.join(consent(rows.sparkSession).select("project").distinct(), "project", "left_semi")


def upsert_stream(events: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, consent: Callable[[SparkSession], DataFrame] | None = None):
    """Start an upsert of a stream into the table at path.

    consent reads the table of consenting projects; it is called for each batch, so a project that withdraws is left out from the
    next batch on. Replayed batches have the numbers that they had, and replace their own parts.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        upsert_batch(consenting(rows, consent) if consent else rows, batch_id, path, keys, order)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
