"""Bounded samples of labelled documents, and the hold-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, modulus: int, held_out: int) -> DataFrame:
    """Rows (doc_id, text, lang, y) of at most `most` ids: labelled, not held out, the first by a hash of doc_id.

    A doc_id with several labels counts as the larger; null labels and ids take no part. The sample is at most `most`
    ids, so it is broadcast; a doc_id that docs repeats gives each of its rows (see first_rows).
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).alias("y"))
    known = known.filter(F.coalesce(remainder(F.col("_id"), modulus), F.lit(-1)) != held_out)
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "lang", F.col("y").cast("int").alias("y"))


def first_rows(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The first `most` rows in an order that says all of them, so that neither the rows nor their order depend on how they are dealt."""
    return rows.orderBy(*order).limit(most)
