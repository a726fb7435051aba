"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from draftlens.llm import decontam, packing, quality, simhash, substrings
from draftlens.session import is_written, remove, shared_folder, state_of


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, _labels(spark, sf_dir))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest doc_id stays."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that also start in a document of smaller doc_id are cut from the text; documents emptied by that go."""
    return substrings.remove_repeats(docs, keep_emptied=False)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, placed in sequences."""
    return packing.pack(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """All stages over documents; each stage's rows are a table in the shared folder, so a lost executor costs one stage at most.

    With a name, the tables stay, and a later run of that name over the same files and stages goes on after the last stage that was
    written to its end; over other ones it begins anew. Who changes a stage's code runs under another name.
    Without one, a stage's input is removed once its output is written, and the result when the driver ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = uuid.uuid4().hex
    if name is not None:
        files = state_of(docs, *(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark")))
        mark = f"{name}-{hashlib.sha256(':'.join([files, *(label for label, _ in STAGES)]).encode()).hexdigest()[:16]}"
    base, before = f"{shared_folder(spark)}/corpus-pipeline-{mark}", None
    if name is None:
        atexit.register(remove, spark, base)
    for k, (label, stage) in enumerate(STAGES):
        out = f"{base}/{k}-{label}"
        if not is_written(spark, out):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
        if name is None and before:
            remove(spark, before)
        before = out
    return docs
