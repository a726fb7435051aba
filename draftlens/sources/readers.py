"""Sources: Parquet splits, JSON lines with explicit schemas, text-file sequences, binary files for checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftlens import vocab

EDITS = "project int, timestamp bigint, author string, `before text` string, `after text` string, label string, `high-level` string"
REVISION = "doc_id string, revision_id string, revision_index int, text string, timestamp string, provenance_hash string, before_text string, writing_intention string, high_level_category string"
EVENT = "struct<intention:string,actual_output:string,status:string,failure_mode:string,repair_artifact:string,glucose_at_event:double,latency_ms:double,syntactic_complexity:double>"
GENERATION = "struct<model_id:string,temperature:double,max_tokens:int,top_p:double,top_k:int,presence_penalty:double,frequency_penalty:double,repetition_penalty:double,seed:bigint,attempt_number:int,cognitive_glucose:double,cognitive_fatigue:double,cognitive_attention:double>"
SPAN = (
    "struct<doc_id:string,revision_id:string,injection_id:string,injection_level:string,trajectory_state:string,ambiguity_flag:string,span_start_char:int,span_end_char:int,"
    "span_start_sentence:int,span_end_sentence:int,generator_class:string,prompt_hash:string,rng_seed:bigint,provenance_hash:string,label:string,original_start_char:int,"
    f"original_end_char:int,biometric_salt:string,causal_trace:array<{EVENT}>,generation_metadata:{GENERATION}>"
)
SEED_DOCUMENT = f"doc_id string, revisions array<struct<{', '.join(c.replace(' ', ':', 1) for c in REVISION.split(', '))}>>"
AUGMENTED_DOCUMENT = f"doc_id string, revisions array<struct<{', '.join(c.replace(' ', ':', 1) for c in REVISION.split(', '))}, annotations:array<{SPAN}>>>"
INJECTION = f"span {SPAN}, generated_text string, model string"
ACTIVITY = "timestamp bigint, username string, project string, file string, line int, editingLines array<int>, message string, state string, revision array<array<string>>, text string, clipboard array<string>, changes array<string>, index bigint, label array<string>, onkey string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_parquet_dir(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """All matching files below a folder, or one file."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(path)


def read_split(spark: SparkSession, base: str, split: str) -> DataFrame:
    if split not in vocab.SPLITS:
        raise ValueError(f"unknown split {split!r}; known: {', '.join(vocab.SPLITS)}")
    return read_parquet_dir(spark, base, f"{split}-*.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header line, columns by name whatever their order, quoted fields over several lines, types as schema says."""
    fields = spark.createDataFrame([], schema).schema.fields
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    missing = [f.name for f in fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    return raw.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and the lines that don't. Both come from one scan definition with an explicit schema."""
    raw = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", raw.schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    good = parsed.filter("x._bad is null").select("x.*").drop("_bad")
    return good, parsed.filter("x._bad is not null").select(F.col("value").alias("line"))


def last_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by order: what an upsert leaves."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def explode_revisions(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("revisions").alias("r")).select("r.*")


def explode_spans(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("revisions").alias("r")).select(F.col("r.revision_index"), F.explode("r.annotations").alias("s")).select("revision_index", "s.*")


def read_sequence(spark: SparkSession, path: str, pattern: str = "iter_*.txt") -> DataFrame:
    """One value a file, with the number in its name: idx, value (right-stripped)."""
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).text(path).select("value", F.col("_metadata.file_name").alias("file"))
    return raw.select(F.regexp_extract("file", r"(\d+)", 1).cast("int").alias("idx"), F.rtrim(F.regexp_replace("value", r"\s+\z", "")).alias("value"))


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).filter(F.trim("value") != "").count()


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("checksum"))


def relative_checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """checksums() with paths from `path` on."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    return checksums(spark, path, pattern).withColumn("path", F.substring_index("path", root, -1))


def verify_manifest(spark: SparkSession, path: str, manifest: str, pattern: str = "*") -> DataFrame:
    """Files that are not as the manifest says, after one scan of them: path, state (changed, missing or extra), expected, found."""
    told = spark.read.schema("path string, length long, checksum string").json(manifest).select("path", F.col("checksum").alias("expected"))
    both = told.join(relative_checksums(spark, path, pattern).select("path", F.col("checksum").alias("found")), "path", "full")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("found") != F.col("expected"), "changed")
    return both.withColumn("state", state).filter("state is not null").select("path", "state", "expected", "found")


def unfinished(rows: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is not in an earlier output: resume."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
