"""Screening of texts: personal data, leaked prompts, templates, discontinuity, and discourse density."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlens import vocab
from draftlens.functions import text as T
from draftlens.operators.metrics import auc, binary_f1
from draftlens.session import ship_package, union_all


def pii_counts(docs: DataFrame) -> DataFrame:
    """Matches of each rule in each text that has any: doc_id, rule_id, severity, n."""
    rules = F.array(
        *(
            F.struct(F.lit(r).alias("rule_id"), F.lit("high" if r in vocab.PII_STRICT else "medium").alias("severity"), F.size(T.pii_matches(F.col("text"), r)).alias("n"))
            for r in (*vocab.PII_STRICT, *vocab.PII_HEURISTIC)
        )
    )
    return docs.select("doc_id", F.inline(rules)).filter("n > 0")


def _finding(rule: str, severity: str):
    return lambda x: F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), x["start"].alias("span_start"), x["end"].alias("span_end"))


def pii_findings(docs: DataFrame) -> DataFrame:
    """Every match with its place and ten characters each side.

    Places come from the lengths of what lies between a rule's matches, so the time grows in proportion to the text.
    """
    parts = []
    for r in (*vocab.PII_STRICT, *vocab.PII_HEURISTIC):
        severity = "high" if r in vocab.PII_STRICT else "medium"
        parts.append(F.transform(T.pii_places(F.col("text"), r), _finding(r, severity)))
    rows = docs.select("doc_id", "text", F.inline(F.concat(*parts)))
    lo, hi = F.greatest(F.lit(0), F.col("span_start") - 10), F.least(F.char_length("text"), F.col("span_end") + 10)
    return rows.withColumn("snippet", F.concat(F.lit("..."), F.substring(F.col("text"), lo + 1, hi - lo), F.lit("..."))).drop("text")


def flags(docs: DataFrame) -> DataFrame:
    """Leaked prompt by the strict rule, pattern hits, template hits."""
    return docs.select("doc_id", T.leaks_prompt(F.col("text")).alias("leaks"), F.size(T.leakage_patterns(F.col("text"))).alias("n_patterns"), T.matches_template(F.col("text")).alias("template"))


def pattern_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(T.leakage_patterns(F.col("text"))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


def contained_templates(docs: DataFrame, templates: DataFrame, size: int = 8, broadcast_templates: int = 100_000, tried_templates: int = 64) -> DataFrame:
    """Texts that contain a template's whole text, case aside: doc_id, item_id. Rows without doc_id take no part; null and blank templates are in none.

    All but the first and last word of a template stand as whole words wherever it occurs. A text's runs of up to `size` words are
    hashed within its row, and its distinct hashes meet those of the templates' inner words; templates of fewer than three
    words go by their first three characters in the same way. Texts meet only the templates of their matches, and are searched for
    the whole. Hashes alone are sent to all up to `broadcast_templates`, and shuffled beyond; short templates that are at most
    `tried_templates` (and a million characters) are tried on each text where it is read.
    """
    t = templates.select("item_id", F.lower(T.strip(F.col("text"))).alias("body")).filter("body <> ''").withColumn("tw", T.words(F.col("body")))
    sizes = t.groupBy(F.least(F.greatest(F.size("tw") - 2, F.lit(0)), F.lit(size)).alias("n")).agg(F.count("*").alias("c"), F.sum(F.char_length("body")).alias("chars"))
    sizes = sizes.collect()  # at most size + 1 rows
    counts, chars = {r["n"]: r["c"] for r in sizes}, {r["n"]: r["chars"] for r in sizes}
    held = F.broadcast if sum(counts.values()) <= broadcast_templates else (lambda x: x)
    d = docs.filter("doc_id is not null").select("doc_id", F.lower(T.empty_if_null(F.col("text"))).alias("low"))
    n = F.least(F.size("tw") - 2, F.lit(size))
    keyed = t.filter(F.size("tw") >= 3).select("item_id", "body", F.xxhash64(F.slice(F.col("tw"), F.lit(2), n), n).alias("h"))
    lengths = [k for k in counts if k > 0]

    def runs(w: Column) -> Column:
        of = lambda k: F.transform(w, lambda _, i: F.when(i + k <= F.size(w), F.xxhash64(F.slice(w, i + 1, F.lit(k)), F.lit(k))))
        return F.array_distinct(F.array_compact(F.concat(*map(of, lengths))))

    parts = []
    if lengths:
        met = d.select("doc_id", F.explode(T.let(T.words(F.col("low")), runs)).alias("h")).join(held(keyed.select("item_id", "h")), "h")
        parts.append(_verified(d, met, keyed))
    few = t.filter(F.size("tw") < 3).select("item_id", "body")
    if 0 < counts.get(0, 0) <= tried_templates and chars[0] <= 1 << 20:
        tried = F.broadcast(few.agg(F.collect_list(F.struct("item_id", "body")).alias("few")))
        parts.append(d.join(tried, how="cross").select("doc_id", F.explode(F.filter("few", lambda x: F.contains(F.col("low"), x["body"]))).alias("x")).select("doc_id", "x.item_id"))
    elif counts.get(0, 0):
        few = few.withColumn("h", F.substring("body", 1, 3))
        starts = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda x, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size(c) - i)), lambda k: F.array_join(F.slice(c, i + 1, k), "")))))
        met = d.select("doc_id", F.explode(T.let(F.filter(F.split("low", ""), lambda x: x != ""), starts)).alias("h")).join(held(few.select("item_id", "h")), "h")
        parts.append(_verified(d, met, few))
    return union_all(parts).distinct() if parts else d.join(t, how="left_semi", on=F.lit(False)).select("doc_id", F.lit(None).cast(t.schema["item_id"].dataType).alias("item_id"))


def _verified(docs: DataFrame, met: DataFrame, templates: DataFrame) -> DataFrame:
    """Pairs of met (doc_id, item_id) whose text (low) holds the template (body)."""
    pairs = met.select("doc_id", "item_id").distinct().join(templates.select("item_id", "body").distinct(), "item_id")
    return docs.join(pairs, "doc_id").filter(F.contains("low", "body")).select("doc_id", "item_id")


def compression_distance(a: str, b: str) -> float:
    """How much longer both texts compress than the shorter alone, over the longer: 0 to 1, and 0 where the first is empty."""
    if not a:
        return 0.0
    ca, cb, both = (len(zlib.compress(s.encode("utf-8", "replace"))) for s in (a, b, f"{a} {b}"))
    return min(1.0, max(0.0, (both - min(ca, cb)) / max(ca, cb)))


def _ncd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [compression_distance(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["doc_id", "revision_index", "ncd"])


def discontinuity(revisions: DataFrame) -> DataFrame:
    """Compression distance of each revision from the one before; zero where there is none or it is empty."""
    ship_package(revisions.sparkSession)
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("revision_index"))
    rows = revisions.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("revision_index").cast("int").alias("revision_index"), F.coalesce(before, F.lit("")).alias("a"), F.coalesce("text", F.lit("")).alias("b"))
    return rows.mapInArrow(_ncd, "doc_id string, revision_index int, ncd double")


def compression_anomalies(revisions: DataFrame, cut: float = vocab.NCD_CUT) -> DataFrame:
    """Whether each revision's compression distance from the one before lies above cut."""
    return discontinuity(revisions).withColumn("anomalous", F.col("ncd") > cut)


def baselines(scores: DataFrame, cut: float = vocab.NCD_CUT) -> DataFrame:
    """AUC of the score and F1 above cut, as (metric, value): scores (y boolean, ncd, coupling)."""
    parts = [
        auc(scores, F.col("y"), F.col("ncd")).select(F.lit("ncd_auc").alias("metric"), F.col("auc").alias("value")),
        auc(scores, F.col("y"), F.abs("coupling")).select(F.lit("causal_coupling_auc").alias("metric"), F.col("auc").alias("value")),
        binary_f1(scores, F.col("y"), F.col("ncd") > cut).select(F.lit("overall_f1").alias("metric"), F.col("f1").alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def density(docs: DataFrame) -> DataFrame:
    """Discourse markers, words, and the demand estimate."""
    return docs.select("doc_id", T.discourse_count(F.col("text")).alias("n_markers"), T.word_count(F.col("text")).alias("n_words"), F.round(T.syntactic_demand(F.col("text")), 6).alias("demand"))
