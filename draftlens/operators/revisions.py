"""Documents as ordered revisions: building them, what changed between two, anomalies, and trajectories of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlens import vocab
from draftlens.functions import ids, text
from draftlens.operators.ordering import running_sums, sequenced


def in_order():
    """The window of a document's revisions; made where it is used, as it needs a session."""
    return Window.partitionBy("doc_id").orderBy("revision_index")


def build_documents(edits: DataFrame) -> DataFrame:
    """Raw edits (project, timestamp ms, tie, before_text, after_text, label, high_level) -> revisions of documents."""
    doc, after, before = ids.doc_id(F.col("project")), F.col("after_text"), F.col("before_text")
    timed = edits.withColumn("_ts", F.timestamp_millis("timestamp"))
    rows = sequenced(timed, "project", ts="_ts", carry=()).withColumns({"doc_id": doc, "revision_index": F.col("place").cast("int"), "text": text.normalize_text(after, text.nfc(after))})
    return rows.select(
        "doc_id",
        ids.revision_id(F.col("doc_id"), F.col("revision_index")).alias("revision_id"),
        "revision_index",
        "text",
        F.timestamp_millis("timestamp").alias("ts"),
        F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32).alias("provenance_hash"),
        text.normalize_text(before, text.nfc(before)).alias("before_text"),
        F.col("label").alias("writing_intention"),
        F.col("high_level").alias("high_level_category"),
    )


def from_conversations(turns: DataFrame) -> DataFrame:
    """Bind the conversations table to revisions: a conversation is a document, a turn a revision."""
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("revision_index"), F.coalesce("text", F.lit("")).alias("text"))


def word_deltas(revisions: DataFrame) -> DataFrame:
    """Words of each revision and the change since the one before."""
    n = text.word_count(F.col("text"))
    return revisions.select("doc_id", "revision_index", n.alias("n_words")).withColumn("delta", F.col("n_words") - F.lag("n_words").over(in_order()))


def added_and_deleted(deltas: DataFrame) -> DataFrame:
    d = F.col("delta")
    return deltas.groupBy("doc_id").agg(F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0)).alias("added"), F.coalesce(F.sum(F.when(d < 0, -d)), F.lit(0)).alias("deleted"))


def anomalies(revisions: DataFrame, delta: Column | None = None) -> DataFrame:
    """The first rule that a revision breaks against the one before; null for none. delta: seconds since it, if known."""
    before = F.lag(F.struct("revision_index", "text")).over(in_order())
    rows = revisions.withColumn("_b", before)
    old, new = F.col("_b.text"), F.col("text")
    both = (old != "") & (new != "")
    kind = F.when(F.col("_b").isNull(), None).when(F.col("revision_index") != F.col("_b.revision_index") + 1, "anomaly.missing_revision")
    if delta is not None:
        kind = kind.when(delta < 0, "anomaly.timestamp_jitter")
    kind = kind.when(both & (F.char_length(new) < F.char_length(old) * vocab.TRUNCATION), "anomaly.truncation")
    kind = kind.when(both & (text.word_jaccard(old, new) < vocab.LARGE_DIFF_JACCARD), "anomaly.large_diff")
    return rows.withColumn("anomaly", kind).drop("_b")


def consecutive_jaccard(revisions: DataFrame) -> DataFrame:
    before = F.lag("text").over(in_order())
    return revisions.withColumn("_b", before).filter("_b is not null").select("doc_id", "revision_index", F.round(text.word_jaccard(F.col("_b"), F.col("text")), 6).alias("jaccard"))


def edit_rank(old: Column, new: Column) -> Column:
    """0 for none, 1 for light, 2 for substantial: distinct tokens added and removed, against the longer token list."""
    ratio = (F.size(F.array_except(new, old)) + F.size(F.array_except(old, new))) / F.greatest(F.size(old), F.size(new), F.lit(1))
    return F.when(old == new, 0).when(ratio >= vocab.SUBSTANTIAL_EDIT, 2).when(ratio > 0, 1).otherwise(0)


def edit_classes(revisions: DataFrame, start: Column, end: Column, birth: int = 0, pattern: str = r"(?U)\w+") -> DataFrame:
    """Edits of the fixed window [start, end) in each revision after birth, and the trajectory's state there.

    Every step of the state machine is the larger of state and edit, so the state is a running maximum.
    """
    window = F.substring(F.col("text"), start + 1, end - start)
    rows = revisions.filter(F.col("revision_index") >= birth).withColumn("_t", text.tokens(window, pattern))
    rank = F.when(F.lag("_t").over(in_order()).isNull(), 0).otherwise(edit_rank(F.lag("_t").over(in_order()), F.col("_t")))
    rows = rows.withColumn("edit", rank)
    return rows.withColumn("state", F.max("edit").over(in_order().rowsBetween(Window.unboundedPreceding, 0))).select("doc_id", "revision_index", "edit", "state")


def state_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, vocab.STATES)), rank + 1)


def state_flag(rank: Column) -> Column:
    """Ambiguity from edits: none, low, medium."""
    return F.element_at(F.array(*map(F.lit, vocab.FLAGS[:3])), rank + 1)


def trajectories(classes: DataFrame) -> DataFrame:
    """Final state and flag of each document's window, and the revisions at which the state rose."""
    risen = F.col("state") > F.coalesce(F.lag("state").over(in_order()), F.lit(-1))
    steps = classes.withColumn("_s", F.when(risen, F.struct("revision_index", state_name(F.col("state")).alias("state"))))
    out = steps.groupBy("doc_id").agg(F.max("state").alias("rank"), F.array_sort(F.collect_list("_s")).alias("history"))
    return out.select("doc_id", state_name(F.col("rank")).alias("state"), state_flag(F.col("rank")).alias("flag"), "history")


def as_of(revisions: DataFrame, versions: DataFrame) -> DataFrame:
    """The newest version (doc_id, born, value) at each revision: carried forward by a window, not by a range join."""
    marks = versions.select("doc_id", F.col("born").alias("revision_index"), "value", F.lit(0).alias("_row"))
    rows = revisions.select("doc_id", "revision_index", F.lit(None).cast(versions.schema["value"].dataType).alias("value"), F.lit(1).alias("_row"))
    w = Window.partitionBy("doc_id").orderBy("revision_index", "_row").rowsBetween(Window.unboundedPreceding, 0)
    return rows.unionByName(marks).withColumn("value", F.last("value", ignorenulls=True).over(w)).filter("_row = 1").drop("_row")


def active_totals(revisions: DataFrame, spans: DataFrame, grain: int = 4096) -> DataFrame:
    """How many spans (doc_id, born, size) are active at each revision, those born at or before it, and their size in all; none, no row.

    Running sums over births and revisions in one order, cut by number, so no span meets its later revisions one by one.
    """
    born = spans.groupBy("doc_id", F.col("born").alias("revision_index")).agg(F.count("*").alias("_n"), F.sum("size").cast("long").alias("_s"))
    rows = revisions.select("doc_id", "revision_index").distinct().withColumn("_is", F.lit(True)).join(born, ["doc_id", "revision_index"], "full")
    sums = {name: F.coalesce(value, F.lit(0)) for value, name in (("_n", "n_active"), ("_s", "chars"))}
    rows = running_sums(rows, sums, "doc_id", ts="revision_index", tie="revision_index", grain=grain)
    return rows.filter("_is and n_active > 0").select("doc_id", "revision_index", "n_active", "chars")


def carry_forward(revisions: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans active at each revision: those born at or before it. Texts stay out of this join; only keys and offsets fan out."""
    keys = revisions.select("doc_id", "revision_index")
    return keys.join(spans, "doc_id").filter(F.col("born") <= F.col("revision_index"))
