"""Annotated spans: insertion, offsets, erosion, overlap, and the rules they must keep, as violation rows.

Spans have doc_id, revision_index, injection_id, label, level, state, flag, start, end (exclusive) and may have trace,
generator_class, prompt_hash, provenance_hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlens import vocab
from draftlens.functions import text as T
from draftlens.operators import traces
from draftlens.session import union_all

SPAN = "array<struct<injection_id:string,start:int,end:int>>"
VIOLATION = ("doc_id", "revision_index", "injection_id", "error_type", "message")


def insert_all(text: Column, records: Column) -> Column:
    """Insert records (injection_id, start, body), in list order, into text: struct of text and spans.

    Every earlier record shifts a later one by its length, wherever it went in; places are held inside the text.
    """
    begin = F.struct(text.alias("text"), F.lit(0).alias("moved"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, r: Column) -> Column:
        at = F.greatest(F.lit(0), F.least(r["start"] + acc["moved"], F.char_length(acc["text"])))
        size = F.char_length(r["body"])
        made = F.concat(F.substring(acc["text"], F.lit(1), at), r["body"], F.substring(acc["text"], at + 1, F.char_length(acc["text"])))
        return F.struct(made.alias("text"), (acc["moved"] + size).alias("moved"), F.array_append(acc["spans"], F.struct(r["injection_id"].alias("injection_id"), at.alias("start"), (at + size).alias("end"))).alias("spans"))

    return F.aggregate(records, begin, step, lambda acc: F.struct(acc["text"].alias("text"), acc["spans"].alias("spans")))


def insertion_errors(text: Column, start: Column, end: Column, expected: Column) -> Column:
    """What is wrong with an inserted span: bounds, missing content, blank content."""
    body = F.substring(text, start + 1, end - start)
    return F.array_compact(
        F.array(
            F.when((start < 0) | (end > F.char_length(text)) | (start >= end), "bounds"),
            F.when(~F.contains(body, expected), "content"),
            F.when(T.strip(body) == "", "blank"),
        )
    )


def erosion(spans: DataFrame) -> DataFrame:
    """How far a span's edges move in later revisions that hold it: mean |shift| of both ends over its size, 1 at most.

    Spans seldom move, so it is runs of revisions with equal edges that are compared, not revisions: within a run nothing
    shifts, and all its revisions see the same later runs. An id stands once in a revision. The last one has no row.
    """
    by = Window.partitionBy("doc_id", "injection_id")
    w = by.orderBy("revision_index")
    moves = F.coalesce((F.lag("start").over(w) != F.col("start")) | (F.lag("end").over(w) != F.col("end")), F.lit(False))
    rows = spans.select("doc_id", "injection_id", "revision_index", "start", "end").withColumns({"_m": moves.cast("int"), "n_later": F.count("*").over(by) - F.row_number().over(w)})
    rows = rows.withColumn("_run", F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("doc_id", "injection_id", "_run").agg(F.first("start").alias("start"), F.first("end").alias("end"), F.count("*").alias("_n"))
    later = runs.select("doc_id", "injection_id", F.col("_run").alias("_r2"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("_n").alias("_n2"))
    shift = F.col("_n2") * (F.abs(F.col("s2") - F.col("start")) + F.abs(F.col("e2") - F.col("end")))
    moved = runs.join(later, ["doc_id", "injection_id"]).filter("_r2 > _run").groupBy("doc_id", "injection_id", "_run").agg(F.sum(shift).alias("_moved"))
    size = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    mean = F.coalesce("_moved", F.lit(0)) / size / F.col("n_later")
    out = rows.filter("n_later > 0").join(moved, ["doc_id", "injection_id", "_run"], "left")
    return out.select("doc_id", "injection_id", "revision_index", F.round(F.least(F.lit(1.0), mean), 6).alias("erosion"), F.col("n_later").cast("long").alias("n_later"))


def overlaps(spans: DataFrame) -> DataFrame:
    """Spans whose next by start begins before they end."""
    w = Window.partitionBy("doc_id", "revision_index").orderBy("start", "end", "injection_id")
    rows = spans.withColumns({"next_id": F.lead("injection_id").over(w), "next_start": F.lead("start").over(w)})
    return rows.filter("next_start < end").select("doc_id", "revision_index", "injection_id", "next_id")


def iou(predicted: DataFrame, truth: DataFrame, *keys: str, every: DataFrame | None = None) -> DataFrame:
    """Intersection over union of merged intervals (start, end) within keys (none: all on one axis). Two empty sides agree: 1.

    every: the keys that get a row even if neither side has an interval there; without keys there is one row in any case. Swept over end points: at each the number of open intervals of either side is a running sum, so no pairs are made.
    """
    keys = keys or ("_all",)

    def points(rows: DataFrame, side: str) -> DataFrame:
        rows = rows.filter("end > start").withColumn("_all", F.lit(0)) if "_all" in keys else rows.filter("end > start")
        one = rows.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("p"))
        return one.select(*keys, "p.at", F.when(F.lit(side == "p"), F.col("p.d")).otherwise(0).alias("dp"), F.when(F.lit(side == "t"), F.col("p.d")).otherwise(0).alias("dt"))

    both = points(predicted, "p").unionByName(points(truth, "t")).groupBy(*keys, "at").agg(F.sum("dp").alias("dp"), F.sum("dt").alias("dt"))
    w = Window.partitionBy(*keys).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    seg = both.withColumns({"p": F.sum("dp").over(run) > 0, "t": F.sum("dt").over(run) > 0, "len": F.lead("at").over(w) - F.col("at")})
    sums = seg.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("p") & F.col("t"), F.col("len"))), F.lit(0)).alias("inter"), F.coalesce(F.sum(F.when(F.col("p") | F.col("t"), F.col("len"))), F.lit(0)).alias("union"))
    if "_all" in keys:
        sums = sums.agg(F.coalesce(F.max("inter"), F.lit(0)).cast("long").alias("inter"), F.coalesce(F.max("union"), F.lit(0)).cast("long").alias("union"))
    elif every is not None:
        sums = every.select(*keys).distinct().join(sums, list(keys), "left").na.fill(0, ["inter", "union"])
    return sums.withColumn("iou", F.round(F.coalesce(F.try_divide("inter", "union"), F.lit(1.0)), 6))


# rules, as rows


def _violations(rows: DataFrame, kind: str, *rules: tuple[Column, Column | str]) -> DataFrame:
    """One row for each rule broken: rules are (broken, message)."""
    broken = F.array_compact(F.array(*(F.when(bad, m if isinstance(m, Column) else F.lit(m)) for bad, m in rules)))
    return rows.select("doc_id", "revision_index", "injection_id", F.lit(kind).alias("error_type"), F.explode(broken).alias("message"))


def constraint_violations(spans: DataFrame) -> DataFrame:
    """Injections need level and state, anomalies neither."""
    inj, ano = F.col("label").startswith("injection."), F.col("label").startswith("anomaly.")
    has, both = F.col("level").isNotNull() | F.col("state").isNotNull(), F.col("level").isNotNull() & F.col("state").isNotNull()
    return _violations(spans, "constraint", (inj & ~both, "injection label requires level and state"), (ano & has, "anomaly label forbids level and state"))


def boundary_violations(spans: DataFrame, revisions: DataFrame) -> DataFrame:
    """Offsets inside the text and in order; where spans have start_sentence and end_sentence, those too."""
    n = revisions.select("doc_id", "revision_index", F.char_length("text").alias("_n"))
    s, e = F.col("start"), F.col("end")
    rules = [
        (s < 0, F.concat(F.lit("start "), s.cast("string"), F.lit(" is negative"))),
        (e > F.col("_n"), F.concat(F.lit("end "), e.cast("string"), F.lit(" exceeds text length "), F.col("_n").cast("string"))),
        (s > e, "start lies after end"),
    ]
    if {"start_sentence", "end_sentence"} <= set(spans.columns):
        a, b = F.col("start_sentence"), F.col("end_sentence")
        rules += [(a < 0, F.concat(F.lit("start sentence "), a.cast("string"), F.lit(" is negative"))), (a > b, "start sentence lies after end sentence")]
    return _violations(spans.join(n, ["doc_id", "revision_index"]), "boundary", *rules)


def revision_violations(spans: DataFrame, revisions: DataFrame) -> DataFrame:
    """What a check of one revision reports: a span out of bounds, once, and what an injection's trace does not earn."""
    n = revisions.select("doc_id", "revision_index", F.char_length("text").alias("_n"))
    out = _violations(spans.join(n, ["doc_id", "revision_index"]), "boundary", ((F.col("start") < 0) | (F.col("end") > F.col("_n")), "Offset out of bounds"))
    earned = earned_label_violations(spans.filter(F.col("label").startswith("injection.")))
    return out.unionByName(earned.withColumn("error_type", F.lit("causal_integrity")))


def trace_sufficiency_violations(spans: DataFrame) -> DataFrame:
    """Warm states need three events, assimilated ones five."""
    n = F.coalesce(F.size("trace"), F.lit(0))
    rule = lambda state, least: ((F.col("state") == state) & (n < least), F.concat(F.lit(f"{state} requires {least} events, got "), n.cast("string")))
    return _violations(spans, "trace_sufficiency", rule("warm", vocab.TRACE_WARM), rule("assimilated", vocab.TRACE_ASSIMILATED))


def coupling_flag_violations(spans: DataFrame) -> DataFrame:
    """Medium and high flags need a trace, and a coupling that supports them."""
    rows = traces.with_signatures(spans.withColumn("_t", F.coalesce("trace", F.array().cast(spans.schema["trace"].dataType))), "_t").withColumn("_n", F.size("_t"))
    flag, r, n = F.col("flag"), F.abs("coupling"), F.col("_n")
    return _violations(
        rows,
        "coupling_support",
        (flag.isin("medium", "high") & (n == 0), F.concat(flag, F.lit(" requires a trace"))),
        ((flag == "high") & (n > 0) & (r < vocab.COUPLING_EARNED_HIGH), "high requires coupling 0.5"),
        ((flag == "medium") & (n > 0) & (r < vocab.COUPLING_EARNED_WARM), "medium requires coupling 0.3"),
    )


def _content(spans: DataFrame, revisions: DataFrame, expected: DataFrame | None) -> DataFrame:
    """Injections with the first rule that their content breaks as message, null for none."""
    rows = spans.filter(F.col("label").startswith("injection.")).join(revisions.select("doc_id", "revision_index", "text"), ["doc_id", "revision_index"])
    rows = rows.join(expected.select("injection_id", "expected"), "injection_id", "left") if expected is not None else rows.withColumn("expected", F.lit(None).cast("string"))
    s, e, n = F.col("start"), F.col("end"), F.char_length("text")
    body = F.substring(F.col("text"), s + 1, e - s)
    first = (
        F.when(s >= n, "start exceeds text length")
        .when(e > n, "end exceeds text length")
        .when(s < 0, "start is negative")
        .when(s > e, "start lies after end")
        .when(T.strip(body) == "", "content is empty or blank")
        .when(F.col("expected").isNotNull() & ~F.contains(body, F.col("expected")), "expected content not found")
    )
    return rows.select("doc_id", "revision_index", "injection_id", first.alias("message"))


def content_violations(spans: DataFrame, revisions: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """The first rule that a span's content breaks: start past the text, end past it, negative, crossed, blank, not as expected.

    expected: injection_id (once each) and the text that its span must hold; a span without one may hold anything.
    """
    return _content(spans, revisions, expected).filter("message is not null").select("doc_id", "revision_index", "injection_id", F.lit("span_content").alias("error_type"), "message")


def content_totals(spans: DataFrame, revisions: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """One row: documents and revisions checked, injections verified, those that failed, and their share (zero for none)."""
    found = _content(spans, revisions, expected).agg(F.count("*").alias("spans_verified"), F.count("message").alias("spans_failed"))
    of = revisions.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("documents_checked"), F.coalesce(F.sum("n"), F.lit(0)).alias("revisions_checked"))
    share = F.round(F.coalesce(F.try_divide("spans_failed", "spans_verified"), F.lit(0.0)), 6)
    return of.join(found, how="cross").withColumn("failure_rate", share)  # one row by one row


def flag_violations(spans: DataFrame) -> DataFrame:
    """State against flag: warm needs one, assimilated needs medium or high."""
    return _violations(
        spans,
        "ambiguity",
        ((F.col("state") == "warm") & (F.col("flag") == "none"), "warm requires at least low"),
        ((F.col("state") == "assimilated") & F.col("flag").isin("none", "low"), "assimilated requires at least medium"),
    )


def metadata_violations(spans: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return _violations(spans.filter(F.col("label").startswith("injection.")), "consistency", *((blank(c), f"missing {c}") for c in ("provenance_hash", "generator_class", "prompt_hash")))


def earned_label_violations(spans: DataFrame) -> DataFrame:
    """Warm and assimilated must show it in their trace. A step's flag is a repair here, not any failure."""
    x = F.transform("trace", lambda e: (e["status"] == "repair").cast("double"))
    rows = spans.filter(F.col("state").isin("warm", "assimilated")).withColumn("_n", F.coalesce(F.size("trace"), F.lit(0)))
    r = F.when(F.col("_n") > 6, F.coalesce(traces.lagged_correlation(x, F.transform("trace", lambda e: e["syntactic_complexity"])), F.lit(0.0))).otherwise(0.0)
    rows = rows.withColumn("_r", F.when(F.col("_n") > 0, r).otherwise(0.0))
    warm, full, has = F.col("state") == "warm", F.col("state") == "assimilated", F.col("_n") > 0
    glucose = F.transform("trace", lambda e: e["glucose_at_event"])
    return _violations(
        rows,
        "earned_label",
        (~has, "missing trace"),
        (has & warm & (F.col("_n") < vocab.TRACE_WARM), "warm requires 3 events"),
        (has & warm & (F.abs("_r") < vocab.COUPLING_EARNED_WARM) & (F.col("_n") > 6), "warm requires coupling 0.3"),
        (has & full & (F.col("flag") == "none"), "assimilated cannot have flag none"),
        (has & full & (F.col("_n") < vocab.TRACE_ASSIMILATED), "assimilated requires 5 events"),
        (has & full & (F.abs("_r") < vocab.COUPLING_EARNED_ASSIMILATED), "assimilated requires coupling 0.55"),
        (has & full & traces.rises(glucose), "glucose increased"),
    )


def earned_flag_violations(spans: DataFrame, eroded: DataFrame | None = None) -> DataFrame:
    """A flag must fit the state, the trace, and where later revisions are known the erosion."""
    rows = spans.filter(F.col("label").startswith("injection."))
    rows = traces.with_signatures(rows, "trace").withColumn("_n", F.coalesce(F.size("trace"), F.lit(0)))
    rows = rows.join(eroded.select("doc_id", "injection_id", "revision_index", "erosion"), ["doc_id", "injection_id", "revision_index"], "left") if eroded is not None else rows.withColumn("erosion", F.lit(None).cast("double"))
    flag, state, r, n = F.col("flag"), F.coalesce("state", F.lit("none")), F.abs("coupling"), F.col("_n")
    medium, high = flag == "medium", flag == "high"
    return _violations(
        rows,
        "earned_ambiguity",
        ((flag == "none") & (state != "cold"), "none requires cold"),
        ((flag == "low") & (state != "warm"), "low requires warm"),
        ((flag == "low") & (n < vocab.TRACE_WARM), "low requires 3 events"),
        ((medium | high) & (state != "assimilated"), F.concat(flag, F.lit(" requires assimilated"))),
        ((medium | high) & (n == 0), F.concat(flag, F.lit(" requires a trace"))),
        (medium & (n > 0) & (r < vocab.COUPLING_EARNED_WARM), "medium requires coupling 0.3"),
        (high & (n > 0) & (r < vocab.COUPLING_EARNED_HIGH), "high requires coupling 0.5"),
        (medium & (F.col("erosion") < vocab.EROSION_MEDIUM), "medium requires erosion 0.1"),
        (high & (F.col("erosion") < vocab.EROSION_HIGH), "high requires erosion 0.25"),
    )


def monotonicity_violations(spans: DataFrame) -> DataFrame:
    """A state never falls from one revision to the next that holds the span."""
    rank = F.array_position(F.array(*map(F.lit, vocab.STATES)), F.col("state"))
    w = Window.partitionBy("doc_id", "injection_id").orderBy("revision_index")
    rows = spans.filter(F.col("label").startswith("injection.") & F.col("state").isNotNull()).withColumns({"_r": rank, "_b": F.lag(rank).over(w), "_s": F.lag("state").over(w)})
    return _violations(rows, "trajectory_monotonicity", (F.col("_b") > F.col("_r"), F.concat("_s", F.lit(" -> "), "state")))


def _leaks(spans: DataFrame, revisions: DataFrame) -> DataFrame:
    """Injections with the patterns of leaked prompts in their content, none where they reach out of the text."""
    rows = spans.filter(F.col("label").startswith("injection.")).join(revisions.select("doc_id", "revision_index", "text"), ["doc_id", "revision_index"])
    found = T.leakage_patterns(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")))
    inside = (F.col("start") >= 0) & (F.col("end") <= F.char_length("text"))
    return rows.select("doc_id", "revision_index", "injection_id", F.when(inside, found).otherwise(F.array().cast("array<string>")).alias("found"))


def leakage_violations(spans: DataFrame, revisions: DataFrame) -> DataFrame:
    return _leaks(spans, revisions).select("doc_id", "revision_index", "injection_id", F.lit("prompt_leakage").alias("error_type"), F.explode("found").alias("message"))


def leakage_totals(spans: DataFrame, revisions: DataFrame) -> DataFrame:
    """Long form (metric, n): spans_checked, spans_with_leakage, and how many spans each pattern met is in. No injections, no rows."""
    count = lambda metric, n: F.struct(metric.alias("metric"), n.cast("long").alias("n"))
    head = F.array(count(F.lit("spans_checked"), F.lit(1)), count(F.lit("spans_with_leakage"), F.size("found") > 0))
    each = F.concat(head, F.transform("found", lambda p: count(F.concat(F.lit("pattern:"), p), F.lit(1))))
    return _leaks(spans, revisions).select(F.inline(each)).groupBy("metric").agg(F.sum("n").alias("n"))


def validate(spans: DataFrame, revisions: DataFrame, leakage: bool = True) -> DataFrame:
    """All violations that a full check reports: each revision's, earned flags, monotonicity, and leakage if asked."""
    parts = [revision_violations(spans, revisions), earned_flag_violations(spans, erosion(spans)), monotonicity_violations(spans)]
    return union_all(parts + ([leakage_violations(spans, revisions)] if leakage else []))


def error_counts(violations: DataFrame, k: int = 20) -> DataFrame:
    return violations.groupBy("error_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type").limit(k)
