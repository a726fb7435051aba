"""Event analytics: counts, roll-ups, gaps, transitions, runs and windows of an edit log.

An edit log has project, author, ts, tie (a unique tie-break) and label. Every operator takes and returns DataFrames, and
nothing is collected. What needs a project's order comes from ordering.py, which cuts projects by time, so that a large
project is not one task; windows by project order only tables of groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlens.operators.ordering import broken, exact_median, sequenced
from draftlens.vocab import GAP_BINS


def edit_log(events: DataFrame, projects: int = 5, with_text: bool = False) -> DataFrame:
    """Bind the events table to an edit log: project = user_id % projects + 1. with_text: the event's properties and value as its text."""
    text = F.concat_ws(" ", "props", F.repeat(F.lit("x"), F.floor("value").cast("int")))
    return events.select(
        *([text.alias("text")] if with_text else []),
        (F.col("user_id") % projects + 1).cast("int").alias("project"),
        F.col("user_id").alias("author"),
        F.col("ts"),
        F.col("event_id").alias("tie"),
        F.col("event_type").alias("label"),
        F.col("value"),
    )


def by_project() -> Window:
    return Window.partitionBy("project").orderBy("ts", "tie")


def minutes(later: Column, earlier: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(60_000_000.0)


# counts


def label_counts(log: DataFrame, *keys: str) -> DataFrame:
    return log.groupBy(*keys, "label").agg(F.count("*").alias("n"))


def dense_label_counts(log: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each label of the vocabulary, null where it never occurs."""
    return labels.join(label_counts(log), "label", "left").select("label", "pos", "n")


def label_shares(log: DataFrame, *keys: str) -> DataFrame:
    """Counts, natural logarithms and percentages of each label within keys."""
    n = label_counts(log, *keys)
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return n.select(*keys, "label", "n", F.round(F.log("n"), 6).alias("log_n"), F.round(100.0 * F.col("n") / total, 6).alias("pct"))


def activity(log: DataFrame, grain: str, start: str, end: str, by: str | None = None, closed: bool = False) -> DataFrame:
    """Counts in every bucket of grain (day, week, month) from start to end, zero where nothing happened.

    Half-open, or closed at the end if asked. With by: one row for each bucket and key seen, null keys as "null".
    """
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    inside = (F.col("ts") >= lo) & ((F.col("ts") <= hi) if closed else (F.col("ts") < hi))
    bucket = F.date_trunc(grain, F.col("ts")).cast("date").alias("bucket")
    seen = log.filter(inside)
    if by is not None:
        return seen.groupBy(bucket, F.coalesce(F.col(by).cast("string"), F.lit("null")).alias("key")).agg(F.count("*").alias("n"))
    days = log.sparkSession.range(1).select(F.explode(F.sequence(F.date_trunc(grain, lo).cast("date"), F.date_sub(hi.cast("date"), 0 if closed else 1), F.expr(f"interval 1 {grain}"))).alias("bucket"))
    counts = seen.groupBy(bucket).agg(F.count("*").alias("n"))
    return days.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top_breakdown(log: DataFrame, key: str, by: str, k: int = 5) -> DataFrame:
    """The k most active keys (ties to the smaller) and each one's counts by another column, in one grouped plan."""
    pairs = log.groupBy(key, by).agg(F.count("*").alias("n"))
    top = pairs.groupBy(key).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), key).limit(k)
    return pairs.join(F.broadcast(top), key).select(key, by, "n", "total")  # top has k rows


def breakdown_map(log: DataFrame, key: str, by: str) -> DataFrame:
    """One row for each key with a map from by ("null" for null) to its count, and the map's total."""
    n = log.groupBy(key, F.coalesce(F.col(by).cast("string"), F.lit("null")).alias("k")).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("k", "n")))
    return n.groupBy(key).agg(entries.alias("e"), F.sum("n").alias("total")).select(key, F.map_from_entries("e").alias("counts"), "total")


def rollup_counts(log: DataFrame) -> DataFrame:
    """Counts by project and label, by project, and in all, in one pass."""
    return log.rollup("project", "label").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level")).select("project", "label", "n", "level")


def stacked_series(log: DataFrame, labels: Sequence[str], grain: str = "day") -> DataFrame:
    """Buckets by labels, zero filled: the matrix behind a stacked chart."""
    out = log.groupBy(F.date_trunc(grain, "ts").cast("date").alias("bucket")).pivot("label", list(labels)).agg(F.count(F.lit(1)))
    return out.na.fill(0)


# gaps


def gaps(log: DataFrame, *keys: str) -> DataFrame:
    """Minutes since the key's last edit; rows without one are left out."""
    w = Window.partitionBy(*keys).orderBy("ts", "tie")
    return log.withColumn("gap", minutes(F.col("ts"), F.lag("ts").over(w))).filter("gap is not null")


def gap_stats(log: DataFrame, *keys: str) -> DataFrame:
    g = gaps(log, *keys)
    stats = g.agg(
        F.count("gap").alias("n"),
        F.round(F.min("gap"), 6).alias("min_gap"),
        F.round(F.max("gap"), 6).alias("max_gap"),
        F.round(F.avg("gap"), 6).alias("mean_gap"),
        F.round(F.stddev_pop("gap"), 6).alias("std_gap"),
    )
    middle = exact_median(g, F.col("gap"), "m").select(F.round("m", 6).alias("median_gap"))
    return stats.join(middle, how="cross").select("n", "min_gap", "max_gap", "mean_gap", "median_gap", "std_gap")  # one row by one row


def bin_of(gap: Column, ends: Sequence[float] = GAP_BINS) -> Column:
    """Number of the half-open bin: the first whose upper end lies above the gap."""
    out = F.lit(len(ends))
    for k in range(len(ends) - 1, -1, -1):
        out = F.when(gap < float(ends[k]), F.lit(k)).otherwise(out)
    return out


def gap_histogram(log: DataFrame, *keys: str, ends: Sequence[float] = GAP_BINS) -> DataFrame:
    """Counts in every bin, empty ones too."""
    n = gaps(log, *keys).groupBy(bin_of(F.col("gap"), ends).alias("bin")).agg(F.count("*").alias("n"))
    bins = log.sparkSession.range(len(ends) + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def drop_percent(histogram: DataFrame) -> DataFrame:
    """Percent by which each bin falls short of the one before (a histogram has a handful of rows)."""
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    nxt = F.lead("n").over(w)
    return histogram.select("bin", "n", F.round(100.0 * (1 - F.try_divide(nxt, F.col("n"))), 6).alias("drop_pct")).filter("drop_pct is not null")


# transitions and runs


def transitions(log: DataFrame, *keys: str, part: tuple[int, int] | None = None) -> DataFrame:
    """Label pairs of consecutive edits of a project, equal pairs dropped: n, and the share of the first label's pairs.

    keys: report within these columns (project, or none to pool). part: (from, to), in thirds of a project's edits by
    whole division; the last third takes the rest.
    """
    rows = sequenced(log, "project")
    nxt = rows.withColumn("nxt", F.col("nxt.label"))
    if part is not None:
        third = F.floor(F.col("total") / 3)
        nxt = nxt.filter(F.col("place") >= part[0] * third)
        if part[1] < 3:
            nxt = nxt.filter(F.col("place") < part[1] * third)
    pairs = nxt.filter("nxt is not null and nxt <> label").groupBy(*keys, F.col("label").alias("cur"), "nxt").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys, "cur"))
    return pairs.withColumn("prob", F.round(F.col("n") / total, 6))


def top_next(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """The likeliest next label of each label; ties go to the one that comes first in order (label, pos)."""
    w = Window.partitionBy("cur").orderBy(F.desc("n"), "pos")
    return pairs.join(F.broadcast(order), pairs["nxt"] == order["label"]).withColumn("r", F.row_number().over(w)).filter("r = 1").select("cur", "nxt", "n", "prob")


def transition_matrix(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Probabilities as a table with a column for each next label, zero where there is none."""
    return pairs.groupBy("cur").pivot("nxt", list(labels)).agg(F.first("prob")).na.fill(0.0)


def _runs(log: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    rows = log.filter(~F.col("label").isin(*skip)) if skip else log
    at = lambda side: F.col(f"{side}.label" if side else "label")
    rows = broken(rows, lambda before, after: F.when(~at(before).eqNullSafe(at(after)), True), "run", "project")
    return rows.groupBy("project", "run").agg(
        F.first("label").alias("label"),
        F.min("place").cast("int").alias("first"),
        F.max("place").cast("int").alias("last"),
        F.count("*").alias("length"),
        F.first("total").alias("total"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
    )


def runs(log: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Runs of equal labels in a project: run, label, first and last place, length."""
    return _runs(log, skip).drop("total", "start_ts", "end_ts")


def run_edges(log: DataFrame, skip: Sequence[str] = ("Artifact", "No Label")) -> DataFrame:
    """Edges between consecutive runs, counted: the links of a flow diagram. A run ends where the next label differs."""
    rows = sequenced(log.filter(~F.col("label").isin(*skip)), "project").filter(F.col("nxt").isNotNull() & (F.col("nxt.label") != F.col("label")))
    return rows.groupBy(F.col("label").alias("source"), F.col("nxt.label").alias("target")).agg(F.count("*").alias("n"))


def _label(side: str) -> Column:
    return F.col(f"{side}.label") if side else F.col("label")


def merge_runs(log: DataFrame, value: str) -> DataFrame:
    """Consecutive edits of one label as one, with the value of the last."""
    changed = lambda before, after: F.when(~_label(before).eqNullSafe(_label(after)), True)
    rows = broken(log, changed, "run", "project")
    return rows.groupBy("project", "run").agg(F.first("label").alias("label"), F.max_by(value, "place").alias(value))


def with_previous_label(log: DataFrame, first: str = "none") -> DataFrame:
    """Each edit with its project's label before it."""
    return sequenced(log, "project").withColumn("previous", F.coalesce("prev.label", F.lit(first))).select(*log.columns, "previous")


def visible_links(links: DataFrame, hidden: Sequence[str]) -> DataFrame:
    """Links of which neither end is hidden."""
    return links.filter(~F.col("source").isin(*hidden) & ~F.col("target").isin(*hidden))


def binary_composition(log: DataFrame, positive: Column) -> DataFrame:
    """Runs of rows that are and aren't positive, as percent of the project."""
    flagged = log.withColumn("label", F.when(positive, "labelled").otherwise("unlabelled"))
    return _runs(flagged).select("project", "run", "label", "length", F.round(100.0 * F.col("length") / F.col("total"), 6).alias("pct"))


# windows over a project's edits


def windowed_labels(log: DataFrame, windows: int = 10) -> DataFrame:
    """Counts of labels in windows of ceil(n / windows) edits of a project; fewer windows than asked may arise."""
    rows = sequenced(log, "project")
    w = F.floor(F.col("place") / F.ceil(F.col("total") / windows)).cast("int")
    return rows.withColumn("win", w).groupBy("project", "label", "win").agg(F.count("*").alias("n"))


def uniform_distance(windowed: DataFrame) -> DataFrame:
    """Mean absolute difference between a label's shares of the project's windows and an even spread: Wasserstein for constant targets."""
    of = F.sum("n").over(Window.partitionBy("project", "label"))
    most = F.max("win").over(Window.partitionBy("project")) + 1  # over a row a label and window; a small project has fewer than asked for
    share = windowed.withColumns({"p": F.col("n") / of, "windows": most})
    # windows without the label have share 0
    even = 1.0 / F.col("windows")
    out = share.groupBy("project", "label", "windows").agg(F.sum(F.abs(F.col("p") - even)).alias("s"), F.count("*").alias("k"))
    return out.select("project", "label", F.round((F.col("s") + (F.col("windows") - F.col("k")) * even) / F.col("windows"), 6).alias("w1"))


def dashboard(log: DataFrame, start: str | Column, end: str | Column, by: str, grain: str = "day", keep: Column | None = None) -> DataFrame:
    """Counts of the edits that keep says, by key and bucket, zero where a key has none: every key seen has all buckets."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    seen = log.filter((F.col("ts") >= lo) & (F.col("ts") < hi))
    seen = seen.filter(keep) if keep is not None else seen
    counts = seen.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("null")).alias("key"), F.date_trunc(grain, F.col("ts")).cast("date").alias("bucket")).agg(F.count("*").alias("n"))
    buckets = F.sequence(F.date_trunc(grain, lo).cast("date"), F.date_sub(hi.cast("date"), 1), F.expr(f"interval 1 {grain}"))
    # a key's counts are one map of a bounded number of buckets, laid over the calendar
    maps = counts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
    return maps.select("key", "m", F.explode(buckets).alias("bucket")).select("key", "bucket", F.coalesce(F.try_element_at("m", F.col("bucket")), F.lit(0)).cast("long").alias("n"))


def present(log: DataFrame, column: str, *without: str) -> DataFrame:
    """Rows that have a value in column, and none of those left out."""
    out = log.filter(F.col(column).isNotNull())
    return out.filter(~F.col(column).isin(*without)) if without else out


def local_index(log: DataFrame, *keys: str) -> DataFrame:
    """Adds index, the place of an edit (from 0) among those of its keys."""
    return sequenced(log, *keys).withColumn("index", F.col("place").cast("long")).drop("place", "total", "prev", "nxt")


def gantt(log: DataFrame) -> DataFrame:
    """One bar for each run of equal labels of a project: its label, first and last time, and edits."""
    return _runs(log).select("project", "run", "label", "start_ts", "end_ts", "length")


def temporal_mean(windowed: DataFrame, windows: int = 10) -> DataFrame:
    """Mean of window middles (0.05, 0.15, ...) weighted by a label's shares, and the share against the label's largest."""
    by = Window.partitionBy("project", "label")
    p = windowed.withColumns({"p": F.col("n") / F.sum("n").over(by), "rel": F.col("n") / F.max("n").over(by)})
    return p.groupBy("project", "label").agg(F.round(F.sum(F.col("p") * ((F.col("win") + 0.5) / windows)), 6).alias("mean_time"), F.round(F.avg("rel"), 6).alias("mean_rel"))


def phased(log: DataFrame, of: int = 3) -> DataFrame:
    """log with phase: which (from 1) of equal slices of its project's edits an edit lies in, the last taking the rest."""
    rows = sequenced(log, "project")
    through = (F.col("place") + 1) * of + F.col("total") - 1
    return rows.select(*log.columns, ((through - through % F.col("total")) / F.col("total")).cast("int").alias("phase"))


def phase(log: DataFrame, k: int, of: int = 3) -> DataFrame:
    """The k-th (from 1) of the slices of phased()."""
    return phased(log, of).filter(F.col("phase") == k).drop("phase")


def page(log: DataFrame, cursor: int, size: int = 200, before: int = 100) -> DataFrame:
    """Rows of a project around a cursor: `size` places from `before` ahead of it, by keyset rather than by offset."""
    first = max(0, cursor - before)
    return sequenced(log, "project").withColumn("place", F.col("place").cast("int")).filter((F.col("place") >= first) & (F.col("place") < first + size))


def find(log: DataFrame, order: Sequence[Column | str], where: Column | None = None, skip: int = 0, limit: int | None = None, users: DataFrame | None = None) -> DataFrame:
    """Rows that meet where, of the authors in users (author) if given, in order; the first `skip` are left out and `limit` returned.

    With a limit the order is a top-k in each partition, so no sort of all rows takes place. Users is a semi-join: an author listed
    twice doubles nothing.
    """
    rows = log.filter(where) if where is not None else log
    rows = rows.join(users.select("author"), "author", "left_semi").select(*log.columns) if users is not None else rows
    rows = rows.orderBy(*order)
    rows = rows.offset(skip) if skip else rows
    return rows.limit(limit) if limit is not None else rows


def last_edit(log: DataFrame) -> DataFrame:
    return log.groupBy("project").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("label", F.struct("ts", "tie")).alias("last_label"))
