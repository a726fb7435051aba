"""Sessions of an edit log: a long gap, a change of subject or of label ends one.

The rule looks one edit back only, so it is a break flag and a running sum (cut by time, see ordering.py), not a stateful
fold. With strict, sessions
are reported as the notebooks behind them did: a session closed by a gap or a label change counts only if it is longer
than the least duration, one closed by dissimilarity always counts, the last open session of a project never does, and the
label list leaves out the first edit of every session but the project's first. Without strict all sessions and labels count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlens.operators.events import minutes
from draftlens.operators.ordering import broken, exact_median, running_sum, sequenced
from draftlens.session import materialize
from draftlens.vocab import SESSION_COSINE, SESSION_GAP_MINUTES


def mark_sessions(log: DataFrame, gap: float = SESSION_GAP_MINUTES, label_breaks: bool = False, similarity: str | None = None, least_similarity: float = SESSION_COSINE) -> DataFrame:
    """log with place, session (from 0), and why a session begins here and with the next edit: cause, next_cause.

    A cause is gap, label, similarity or null. similarity: a column of each edit's likeness to the one before.
    """
    def cause(before: str, after: str) -> Column:
        at = lambda side, c: F.col(f"{side}.{c}") if side else F.col(c)
        out = F.when(minutes(at(after, "ts"), at(before, "ts")) > gap, "gap")
        if label_breaks:
            out = out.when(~at(after, "label").eqNullSafe(at(before, "label")), "label")
        if similarity is not None:
            out = out.when(at(after, similarity) < least_similarity, "similarity")
        return out

    rows = broken(log, cause, "session", "project", carry=("label", *([similarity] if similarity else [])))
    return rows.withColumns({"cause": F.when(F.col("prev").isNotNull(), cause("prev", "")), "next_cause": F.when(F.col("nxt").isNotNull(), cause("", "nxt"))})


def sessions(marked: DataFrame, least_minutes: float = 1.0, strict: bool = False) -> DataFrame:
    """One row a session: project, session, start, end, minutes, n, label_list, label (of its first edit), closed_by."""
    order = F.struct("place", "label", "session")
    out = marked.groupBy("project", "session").agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(order)).alias("_l"),
        F.max_by("next_cause", "place").alias("closed_by"),
    )
    labels = F.transform("_l", lambda x: x["label"])
    out = out.withColumns({"label": labels[0], "label_list": F.when(F.col("session") == 0, labels).otherwise(F.slice(labels, 2, F.size(labels))) if strict else labels, "minutes": minutes(F.col("end_ts"), F.col("start_ts"))})
    if strict:
        out = out.filter((F.col("closed_by") == "similarity") | (F.col("closed_by").isNotNull() & (F.col("minutes") > least_minutes)))
        out = materialize(out.drop("_l"), "sessions")  # read twice below
        out = running_sum(out, F.lit(1), "index", "project", ts="start_ts", tie="session").withColumn("index", (F.col("index") - 1).cast("int"))
    return out.drop("_l")


def duration_stats(found: DataFrame, *keys: str) -> DataFrame:
    """Mean, sample variance and deviation (zero for one session), median, extremes and number of durations."""
    found = materialize(found.select(*keys, "minutes"), "durations")
    d = F.col("minutes")
    r = lambda c, name: F.round(c, 6).alias(name)
    stats = found.groupBy(*keys).agg(
        F.count("*").alias("n"),
        r(F.avg(d), "mean_minutes"),
        r(F.coalesce(F.var_samp(d), F.lit(0.0)), "var_minutes"),
        r(F.coalesce(F.stddev_samp(d), F.lit(0.0)), "sd_minutes"),
        r(F.min(d), "min_minutes"),
        r(F.max(d), "max_minutes"),
    )
    middle = exact_median(found, d, "_m", *keys).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = stats.join(middle, same, "left") if keys else stats.join(middle, how="cross")
    return both.select(*keys, "n", "mean_minutes", "var_minutes", "sd_minutes", r("_m", "median_minutes"), "min_minutes", "max_minutes")


def duration_classes(found: DataFrame) -> DataFrame:
    """Sessions by class of duration: 0, under 1, under 5 minutes, longer."""
    d = F.col("minutes")
    kind = F.when(d == 0, "zero").when(d < 1, "under_1").when(d < 5, "under_5").otherwise("longer")
    return found.groupBy("project", kind.alias("duration_class")).agg(F.count("*").alias("n"))


def time_per_label(log: DataFrame, cap: float = 5.0, *keys: str, within: tuple[str, ...] = ("project",)) -> DataFrame:
    """Minutes and edits of each label: an edit lasts until the next within the same project, and not at all if that is over cap minutes away."""
    rows = sequenced(log, *within)
    lasting = minutes(F.col("nxt.ts"), F.col("ts"))
    rows = rows.withColumn("m", F.when(lasting <= cap, lasting).otherwise(0.0))
    return rows.groupBy(*keys, "label").agg(F.round(F.sum("m"), 6).alias("minutes"), F.count("*").alias("n"))


def with_shares(times: DataFrame, *keys: str) -> DataFrame:
    """Adds each label's percentage of the minutes within keys."""
    total = F.sum("minutes").over(Window.partitionBy(*(keys or (F.lit(0),))))
    return times.withColumn("pct", F.round(100.0 * F.try_divide(F.col("minutes"), total), 6))


def linear_fit(rows: DataFrame, y: Column, x: Column, *keys: str) -> DataFrame:
    """Least-squares slope, intercept and R2, null where x does not vary."""
    f = lambda c, name: F.round(c, 6).alias(name)
    flat = F.max(x) == F.min(x)
    guard = lambda c: F.when(flat, F.lit(None)).otherwise(c)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), f(guard(F.regr_slope(y, x)), "slope"), f(guard(F.regr_intercept(y, x)), "intercept"), f(guard(F.regr_r2(y, x)), "r2"))


def cumulative_starts(found: DataFrame) -> DataFrame:
    """Sessions laid end to end: where each begins, in minutes."""
    found = materialize(found, "sessions")
    out = running_sum(found, F.col("minutes"), "begins", "project", ts="start_ts", tie="session")
    return out.withColumn("begins", F.col("begins") - F.col("minutes"))
