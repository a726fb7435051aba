"""Evaluation: classification reports, agreement, ranking, class weights, disaggregated rates, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlens.functions import ids


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(rows: DataFrame, true: str, pred: str, dense: bool = False, most_labels: int = 4096) -> DataFrame:
    """Counts of (true, pred); dense: all pairs of labels that occur as true, and none else; more than most_labels of them raise."""
    n = rows.groupBy(F.col(true).cast("string").alias("true"), F.col(pred).cast("string").alias("pred")).agg(F.count("*").alias("n"))
    if not dense:
        return n
    labels = n.select("true").distinct()
    if labels.limit(most_labels + 1).count() > most_labels:
        raise ValueError(f"a dense matrix holds {most_labels} labels at most")
    # the result is a row a pair of labels; one row of at most most_labels of them is sent
    grid = labels.join(F.broadcast(labels.groupBy().agg(F.collect_set("true").alias("p"))), how="cross").select("true", F.explode("p").alias("pred"))
    return grid.join(n, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 (zero where undefined, four digits) and support of each label on either side."""
    hit = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)
    t = matrix.select(F.col("true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed"), hit.cast("long").alias("hit"))
    p = matrix.select(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hit"))
    sums = t.unionByName(p).groupBy("label").agg(*(F.sum(c).alias(c) for c in ("support", "claimed", "hit")))
    return sums.select(
        "label",
        "support",
        F.round(_share(F.col("hit"), F.col("claimed")), 4).alias("precision"),
        F.round(_share(F.col("hit"), F.col("support")), 4).alias("recall"),
        F.round(_share(2 * F.col("hit"), F.col("claimed") + F.col("support")), 4).alias("f1"),
    )


def summary(matrix: DataFrame) -> DataFrame:
    """Long form (metric, value): accuracy, macro_f1, micro_f1 (which is accuracy for one label a row)."""
    hit = F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0))
    acc = matrix.agg(F.round(_share(hit, F.sum("n")), 4).alias("v")).select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col("v").alias("value")) for m in ("accuracy", "micro_f1")))).alias("x")).select("x.*")
    hits = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)
    sides = matrix.select(F.col("true").alias("label"), "n", hits.alias("h")).unionByName(matrix.select(F.col("pred").alias("label"), "n", F.lit(0).alias("h")))
    f1 = sides.groupBy("label").agg(_share(2 * F.sum("h"), F.sum("n")).alias("f1"))
    return acc.unionByName(f1.agg(F.round(F.avg("f1"), 4).alias("value")).select(F.lit("macro_f1").alias("metric"), "value"))


def binary_f1(rows: DataFrame, true: Column, pred: Column, *keys: str) -> DataFrame:
    count = lambda c: F.sum(c.cast("long"))
    return rows.groupBy(*keys).agg(count(true & pred).alias("tp"), count(~true & pred).alias("fp"), count(true & ~pred).alias("fn")).withColumn("f1", F.round(_share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


def auc(rows: DataFrame, positive: Column, score: Column, *keys: str) -> DataFrame:
    """Area under the ROC curve with ties at their middle rank; zero where a class is missing.

    Scores are counted first, so the ordered window sees distinct scores, not rows, and the rank of a score is a running count.
    """
    n = rows.select(*keys, score.alias("s"), positive.cast("long").alias("y")).groupBy(*keys, "s").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    below = F.sum("n").over(Window.partitionBy(*(keys or (F.lit(0),))).orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    ranked = n.withColumn("mid", F.coalesce(below, F.lit(0)) + (F.col("n") + 1) / 2.0)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("mid") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    value = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, (F.col("p") * F.col("q")).cast("double"))
    return sums.select(*keys, F.round(F.coalesce(value, F.lit(0.0)), 6).alias("auc"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two columns of labels; zero where chance agreement is complete."""
    n = rows.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").cast("double").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    margins = n.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("x")).join(n.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("y")), "k")
    chance = margins.agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("c"))
    both = total.join(chance, how="cross")  # one row by one row
    p0, pe = F.col("same") / F.col("t"), F.col("c") / (F.col("t") * F.col("t"))
    return both.select(F.round(p0, 6).alias("p0"), F.round(pe, 6).alias("pe"), F.round(F.when(pe >= 1, 0.0).otherwise((p0 - pe) / (1 - pe)), 6).alias("kappa"))


def class_weights(rows: DataFrame, label: str, labels: DataFrame) -> DataFrame:
    """Balanced weights n / (k * count) with one row added to each class, scaled to sum to one."""
    n = labels.join(rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("c")), "label", "left").select("label", (F.coalesce("c", F.lit(0)) + 1).alias("c"))
    all_ = Window.partitionBy(F.lit(0))  # a row a class
    w = n.withColumn("w", F.sum("c").over(all_) / (F.count("*").over(all_) * F.col("c")))
    return w.select("label", F.round(F.col("w") / F.sum("w").over(all_), 6).alias("weight"))


def harm(spans: DataFrame, predicted: DataFrame) -> DataFrame:
    """Rates (metric, value): false positives by first anomaly label of revisions without injections; sensitivity of injections by level and state.

    spans: doc_id, revision_index, ord, label, level, state. predicted: doc_id, revision_index, hit.
    """
    per = spans.groupBy("doc_id", "revision_index").agg(
        F.max(F.col("label").startswith("injection.")).alias("has"),
        F.min(F.when(F.col("label").startswith("anomaly."), F.struct("ord", "label")))["label"].alias("anomaly"),
    )
    hit = F.avg(F.col("hit").cast("double"))
    fpr = per.filter("anomaly is not null and not has").join(predicted, ["doc_id", "revision_index"]).groupBy(F.concat(F.lit("fpr_"), F.replace("anomaly", F.lit("."), F.lit("_"))).alias("metric")).agg(F.round(hit, 6).alias("value"))
    inj = spans.filter(F.col("label").startswith("injection.")).join(predicted, ["doc_id", "revision_index"])
    kinds = F.array(F.concat(F.lit("sensitivity_level_"), F.coalesce("level", F.lit("unknown"))), F.concat(F.lit("sensitivity_state_"), F.coalesce("state", F.lit("unknown"))))
    return fpr.unionByName(inj.select(F.explode(kinds).alias("metric"), "hit").groupBy("metric").agg(F.round(hit, 6).alias("value")))


def evaluation(gold: DataFrame, predictions: DataFrame, keys: list[str], cut: float = 0.6) -> DataFrame:
    """F1 of coupling above cut (signs count), over the keys that both sides hold, and how many those are."""
    both = gold.join(predictions, keys)
    out = binary_f1(both, F.col("resource_coupling") > cut, F.col("predicted_coupling") > cut)
    return out.join(both.agg(F.count("*").alias("n_keys")), how="cross")  # one row by one row


def evaluation_report(gold: DataFrame, predictions: DataFrame, keys: list[str], cut: float = 0.6) -> DataFrame:
    """One row over the keys that both sides hold: F1 of coupling above cut (signs count), IoU of all spans pooled, how many.

    gold has resource_coupling, span_start_char and span_end_char; predictions predicted_coupling, pred_start and pred_end,
    whose nulls count as zero.
    """
    from draftlens.operators import spans

    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = gold.join(predictions, keys)
    f1 = binary_f1(both, zero("resource_coupling") > cut, zero("predicted_coupling") > cut).select(F.round("f1", 4).alias("f1"))
    side = lambda a, b: both.select(zero(a).cast("int").alias("start"), zero(b).cast("int").alias("end"))
    over = spans.iou(side("pred_start", "pred_end"), side("span_start_char", "span_end_char")).select(F.round("iou", 4).alias("span_iou"))
    return f1.join(over, how="cross").join(both.agg(F.count("*").alias("n")), how="cross")  # one row each


# sampling and selection


def sample(rows: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    """k rows, the first by a hash of key and seed: a task run again draws the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in keys))
    return rows.orderBy(F.sha2(text.cast("binary"), 256)).limit(k)


def weighted_choice(rows: DataFrame, weights: dict[str, float], seed: int, *keys: str) -> DataFrame:
    """Adds choice: by the place of a hashed uniform number among the cumulative weights."""
    names, u = list(weights), ids.hash_uniform(seed, *(F.col(c) for c in keys))
    ends = [sum(list(weights.values())[: k + 1]) / sum(weights.values()) for k in range(len(names))]
    out = F.lit(names[-1])
    for name, end in zip(reversed(names[:-1]), reversed(ends[:-1]), strict=True):
        out = F.when(u < end, name).otherwise(out)
    return rows.withColumn("choice", out)


def select_spans(candidates: DataFrame, most: int, seed: int, priority: str = "priority") -> DataFrame:
    """Of each document's candidates (doc_id, start, end, priority) up to `most` that do not overlap, drawn greedily: doc_id, place (from 0), start, end.

    The highest priority is first; equals are in the order of a hash of seed, document and bounds, so a task run again draws the same. Empty
    candidates take no part, equal ones count once. A document's candidates meet in one row, as its text does; all else is partial aggregation.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in ("doc_id", "start", "end")))
    order = F.struct((-F.col(priority)).alias("p"), F.sha2(text.cast("binary"), 256).alias("h"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    queue = F.array_sort(F.collect_set(order))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def draw(kept: Column, x: Column) -> Column:
        free = (F.size(kept) < most) & ~F.exists(kept, lambda k: (x["start"] < k["end"]) & (k["start"] < x["end"]))
        return F.when(free, F.array_append(kept, F.struct(x["start"].alias("start"), x["end"].alias("end")))).otherwise(kept)

    drawn = candidates.filter(F.col("end") > F.col("start")).groupBy("doc_id").agg(queue.alias("q")).select("doc_id", F.aggregate("q", none, draw).alias("kept"))
    return drawn.select("doc_id", F.posexplode("kept").alias("place", "x")).select("doc_id", "place", "x.start", "x.end")


def rotation(rows: DataFrame, place: Column, levels: tuple[str, ...], states: tuple[str, ...]) -> DataFrame:
    """Level by place modulo three, state by place over three modulo three."""
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))
    return rows.withColumns({"level": pick(levels, place), "state": pick(states, F.floor(place / len(levels)))})


def diverse(rows: DataFrame, group: str, score: str, key: str, cap: int, k: int) -> DataFrame:
    """The best k, with at most cap from a group: rounds by rank within groups."""
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).orderBy("_r", F.desc(score), key).limit(k).drop("_r")


def select_models(rows: DataFrame, k: int, cap: int, cost_limit: float | None = None, budget: bool = True, second_tier: int = 6) -> DataFrame:
    """Choose k of rows (key, vendor, priority, score, cost), at most cap of a vendor, in three phases: phase, then order.

    1: the best affordable of each vendor, by priority. 2: of the first `second_tier` vendors their next affordable ones,
    the best left out whatever it costs. 3: what is cheapest of the rest, whatever the limit.
    """
    vendors = rows.groupBy("vendor").agg(F.min("priority").alias("_p"))
    place = F.row_number().over(Window.orderBy("_p", "vendor"))  # one row a vendor
    every = rows.join(vendors.withColumn("_v", place), "vendor")
    fits = F.lit(True) if cost_limit is None else F.col("cost") <= cost_limit
    best = Window.partitionBy("vendor").orderBy(F.desc("score"), "key")
    every = every.withColumns({"_i": F.row_number().over(best), "_fits": fits})
    every = every.withColumn("_a", F.sum(F.col("_fits").cast("int")).over(best.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.col("_fits") & (F.col("_a") == 1)
    next_ = F.col("_fits") & ~first & (F.col("_i") > 1) & (F.col("_v") <= second_tier)
    every = every.withColumn("phase", F.when(first, 1).when(next_ & (F.col("_a") <= cap), 2).otherwise(3))
    taken = F.count(F.when(F.col("phase") < 3, 1)).over(Window.partitionBy("vendor"))
    cheap = F.row_number().over(Window.partitionBy("vendor", F.col("phase") == 3).orderBy("cost", F.desc("score"), "key"))
    every = every.withColumns({"_taken": taken, "_c": cheap}).filter((F.col("phase") < 3) | (F.lit(budget) & (F.col("_taken") + F.col("_c") <= cap)))
    order = [F.col("phase"), F.when(F.col("phase") < 3, F.col("_v")), F.when(F.col("phase") < 3, F.col("_i")), "cost", F.desc("score"), "key"]
    return every.orderBy(*order).limit(k).select(*rows.columns, "phase")


def fallbacks(rows: DataFrame, primary: DataFrame, k: int = 3) -> DataFrame:
    """Replacements for one primary (key, vendor, score): its vendor's first, then the nearest score."""
    p = F.broadcast(primary.select(F.col("key").alias("_k"), F.col("vendor").alias("_v"), F.col("score").alias("_s")).limit(1))
    both = rows.join(p, F.col("key") != F.col("_k"))
    return both.orderBy(F.col("vendor") != F.col("_v"), F.abs(F.col("score") - F.col("_s")), "key").limit(k).drop("_k", "_v", "_s")


def disjointness(splits: DataFrame) -> DataFrame:
    """Ids that two splits share, counted for each pair: splits (split, id). Ids are grouped, not joined with each other."""
    per = splits.groupBy("id").agg(F.array_sort(F.collect_set("split")).alias("s")).filter(F.size("s") > 1)  # at most the number of splits
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return per.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n_shared"))


def agreement(annotations: DataFrame, annotators: int, keys: list[str]) -> DataFrame:
    """Keys that every annotator has, with their labels in the annotators' order: annotations (annotator, label, *keys)."""
    per = annotations.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("annotator", "label"))).alias("x"), F.count_distinct("annotator").alias("n"))
    return per.filter(F.col("n") == annotators).select(*keys, F.transform("x", lambda v: v["label"]).alias("labels"))


def knee_point(x: list[float], y: list[float]) -> float | None:
    """Where a convex falling curve bends most: the largest gap between it and its chord. For a report's few points."""
    if len(x) < 3 or max(x) == min(x) or max(y) == min(y):
        return None
    across, down = max(x) - min(x), max(y) - min(y)
    gaps = [(1 - (b - min(y)) / down) - (a - min(x)) / across for a, b in zip(x, y, strict=True)]
    best = max(range(len(gaps)), key=gaps.__getitem__)
    return x[best] if gaps[best] > 0 else None
