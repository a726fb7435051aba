"""Neighbours, places and running sums in a long order, without one task for each key.

A key of an edit log (a project) may hold a third of all rows, and a window over it would sort them in one task. Here the
key's rows are cut by time into buckets; windows run within (key, bucket), and what crosses an edge comes from a table with
a row for each bucket (its size, first and last row, and sums), which is small enough to be ordered by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlens.session import materialize

GRAIN = "day"


def _bucketed(rows: DataFrame, ts: str, grain: str | int) -> DataFrame:
    """Cut by a unit of time, or an order in whole numbers by so many."""
    return rows.withColumn("_bucket", F.floor(F.col(ts) / grain) if isinstance(grain, int) else F.date_trunc(grain, F.col(ts)))


def _back(rows: DataFrame, edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """edges joined to rows; both are dealt by key and bucket where the table of edges is not small enough to send."""
    return rows.join(edges, [*keys, "_bucket"])


def sequenced(rows: DataFrame, *keys: str, ts: str = "ts", tie: str = "tie", carry: tuple[str, ...] = ("label",), grain: str | int = GRAIN) -> DataFrame:
    """Adds place (from 0), total (rows of the key), prev and nxt: structs of ts, tie and carry of the rows next to it.

    ts must not be null; (ts, tie) orders a key's rows.
    """
    rows = _bucketed(rows, ts, grain)
    w = Window.partitionBy(*keys, "_bucket").orderBy(ts, tie)
    here = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), *carry)
    order = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"))
    edges = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"), F.min_by(here, order).alias("_f"), F.max_by(here, order).alias("_l"))
    v = Window.partitionBy(*keys).orderBy("_bucket")
    edges = edges.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_n").over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("total"),
        F.lag("_l").over(v).alias("_p"),
        F.lead("_f").over(v).alias("_x"),
    )
    inner = rows.withColumns({"_r": F.row_number().over(w), "_lag": F.lag(here).over(w), "_lead": F.lead(here).over(w)})
    out = _back(inner, edges, keys).withColumns({"place": F.col("_before") + F.col("_r") - 1, "prev": F.coalesce("_lag", "_p"), "nxt": F.coalesce("_lead", "_x")})
    return out.drop("_bucket", "_r", "_lag", "_lead", "_before", "_p", "_x")


def broken(rows: DataFrame, breaks: Callable[[str, str], Column], name: str, *keys: str, ts: str = "ts", tie: str = "tie", carry: tuple[str, ...] = ("label",), grain: str | int = GRAIN) -> DataFrame:
    """sequenced(), and as name the number of breaks up to and including each row, in the same pass over the rows.

    breaks(before, after) is not null where a break lies between two rows; each is "" for the row itself or the name
    of a struct with ts, tie and carry. Within a bucket breaks are counted beside the other windows, between buckets on the
    table of edges.
    """
    rows = _bucketed(rows, ts, grain)
    w = Window.partitionBy(*keys, "_bucket").orderBy(ts, tie)
    here = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), *carry)
    inner = rows.withColumns({"_r": F.row_number().over(w), "_lag": F.lag(here).over(w), "_lead": F.lead(here).over(w)})
    inner = inner.withColumn("_b", F.when(F.col("_lag").isNotNull(), breaks("_lag", "").isNotNull().cast("int")).otherwise(0))
    inner = inner.withColumn("_in", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    edges = inner.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"), F.sum("_b").alias("_s"), F.min_by(here, F.struct(ts, tie)).alias("_f"), F.max_by(here, F.struct(ts, tie)).alias("_l"))
    v = Window.partitionBy(*keys).orderBy("_bucket")
    earlier = v.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumns({"_p": F.lag("_l").over(v), "_x": F.lead("_f").over(v), "total": F.sum("_n").over(Window.partitionBy(*keys))})
    edges = edges.withColumn("_e", F.when(F.col("_p").isNotNull(), breaks("_p", "_f").isNotNull().cast("int")).otherwise(0))
    edges = edges.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_base": F.coalesce(F.sum(F.col("_s") + F.col("_e")).over(earlier), F.lit(0)) + F.col("_e")})
    out = _back(inner, edges.select(*keys, "_bucket", "total", "_p", "_x", "_before", "_base"), keys)
    out = out.withColumns({"place": F.col("_before") + F.col("_r") - 1, "prev": F.coalesce("_lag", "_p"), "nxt": F.coalesce("_lead", "_x"), name: F.col("_base") + F.col("_in")})
    return out.drop("_bucket", "_r", "_lag", "_lead", "_b", "_in", "_p", "_x", "_before", "_base")


def running_sums(rows: DataFrame, values: dict[str, Column], *keys: str, ts: str = "ts", tie: str = "tie", grain: str | int = GRAIN) -> DataFrame:
    """Adds, by name, the sums of values over the key's rows up to and including each, all in one pass."""
    rows = _bucketed(rows, ts, grain).withColumns({f"_v{k}": v for k, v in enumerate(values.values())})
    w = Window.partitionBy(*keys, "_bucket").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    each = range(len(values))
    edges = rows.groupBy(*keys, "_bucket").agg(*(F.sum(f"_v{k}").alias(f"_s{k}") for k in each))
    edges = edges.select(*keys, "_bucket", *(F.coalesce(F.sum(f"_s{k}").over(earlier), F.lit(0)).alias(f"_before{k}") for k in each))
    out = _back(rows.withColumns({f"_in{k}": F.sum(f"_v{k}").over(w) for k in each}), edges, keys)
    out = out.withColumns({name: F.col(f"_before{k}") + F.col(f"_in{k}") for k, name in enumerate(values)})
    return out.drop("_bucket", *(f"{c}{k}" for k in each for c in ("_v", "_in", "_before")))


def running_sum(rows: DataFrame, value: Column, name: str, *keys: str, ts: str = "ts", tie: str = "tie", grain: str | int = GRAIN) -> DataFrame:
    """Adds the sum of value over the key's rows up to and including each."""
    return running_sums(rows, {name: value}, *keys, ts=ts, tie=tie, grain=grain)


def running_least(rows: DataFrame, value: Column, name: str, *keys: str, ts: str = "ts", tie: str = "tie", grain: str | int = GRAIN) -> DataFrame:
    """Adds the least value of the key's rows up to and including each."""
    rows = _bucketed(rows, ts, grain).withColumn("_v", value)
    w = Window.partitionBy(*keys, "_bucket").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    before = F.min("_s").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    edges = rows.groupBy(*keys, "_bucket").agg(F.min("_v").alias("_s")).withColumn("_before", before).drop("_s")
    out = _back(rows.withColumn("_in", F.min("_v").over(w)), edges, keys)
    return out.withColumn(name, F.least("_before", "_in")).drop("_bucket", "_v", "_in", "_before")


def last_before(rows: DataFrame, value: Column, name: str, *keys: str, ts: str = "ts", tie: str = "tie", grain: str | int = GRAIN) -> DataFrame:
    """Adds the last value that is not null of the key's rows before each."""
    rows = _bucketed(rows, ts, grain).withColumn("_v", value)
    w = Window.partitionBy(*keys, "_bucket").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("_s", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    last = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(ts, tie)))
    edges = rows.groupBy(*keys, "_bucket").agg(last.alias("_s")).withColumn("_before", before).drop("_s")
    out = _back(rows.withColumn("_in", F.last("_v", ignorenulls=True).over(w)), edges, keys)
    return out.withColumn(name, F.coalesce("_in", "_before")).drop("_bucket", "_v", "_in", "_before")


def exact_median(rows: DataFrame, value: Column, name: str, *keys: str) -> DataFrame:
    """The median of value (the mean of the middle two) within keys, exact, without all values in one task: (*keys, name); null for no values.

    Distinct values with their counts are dealt by ranges and written; a table with a row for each range and key says which
    ranges hold the middle, and only these are summed up in order.
    """
    counted = rows.select(*keys, value.alias("_v")).filter("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    dealt = materialize(counted.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    whole = Window.partitionBy(*(keys or (F.lit(0),)))  # a row a range and key
    parts = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_s"))
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_s").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_s").over(whole)})
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    holds = (F.col("_before") <= high) & (F.col("_before") + F.col("_s") > low)
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in (*keys, "_part")]
    met = dealt.alias("d").join(parts.filter(holds).alias("p"), same).select(*(F.col(f"d.{k}").alias(k) for k in keys), F.col("d._part").alias("_part"), "_v", "_n", "_before", "_all")
    w = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("_to", F.col("_before") + F.sum("_n").over(w))
    at = lambda rank: F.max(F.when((F.col("_to") - F.col("_n") <= rank) & (rank < F.col("_to")), F.col("_v")))
    return met.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(name))
