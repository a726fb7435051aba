"""Joins whose hot keys are split by plan, not by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that may be broadcast: each has over total / SHARE rows, so there are SHARE at most.
SHARE = 1000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], salt: Column, total: int, count: str = "n", eligible: Column | None = None) -> DataFrame:
    """left with the columns of right, one row a key, that fit it (null where none does).

    `count` in right is how many rows of left have the key, of `total` rows. Keys with more than a SHARE-th of them are
    broadcast; their rows of left, and those that are not eligible for a match, go through the shuffle spread by salt. The
    other keys are never broadcast, whatever size the planner takes them for.
    """
    named = [c for c in right.columns if c not in on and c != count]
    limit = max(1, total // SHARE)
    hot = right.filter(F.col(count) > limit).select(*(F.col(c).alias(f"_hot_{c}") for c in [*on, *named]), F.lit(True).alias("_hot"))
    cold = right.filter(F.col(count) <= limit).select(*(F.col(c).alias(f"_cold_{c}") for c in [*on, *named]))
    may = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    met = left.withColumn("_may", may)
    met = met.join(F.broadcast(hot), F.lit(True) & F.col("_may") & _same(on, "_hot_"), "left")
    met = met.withColumn("_key", F.when(F.col("_hot") | ~F.col("_may"), salt).otherwise(F.col(on[0])))
    rest = (F.col("_key") == F.col(f"_cold_{on[0]}")) & F.col("_hot").isNull() & F.col("_may")
    for c in on[1:]:
        rest &= F.col(c) == F.col(f"_cold_{c}")
    out = met.join(cold.hint("merge"), rest, "left")
    return out.select(*left.columns, *(F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in named))


def _same(on: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for c in on:
        out &= F.col(c) == F.col(f"{prefix}{c}")
    return out
