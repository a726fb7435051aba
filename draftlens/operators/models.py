"""A catalogue of language models as a table: vendors, scores, prices and the parameters that each takes.

A catalogue has id, name, context_length, prompt_price and completion_price (dollars a token, as text or number) and
supported_parameters (an array). `metrics.select_models` chooses from what `discovered` returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlens import vocab
from draftlens.functions import text as T


def supported(listed: Column, vendor: Column) -> Column:
    """Parameters that a model takes, sorted: those listed that are known, or its vendor's where none is; the first two always."""
    array = lambda names: F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    fallback = array(vocab.MODEL_PARAMETERS_OTHERS)
    for name, extra in vocab.MODEL_PARAMETERS_BY_VENDOR.items():
        fallback = F.when(vendor == name, array(extra)).otherwise(fallback)
    known = F.array_intersect(listed, array(vocab.MODEL_PARAMETERS))
    return F.array_sort(F.array_union(array(vocab.MODEL_PARAMETERS_ALWAYS), F.when(F.size(listed) > 0, known).otherwise(fallback)))


def discovered(catalogue: DataFrame, least_context: int = 4096) -> DataFrame:
    """Models fit for use: id, name, vendor, priority, score, context_length, prices for a million tokens, cost of a thousand, parameters.

    Excluded names and short contexts go. A model without a name has its id, without a context the least one, without a price (or
    with one that is no number) zero. The vendor is the first whose pattern the id meets.
    """
    row = F.col("id")
    listed = F.coalesce("supported_parameters", F.array().cast("array<string>"))
    price = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)) * 1_000_000
    vendor = T.first_pattern(row, {pattern: name for name, pattern in vocab.MODEL_VENDORS.items()}, "other")
    places = F.lit(vocab.MODEL_PRIORITY_OTHERS)
    for k, name in enumerate(vocab.MODEL_VENDORS, 1):
        places = F.when(F.col("vendor") == name, k).otherwise(places)
    kept = catalogue.filter(row.isNotNull())
    for pattern in vocab.MODELS_EXCLUDED:
        kept = kept.filter(~row.rlike("(?i)" + pattern))
    out = kept.select(
        "id",
        F.coalesce("name", "id").alias("name"),
        vendor.alias("vendor"),
        F.coalesce("context_length", F.lit(least_context)).cast("int").alias("context_length"),
        price("prompt_price").alias("prompt_price"),
        price("completion_price").alias("completion_price"),
        T.pattern_score(row, vocab.MODEL_SCORES).cast("int").alias("score"),
        listed.alias("_listed"),
    ).filter(F.col("context_length") >= least_context)
    cost = (F.col("prompt_price") + F.col("completion_price")) / 2000
    return out.withColumns({"priority": places, "cost": cost, "parameters": supported(F.col("_listed"), F.col("vendor"))}).drop("_listed")


def filter_parameters(params: Column, parameters: Column) -> Column:
    """Of a map of settings those whose name is among parameters and whose value is not null."""
    return F.map_filter(params, lambda k, v: v.isNotNull() & F.array_contains(parameters, k))
