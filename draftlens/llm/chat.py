"""Preference formatting of conversation pairs, in DataFrame functions alone.

A pair is a chosen and a rejected conversation. Their longest common turn prefix (equal role and text, turn by turn) is
rendered once, as the prompt; what follows in each is a completion, with a mask that trains on the assistant's words and
end marks and on nothing else. A mask is a list of runs "length:flag", in characters, whose lengths sum to the text's.

Edge cases: a null role or text is the empty string; turns are ordered by turn, role and text, nulls first, and repeated
rows are repeated turns; a conversation without a partner makes a pair with an empty other side; ids of any size and sign pair alike;
where one conversation begins the other, the shorter one's completion is empty; equal conversations have empty completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlens.session import fresh

TRAINED_ROLE = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column, role: str = TRAINED_ROLE) -> Column:
    def runs(t: Column) -> Column:
        head, body = F.char_length(_head(t)), F.char_length(_body(t))
        return F.when(t["role"] == role, F.concat(head, F.lit(":0,"), body, F.lit(":1"))).otherwise(F.concat(head + body, F.lit(":0")))

    return F.array_join(F.transform(turns, runs), ",")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal leading turns."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first == 0, n).otherwise(first - 1).cast("int")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, turns in order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = turns.select("conv_id", F.struct("turn", text("role").alias("role"), text("text").alias("text")).alias("t"))
    listed = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected): pair_id, chosen_id, rejected_id, chosen, rejected.

    Each conversation is in one pair, so the pairs grow with the conversations and no key gathers more than two.
    """
    conv = conversations(turns.filter(F.col("conv_id").isNotNull())).withColumn("pair_id", F.shiftright(F.col("conv_id").cast("long"), 1))
    side = F.pmod("conv_id", F.lit(2))
    pick = lambda k, c: F.max(F.when(side == k, F.col(c)))
    paired = conv.groupBy("pair_id").agg(pick(0, "conv_id").alias("chosen_id"), pick(1, "conv_id").alias("rejected_id"), pick(0, "turns").alias("chosen"), pick(1, "turns").alias("rejected"))
    empty = F.array().cast("array<struct<role:string,text:string>>")
    return paired.withColumns({c: F.coalesce(c, empty) for c in ("chosen", "rejected")})


def format_preferences(pairs: DataFrame, role: str = TRAINED_ROLE) -> DataFrame:
    """pairs (pair_id, chosen, rejected, ...) -> its other columns, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask."""
    n, p, c, r = fresh(pairs, "n", "p", "c", "r")
    counted = pairs.withColumn(n, common_prefix(F.col("chosen"), F.col("rejected")))
    rest = lambda side: F.slice(F.col(side), F.col(n) + 1, F.greatest(F.size(side) - F.col(n), F.lit(0)))
    cut = counted.withColumns({p: F.slice("chosen", F.lit(1), F.col(n)), c: rest("chosen"), r: rest("rejected")})
    other = [x for x in pairs.columns if x not in ("chosen", "rejected")]
    return cut.select(
        *other,
        F.col(n).cast("long").alias("n_prompt_turns"),
        render(F.col(p)).alias("prompt"),
        render(F.col(c)).alias("chosen"),
        mask(F.col(c), role).alias("chosen_mask"),
        render(F.col(r)).alias("rejected"),
        mask(F.col(r), role).alias("rejected_mask"),
    )
