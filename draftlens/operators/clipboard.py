"""What copies, pastes and undos of an edit stream do, with the clipboard and the undo stack carried along.

The stream has project, ts, tie (unique), kind (type, copy, paste or undo), text (as it stands before the edit), new_text (of what is typed) and
selection (of what is copied). The clipboard of a paste is the last selection copied before it. The undo stack needs no fold: typing
and pasting push, an undo pops, so the stack's height is a running sum with its own running least taken off where that is below
zero, and what an undo takes back is the last push that reached the height it finds. Both run by time cuts (ordering.py), so a project with a third of
all edits is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlens.functions.text import let
from draftlens.operators.ordering import last_before, running_least, running_sum

#: Pieces of a text that changes are told in: up to the ends of sentences and lines; every character is in one.
PIECES = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"
SAME = "All lines are the same"


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECES), 0)


def place_of(text: Column, part: Column) -> Column:
    """(line, place) of the first occurrence of part, or of the text's beginning where there is none: lines and characters from 0."""
    before = F.substring(text, F.lit(1), F.greatest(F.instr(text, part) - 1, F.lit(0)))
    return place_after(before)


def place_after(before: Column) -> Column:
    """(line, place) of the end of a text."""
    lines = F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit("")))
    return F.concat(F.lit("("), lines, F.lit(","), F.char_length(F.substring_index(before, "\n", -1)), F.lit(")"))


def change(before: Column, after: Column) -> Column:
    """The pieces between the common beginning and end of two texts: "(line,place) X--added", "X--deleted" or "X->Y"."""

    def differ(x: Column, y: Column, most: Column) -> Column:
        """The first place where they differ, if only the place behind the shorter one."""
        return F.filter(F.sequence(F.lit(0), most), lambda i: (i == most) | (F.get(x, i) != F.get(y, i)))[0]

    def bounds(p: Column) -> Column:
        a, b, fewer = p["a"], p["b"], F.least(F.size(p["a"]), F.size(p["b"]))
        back = differ(p["ra"], p["rb"], fewer)
        return let(F.struct(differ(a, b, fewer).alias("start"), back.alias("back"), fewer.alias("fewer")), lambda at: told(a, b, at["start"], F.least(at["back"], at["fewer"] - at["start"])))

    def told(a: Column, b: Column, start: Column, end: Column) -> Column:
        middle = lambda x: F.array_join(F.slice(x, start + 1, F.size(x) - start - end), "")
        kept = F.array_join(F.slice(a, F.lit(1), start), "")
        return let(F.struct(middle(a).alias("gone"), middle(b).alias("new"), F.concat(place_after(kept), F.lit(" ")).alias("at")), lambda m: worded(m["gone"], m["new"], m["at"]))

    def worded(gone: Column, new: Column, at: Column) -> Column:
        return F.when(gone == "", F.concat(at, new, F.lit("--added"))).when(new == "", F.concat(at, gone, F.lit("--deleted"))).otherwise(F.concat(at, gone, F.lit("->"), new))

    both = let(F.struct(pieces(before).alias("a"), pieces(after).alias("b")), lambda p: let(F.struct(p["a"].alias("a"), p["b"].alias("b"), F.reverse(p["a"]).alias("ra"), F.reverse(p["b"]).alias("rb")), bounds))
    return F.when(before == after, SAME).otherwise(both)


def stacked(edits: DataFrame) -> DataFrame:
    """edits with clipboard (of the last copy before), height (of the undo stack after the edit) and undone (tie of the push an undo takes back)."""
    push, pop = F.col("kind").isin("type", "paste"), F.col("kind") == "undo"
    rows = last_before(edits, F.when(F.col("kind") == "copy", F.col("selection")), "clipboard", "project")
    rows = running_sum(rows, F.when(push, 1).when(pop, -1).otherwise(0), "_sum", "project")
    rows = running_least(rows, F.col("_sum"), "_least", "project")
    rows = rows.withColumn("height", F.col("_sum") - F.least(F.col("_least"), F.lit(0)))
    # an undo of an empty stack takes the sum below all before it, and below zero; the least sum changes at undos only
    rows = last_before(rows, F.when(pop, F.col("_least")), "_was", "project")
    # a push reaches its height, an undo finds one more than it leaves
    rows = rows.withColumn("_reached", F.when(pop, F.col("height") + 1).otherwise(F.col("height")))
    rows = last_before(rows, F.when(push, F.col("tie")), "_pushed", "project", "_reached")
    effective = pop & (F.col("_sum") >= F.least(F.coalesce("_was", F.lit(0)), F.lit(0)))
    return rows.withColumn("undone", F.when(effective, F.col("_pushed"))).drop("_sum", "_least", "_was", "_reached", "_pushed")


def tokenised(edits: DataFrame) -> DataFrame:
    """Per edit: project, tie, kind, height, undone and token, what the edit does in words.

    A copy: "(line,place), selection". Typing: the change of the text. A paste: the change that the clipboard makes at the
    text's end, none where nothing was copied before. An undo: the change back of what it takes back, none on an empty stack.
    """
    text = F.coalesce("text", F.lit(""))
    rows = edits.withColumn("text", text)
    # texts stay out of the passes over the order
    state = stacked(rows.select("project", "ts", "tie", "kind", "selection")).select("tie", "clipboard", "height", "undone")
    rows = rows.join(state, "tie")
    typed = F.coalesce("new_text", F.lit(""))
    after = F.when(F.col("kind") == "type", typed).when(F.col("kind") == "paste", F.concat(text, F.coalesce("clipboard", F.lit(""))))
    rows = rows.withColumn("_after", after)
    pushes = rows.filter(F.col("kind").isin("type", "paste")).select(F.col("tie").alias("_push"), F.col("text").alias("_from"), F.col("_after").alias("_to"))
    # most edits take nothing back: they are dealt by their own number, as null would send them all to one task
    dealt = rows.withColumn("_key", F.coalesce("undone", "tie"))
    rows = dealt.join(pushes, (F.col("_key") == F.col("_push")) & F.col("undone").isNotNull(), "left")
    token = F.when(F.col("kind") == "copy", F.concat(place_of(F.col("text"), F.col("selection")), F.lit(", "), F.col("selection")))
    token = token.when(F.col("kind") == "undo", F.when(F.col("undone").isNull(), SAME).otherwise(change(F.col("_to"), F.col("_from"))))
    token = token.otherwise(change(F.col("text"), F.col("_after")))
    return rows.select("project", "tie", "kind", "height", "undone", token.alias("token"))


def bound(log: DataFrame, turns: DataFrame) -> DataFrame:
    """Bind an edit log to turns of conversations as an edit stream: an edit works on the turn that its number picks, if there is one."""
    many = turns.select((F.max("conv_id") + 1).alias("_convs"), (F.max("turn") + 1).alias("_turns"))
    own = turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    picked = log.join(F.broadcast(many)).withColumns({"conv_id": F.pmod("tie", "_convs"), "turn": F.pmod(F.floor(F.col("tie") / F.col("_convs")), F.col("_turns"))})
    rows = picked.join(own, ["conv_id", "turn"]).join(own.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("new_text")), ["conv_id", "turn"], "left")
    kind = F.when(F.col("label") == "click", "copy").when(F.col("label") == "signup", "paste").when(F.col("label").isin("purchase", "error"), "undo").otherwise("type")
    kinds = rows.withColumn("kind", kind)
    last = F.element_at(F.concat(F.array(F.lit("")), pieces(F.col("text"))), -1)
    return kinds.select("project", "ts", "tie", "kind", "text", F.when(F.col("kind") == "type", F.coalesce("new_text", F.lit(""))).alias("new_text"), F.when(F.col("kind") == "copy", last).alias("selection"))
