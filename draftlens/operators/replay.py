"""Rows for replaying edits and reading annotations: frames with rendered diffs, cards of spans, titles, paragraphs of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlens import vocab
from draftlens.functions import text as T

#: Characters of an event's output that a card shows.
SHOWN = 50


def rendered(ops: Column) -> Column:
    """A diff (op, text) as HTML for replay: line ends are shown, white space alone is kept, each operation has its colour."""

    def one(o: Column) -> Column:
        t = F.replace(T.escape_html(o["text"]), F.lit("<br>"), F.lit("&para;<br>"))
        t = F.when(t.rlike(r"(?U)\A\s+\z"), F.replace(t, F.lit(" "), F.lit("&nbsp;"))).otherwise(t)
        out = F.when(o["op"] == 0, F.concat(F.lit("<span>"), t, F.lit("</span>")))
        for op, (tag, colour) in vocab.REPLAY_MARKS.items():
            out = out.when(o["op"] == op, F.concat(F.lit(f'<{tag} style="background:{colour};">'), t, F.lit(f"</{tag}>")))
        return out.otherwise("")

    return F.array_join(F.transform(ops, one), "")


def frames(edits: DataFrame) -> DataFrame:
    """edits (..., ops array of op, text) with their diff as HTML in place of the operations; other columns stay."""
    return edits.withColumn("diff_html", rendered(F.col("ops"))).drop("ops")


def cards(spans: DataFrame) -> DataFrame:
    """A row a span as a reader sees it: state and level or unknown, repairs in its trace, glucose at the end, events in short."""
    last = F.try_element_at("trace", F.lit(-1))["glucose_at_event"]
    out = F.coalesce("trace", F.array().cast(spans.schema["trace"].dataType))
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown")).alias(c)
    # no glucose and none left are shown alike
    return spans.select("doc_id", "revision_index", "injection_id", "start", "end", unknown("state"), unknown("level"), unknown("label"), F.size(F.filter(out, lambda e: e["status"] == "repair")).alias("repairs"), F.when(last != 0, F.round(last, 3)).alias("final_glucose"), F.size(out).alias("n_events"))


def shortened(text: Column, most: int = SHOWN) -> Column:
    """An event's output as a card shows it: all of it, or its beginning and three points."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def titles(log: DataFrame) -> DataFrame:
    """Each project with its title, "Project n" in their order. One row a project, so one partition holds them."""
    seen = log.select("project").filter("project is not null").distinct()
    n = F.row_number().over(Window.orderBy("project"))
    return seen.select("project", F.concat(F.lit("Project "), n.cast("string")).alias("title"))


def paragraph_ranges(docs: DataFrame) -> DataFrame:
    """First and last line (from 1) of every paragraph of a text: doc_id, paragraph, first_line, last_line."""
    lines = docs.select("doc_id", F.posexplode(T.paragraph_numbers(F.col("text"))).alias("line", "paragraph"))
    return lines.filter("paragraph > 0").groupBy("doc_id", "paragraph").agg((F.min("line") + 1).alias("first_line"), (F.max("line") + 1).alias("last_line"))


def paragraph_of(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """lines (doc_id, line) with the first paragraph whose range holds the line, null where none does."""
    held = F.col("line").between(F.col("r.first_line"), F.col("r.last_line"))
    both = lines.alias("l").join(ranges.alias("r"), (F.col("l.doc_id") == F.col("r.doc_id")) & held, "left")
    first = F.min(F.when(F.col("r.paragraph").isNotNull(), F.struct("r.paragraph", "r.first_line", "r.last_line")))
    return both.groupBy("l.doc_id", "l.line").agg(first.alias("p")).select("doc_id", "line", "p.paragraph", "p.first_line", "p.last_line")
