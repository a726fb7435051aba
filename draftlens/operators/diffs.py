"""Comparisons that need an alignment: indel ratio, character diffs, token diff spans, tagged diffs, span F1, moved selections. Arrow batches of Python."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlens.functions.alignment import char_diff, clean_up, indel_ratio, locate_many
from draftlens.functions.text import whole_sentence
from draftlens.session import ship_package


def changed_spans(a: str, b: str) -> list[tuple[int, int]]:
    """Ranges of a's words that b changes or drops; an insertion is an empty range."""
    match = difflib.SequenceMatcher(a=a.split(), b=b.split(), autojunk=False)
    return [(s, e) for kind, s, e, _, _ in match.get_opcodes() if kind != "equal"]


def span_scores(predicted: list[tuple[int, int]], gold: list[tuple[int, int]], smooth: float = 1e-12) -> tuple[float, float, float]:
    """Precision, recall and F1, where each prediction takes the first unused gold span that it overlaps."""
    left, hits = list(gold), 0
    for s, e in predicted:
        at = next((k for k, (gs, ge) in enumerate(left) if max(s, gs) < min(e, ge)), None)
        if at is not None:
            del left[at]
            hits += 1
    precision, recall = hits / (len(predicted) + smooth), hits / (len(gold) + smooth)
    return precision, recall, 2 * precision * recall / (precision + recall + smooth)


def span_f1(predicted: list[tuple[int, int]], gold: list[tuple[int, int]], smooth: float = 1e-12) -> float:
    return span_scores(predicted, gold, smooth)[2]


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = zip(batch.column("before").to_pylist(), batch.column("after").to_pylist(), batch.column("generated").to_pylist(), strict=True)
        made = [span_scores(changed_spans(a or "", g or ""), changed_spans(a or "", b or "")) for a, b, g in sides]
        columns = [pa.array([m[k] for m in made], pa.float64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names=["key", "precision", "recall", "f1"])


def score_generated(rows: DataFrame) -> DataFrame:
    """rows (key string, before, after, generated) -> how well the words that generated changes are those that after changes."""
    ship_package(rows.sparkSession)
    return rows.select("key", "before", "after", "generated").mapInArrow(_scores, "key string, precision double, recall double, f1 double")


def tagged(a: str, b: str) -> str:
    """A word diff as <same>, <del> and <add>."""
    x, y = a.split(" "), b.split(" ")
    out = []
    for kind, i, j, k, m in difflib.SequenceMatcher(a=x, b=y, autojunk=False).get_opcodes():
        if kind == "equal":
            out.append(f"<same>{' '.join(x[i:j])}</same>")
            continue
        if j > i:
            out.append(f"<del>{' '.join(x[i:j])}</del>")
        if m > k:
            out.append(f"<add>{' '.join(y[k:m])}</add>")
    return "".join(out)


def word_changes(ops: list[tuple[int, str]], line: int = 0) -> list[str]:
    """What a diff does to words: "(line,place), old->new", "...---added" or "...---deleted".

    ops: (0 kept, 1 added, -1 removed; text). A change reaches to the white space that it leaves as it is on either side;
    place counts characters of the new text from the line's beginning. Other operations change no text and are passed over.
    """
    out: list[str] = []
    old, new, changed, place, start = "", "", False, 0, (line, 0)

    def close() -> None:
        if changed:
            at = f"({start[0]},{start[1]}), "
            out.append(at + (f"{new}---added" if not old.strip() else f"{old}---deleted" if not new.strip() else f"{old}->{new}"))

    for op, text in ops:
        if op not in (-1, 0, 1):
            continue
        for c in text or "":
            if op == 0 and c.isspace():
                close()
                old, new, changed = "", "", False
                line, place = (line + 1, 0) if c == "\n" else (line, place + 1)
                start = (line, place)
                continue
            changed |= op != 0
            old += c if op < 1 else ""
            new += c if op > -1 else ""
            if op > -1:
                line, place = (line + 1, 0) if c == "\n" else (line, place + 1)
    close()
    return out


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("ops").to_pylist(), batch.column("line").to_pylist(), strict=True)
        made = [word_changes([(o["op"], o["text"]) for o in ops or []], line or 0) for ops, line in rows]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(made, pa.list_(pa.string()))], names=["key", "changes"])


def changes(edits: DataFrame) -> DataFrame:
    """edits (key string, line int, ops array of op, text) -> changes of words."""
    ship_package(edits.sparkSession)
    return edits.select("key", "line", "ops").mapInArrow(_changes, "key string, changes array<string>")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ratio, spans, tags = [], [], []
        for a, b in zip(batch.column("before").to_pylist(), batch.column("after").to_pylist(), strict=True):
            a, b = a or "", b or ""
            ratio.append(indel_ratio(a, b))
            spans.append([{"start": s, "end": e} for s, e in changed_spans(a, b)])
            tags.append(tagged(a, b))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ratio, pa.float64()), pa.array(spans, kind), pa.array(tags, pa.string())], names=["key", "ratio", "spans", "tagged"])


def compare(pairs: DataFrame) -> DataFrame:
    """pairs (key string, before, after) -> ratio, spans of changed words, tagged diff."""
    ship_package(pairs.sparkSession)
    return pairs.select("key", "before", "after").mapInArrow(_compare, "key string, ratio double, spans array<struct<start:int,end:int>>, tagged string")


_OPS = pa.list_(pa.struct([("op", pa.int32()), ("text", pa.string())]))


def _char_diffs(cleaned: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sides = zip(part.column("before").to_pylist(), part.column("after").to_pylist(), strict=True)
                made = [char_diff(a or "", b or "") for a, b in sides]
                made = [clean_up(ops) for ops in made] if cleaned else made
                ops = pa.array([[{"op": op, "text": t} for op, t in diff] for diff in made], _OPS)
                yield pa.RecordBatch.from_arrays([part.column("key"), ops], names=["key", "ops"])

    return run


def char_diffs(pairs: DataFrame, cleaned: bool = True) -> DataFrame:
    """pairs (key string, before, after) -> ops: the characters deleted (-1), inserted (1) and kept (0), as few as can be, or cleaned up for readers.

    The first two rebuild before, the last two after. Null is an empty text.
    """
    ship_package(pairs.sparkSession)
    return pairs.select("key", "before", "after").mapInArrow(_char_diffs(cleaned), "key string, ops array<struct<op:int,text:string>>")


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            rows = zip(*(part.column(c).to_pylist() for c in ("text", "selection", "near")), strict=True)
            found = locate_many([(text or "", selection or "", near or 0) for text, selection, near in rows])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.int32())], names=[*part.schema.names, "at"])


def expanded_context(rows: DataFrame) -> DataFrame:
    """rows (key string, text, selection, near int) -> where the selection, perhaps changed or moved, lies in the text now, grown to whole sentences.

    key, at (-1 where it is too different from all of the text), start, end, selected, same_before, same_after: the text in three parts.
    """
    ship_package(rows.sparkSession)
    found = rows.select("key", "text", "selection", "near").mapInArrow(_located, "key string, text string, selection string, near int, at int")
    text = F.coalesce("text", F.lit(""))
    grown = whole_sentence(text, F.col("at"), F.least(F.col("at") + F.char_length(F.coalesce("selection", F.lit(""))), F.char_length(text)))
    out = found.withColumn("x", F.when(F.col("at") >= 0, grown))
    part = lambda a, b: F.substring(text, a + 1, b - a)
    s, e = F.col("x.start"), F.col("x.end")
    return out.select("key", "at", s.alias("start"), e.alias("end"), part(s, e).alias("selected"), part(F.lit(0), s).alias("same_before"), part(e, F.char_length(text)).alias("same_after"))
