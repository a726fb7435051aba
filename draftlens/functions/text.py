"""Text as column expressions. Unicode classes are spelled out, as Java's are ASCII unless told."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from draftlens import vocab

WHITE = r"(?U)\s+"


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_text(text: Column, composed: Column | None = None) -> Column:
    """Line ends to LF, at most two in a row, ends stripped; null is empty. composed: the text in NFC, where it may not be."""
    t = empty_if_null(text if composed is None else composed)
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def provenance_hash(text: Column, composed: Column | None = None) -> Column:
    return F.substring(F.sha2(normalize_text(text, composed).cast("binary"), 256), 1, 32)


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(empty_if_null(text), WHITE), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, also for what body says within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_ends(sizes: Column) -> Column:
    """Sums of an array of whole numbers up to and including each.

    A fold that appends copies its array each time; so the sums are made in blocks of the root of the array's length.
    """

    def summed(block: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        grow = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out"))
        return F.aggregate(block, begin, grow, lambda acc: acc["out"])

    def cut(x: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(x))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / step).cast("int")), lambda k: F.slice(x, k * step + 1, step))

    def over(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v))
        starts = F.concat(F.array(F.lit(0)), summed(whole, F.lit(0)))
        return F.flatten(F.transform(F.filter(F.arrays_zip(blocks.alias("b"), starts.alias("s")), lambda z: z["b"].isNotNull()), lambda z: summed(z["b"], z["s"])))

    return let(sizes, lambda x: let(cut(x), over))


def marked_pieces(text: Column, pattern: str, inner: str = "$0") -> Column:
    """text cut at the matches of pattern: pieces outside and inside of them by turns, so that their lengths give all places."""
    mark = "\x00"
    return F.split(F.regexp_replace(F.replace(text, F.lit(mark), F.lit("\x01")), pattern, mark + inner + mark), mark)


def placed_pieces(pieces: Column) -> Column:
    """Structs of piece and end, the sum of lengths up to its end."""
    return let(pieces, lambda p: F.arrays_zip(p.alias("piece"), running_ends(F.transform(p, F.char_length)).alias("end")))


def tokens(text: Column, pattern: str = r"(?U)\w+") -> Column:
    """Lower-cased runs of word characters."""
    return F.regexp_extract_all(F.lower(empty_if_null(text)), F.lit(pattern), F.lit(0))


def lexical_diversity(found: Column) -> Column:
    """Distinct over all tokens, four digits; null for none."""
    return F.round(F.try_divide(F.size(F.array_distinct(found)).cast("double"), F.size(found)), 4)


def nfc(text: Column) -> Column:
    """Text in NFC. Python is sent only what holds a character that composition can change, and null for the rest, which comes back as it is.

    A UDF is worked out for all rows, whatever conditions stand around it; so the condition is in its argument.
    """

    @F.arrow_udf("string")
    def composed(x: pa.Array) -> pa.Array:
        made = lambda part: pa.array([t if t is None else unicodedata.normalize("NFC", t) for t in part.to_pylist()], pa.string())
        # strings of Python's are up to four times as large as Arrow's: few at a time
        return pa.concat_arrays([made(x.slice(at, 64)) for at in range(0, len(x), 64)]) if len(x) else made(x)

    return F.coalesce(composed(F.when(text.rlike(r"[^\x00-\x{2FF}]"), text)), text)


def set_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members; two empty sets are equal, one empty set shares nothing."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def word_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(words(F.lower(a)), words(F.lower(b)))


def character_jaccard(a: Column, b: Column) -> Column:
    chars = lambda t: F.filter(F.split(empty_if_null(t), ""), lambda x: x != "")
    return set_jaccard(chars(a), chars(b))


def sentences(text: Column) -> Column:
    """Split after . ! ? before white space and a capital."""
    parts = F.split(empty_if_null(text), r"(?<=[.!?])(?U:\s+)(?=[A-Z])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def offsets_of(text: Column, parts: Column) -> Column:
    """[start, end) of each part, looked for from the end of the one before; a part not found starts there."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        found = F.call_function("locate", s, text, acc["at"] + 1)
        begin = F.when(found == 0, acc["at"]).otherwise(found - 1)
        end = begin + F.char_length(s)
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end"))).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def sentence_offsets(text: Column, parts: Column | None = None) -> Column:
    """[start, end) of each of sentences(text), in one walk: from the lengths of what the text is cut into. parts: of these instead, by search."""
    if parts is not None:
        return offsets_of(text, parts)
    pieces = placed_pieces(marked_pieces(empty_if_null(text), r"(?<=[.!?])(?U:\s+)(?=[A-Z])"))

    def place(x: Column, i: Column) -> Column:
        size, kept = F.char_length(x["piece"]), F.regexp_replace(x["piece"], r"(?U)^\s+", "")
        begin = x["end"] - F.char_length(kept)
        return F.when((i % 2 == 0) & (size > 0), F.struct(begin.alias("start"), (begin + F.char_length(strip(kept))).alias("end")))

    return F.filter(F.transform(pieces, place), lambda o: o.isNotNull() & (o["end"] > o["start"]))


def sentence_index(offsets: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Sentences of a span: start in [s, e), end in (s, e]; the last that fits, else 0."""

    def last(fits) -> Column:
        hits = F.filter(F.transform(offsets, lambda o, i: F.when(fits(o), i).otherwise(F.lit(-1))), lambda i: i >= 0)
        return F.coalesce(F.array_max(hits), F.lit(0))

    return last(lambda o: (start >= o["start"]) & (start < o["end"])), last(lambda o: (end > o["start"]) & (end <= o["end"]))


# screening


def leaks_prompt(text: Column) -> Column:
    """The strict rule: an opening, a bracketed marker, an echo of instructions, or exactly one pair of quotes around all."""
    t = strip(empty_if_null(text))
    opening = t.rlike("(?i)^(?:" + "|".join(vocab.LEAKAGE_OPENINGS) + ")")
    upper, lower = F.upper(t), F.lower(t)
    bracket = t.contains("[") & t.contains("]") & _any(upper.contains(w) for w in vocab.LEAKAGE_BRACKET_WORDS)
    echo = _any(lower.contains(w.lower()) for w in vocab.LEAKAGE_ECHOES)
    quoted = t.startswith('"') & t.endswith('"') & (F.char_length(t) - F.char_length(F.replace(t, F.lit('"'), F.lit(""))) == 2)
    return opening | bracket | echo | quoted


def leakage_patterns(text: Column, patterns: Sequence[str] = vocab.LEAKAGE_PATTERNS) -> Column:
    """The patterns that occur, ^ and $ matching at lines."""
    return F.array_compact(F.array(*(F.when(F.regexp_like(text, F.lit("(?m)" + p)), F.lit(p)) for p in patterns)))


def matches_template(text: Column, templates: Sequence[str] = vocab.NAIVE_TEMPLATES) -> Column:
    lower = F.lower(empty_if_null(text))
    return _any(lower.contains(t.lower()) for t in templates)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def pii_places(text: Column, rule: str) -> Column:
    """[start, end) of pii_matches(text, rule), in one walk."""
    pattern = "(?U)" + (vocab.PII_STRICT if rule in vocab.PII_STRICT else vocab.PII_HEURISTIC)[rule]
    named = lambda m: F.lit(False) if rule in vocab.PII_STRICT else _any(m.startswith(w) for w in vocab.PII_NOT_NAMES)
    place = lambda x, i: F.when((i % 2 == 1) & ~named(x["piece"]), F.struct((x["end"] - F.char_length(x["piece"])).alias("start"), x["end"].alias("end")))
    return F.array_compact(F.transform(placed_pieces(marked_pieces(empty_if_null(text), pattern)), place))


def pii_matches(text: Column, rule: str) -> Column:
    """All matches of one rule, in order; names that begin as captions do are left out."""
    if rule in vocab.PII_STRICT:
        return F.regexp_extract_all(empty_if_null(text), F.lit("(?U)" + vocab.PII_STRICT[rule]), F.lit(0))
    found = F.regexp_extract_all(empty_if_null(text), F.lit("(?U)" + vocab.PII_HEURISTIC[rule]), F.lit(0))
    return F.filter(found, lambda m: ~_any(m.startswith(w) for w in vocab.PII_NOT_NAMES))


def discourse_count(text: Column, markers: Sequence[str] = vocab.DISCOURSE_MARKERS) -> Column:
    return F.regexp_count(F.lower(empty_if_null(text)), F.lit(r"\b(" + "|".join(markers) + r")\b"))


def syntactic_demand(text: Column, markers: Sequence[str] = vocab.DEMAND_MARKERS) -> Column:
    """At most 10: a tenth of the words and 1.2 for each marker; 1 for no text."""
    raw = word_count(text) / 10.0 + 1.2 * discourse_count(text, markers)
    return F.when(empty_if_null(text) == "", F.lit(1.0)).otherwise(F.least(F.lit(10.0), raw))


def conceptual_ruptures(text: Column, w: Column, window: int = 50, long: int = 8, shift: float = 0.28) -> Column:
    """Character places (in the words joined by one space) where attention shifts; the middle of a text without any.

    w: the words of text, as a column that is there already, since they are looked at once for each place.
    """
    t = empty_if_null(text)
    step = window // 2

    def rare(part: Column) -> Column:
        return F.size(F.filter(part, lambda x: F.char_length(x) > long))

    def place(i: Column, ends: Column) -> Column:
        moved = F.abs(rare(F.slice(w, i + 1, window)) - rare(F.slice(w, i - window + 1, window))) / float(window)
        marked = discourse_count(F.array_join(F.slice(w, i + 1, 15), " ")) >= 1
        return F.when((moved > shift) | marked, F.get(ends, i - 1))

    middle = F.array(F.floor(F.char_length(t) / 2).cast("int"))
    n = F.size(w)
    places = F.when(n - window > window, F.sequence(F.lit(window), n - window - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    # where each word ends, with one blank after it
    ends = running_ends(F.transform(w, lambda x: F.char_length(x) + 1))
    found = let(ends, lambda e: F.array_sort(F.array_distinct(F.array_compact(F.transform(places, lambda i: place(i, e))))))
    return let(found, lambda f: F.when((n < 2 * window) | (F.size(f) == 0), middle).otherwise(f))


# labels and markup


def parse_label(text: Column, fallback: str | None = "Invalid", labels: Sequence[str] = vocab.WRITING_INTENTIONS) -> Column:
    """The label that a reply names: itself, or the first of the vocabulary inside it, or fallback (None: the reply)."""
    t = empty_if_null(text)
    out = t if fallback is None else F.lit(fallback)
    for label in reversed(labels):
        out = F.when(t.contains(label), label).otherwise(out)
    return F.when(t.isin(*labels), t).otherwise(out)


def valid_label(text: Column, labels: Sequence[str] = vocab.WRITING_INTENTIONS) -> Column:
    return F.coalesce(text.isin(*labels), F.lit(False))


def label_kind(label: Column) -> Column:
    """injection, anomaly or assistance: what stands before the first point."""
    return F.substring_index(label, ".", 1)


def clean_tags(text: Column) -> Column:
    """Tagged text as written: deletions go, additions and kept parts stay."""
    t = F.regexp_replace(text, r"(?s)<del>.*?</del>", "")
    return F.regexp_replace(t, r"</?(?:same|add|del)>", "")


def strip_code_fences(text: Column) -> Column:
    """Without a first and a last line of back-ticks."""
    return F.regexp_replace(F.regexp_replace(strip(text), r"\A```[^\n]*\n?", ""), r"\n?```\s*\z", "")


def first_json_array(text: Column) -> Column:
    return F.regexp_extract(text, r"\[[\s\S]*\]", 0)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def abbreviate(label: Column) -> Column:
    return F.array_join(F.transform(F.split(label, " "), lambda w: F.substring(w, 1, 1)), ".")


def render_diff(ops: Column) -> Column:
    """A diff array of (op, text) as HTML: deletions and insertions marked, the rest plain."""

    def one(o: Column) -> Column:
        t = escape_html(o["text"])
        return F.when(o["op"] == -1, F.concat(F.lit("<del>"), t, F.lit("</del>"))).when(o["op"] == 1, F.concat(F.lit("<ins>"), t, F.lit("</ins>"))).otherwise(t)

    return F.array_join(F.transform(ops, one), "")


def prompt_columns(before: Column, previous: Column | None = None) -> Column:
    """Input of an intention model: the text before the edit, and the previous label where one is used."""
    body = F.concat(F.lit("<INPUT><BT>"), empty_if_null(before), F.lit("</BT> "))
    end = F.lit("</INPUT>")
    return F.concat(body, end) if previous is None else F.concat(body, F.lit("<PWA>"), F.coalesce(previous, F.lit("none")), F.lit("</PWA> "), end)


# replies of models and markup for reports

#: Openings of replies that talk about themselves, where no pattern file is given.
META_OPENINGS = (r"^Here is .*?:?\s*\n*", r"^Here's .*?:?\s*\n*")


def strip_meta(text: Column, openings: Sequence[str] = META_OPENINGS, endings: Sequence[str] = ()) -> Column:
    """A reply without its openings and endings, one pair of quotes or back-ticks, or a code block around all of it."""
    t = strip(text)
    for p in (*openings, *endings):
        t = F.regexp_replace(t, "(?im)" + p, "")
    t = strip(t)
    inner = F.substring(t, F.lit(2), F.greatest(F.char_length(t) - 2, F.lit(0)))
    quotes = F.char_length(t) - F.char_length(F.replace(t, F.lit('"'), F.lit("")))
    t = F.when(t.startswith('"') & t.endswith('"') & (quotes == 2), inner).otherwise(t)
    inner = F.substring(t, F.lit(2), F.greatest(F.char_length(t) - 2, F.lit(0)))
    t = F.when(t.startswith("`") & t.endswith("`") & (F.char_length(t) > 1) & ~inner.contains("`"), inner).otherwise(t)
    return strip(F.regexp_replace(t, r"\A```\w*\n([\s\S]*?)\n```\z", "$1"))


def content_quality(text: Column, least_chars: int = 50, least_words: int = 10, phrases: Sequence[str] = ()) -> Column:
    """ok, or the first reason against a reply."""
    t, n = empty_if_null(text), word_count(text)
    out = F.when(t == "", "empty_response").when(F.char_length(t) < least_chars, F.concat(F.lit("too_short_chars:"), F.char_length(t).cast("string"))).when(n < least_words, F.concat(F.lit("too_short_words:"), n.cast("string")))
    for p in phrases:
        out = out.when(F.lower(t).contains(p.lower()), f"suspicious_phrase:{p}")
    return out.otherwise("ok")


def escape_tex(text: Column) -> Column:
    """For LaTeX. The order matters: braces of the first replacement are escaped by later ones."""
    for a, b in (("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"), ("<", "\\textless{}"), (">", "\\textgreater{}")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def highlight(text: Column, spans: Column) -> Column:
    """HTML of text with spans (start, end, id, state) marked, by start; what lies between is escaped."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.when(s["start"] > acc["at"], escape_html(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]))).otherwise("")
        mark = F.concat(F.lit('<mark data-state="'), F.coalesce(s["state"], F.lit("unknown")), F.lit('" data-id="'), s["id"], F.lit('">'), escape_html(F.substring(text, s["start"] + 1, s["end"] - s["start"])), F.lit("</mark>"))
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], before, mark).alias("out"))

    rest = lambda acc: F.concat(acc["out"], escape_html(F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.aggregate(F.array_sort(spans), begin, step, rest)


def whole_sentence(text: Column, start: Column, end: Column) -> Column:
    """A selection [start, end) grown to the nearest ends of sentences: struct of start, end."""
    stop = r"[.?!;\n]"
    after = F.regexp_instr(F.substring(text, end, F.char_length(text)), F.lit(stop))
    before = F.regexp_instr(F.reverse(F.substring(text, F.lit(2), start)), F.lit(stop))
    return F.struct(F.when(start <= 0, 0).when(before == 0, 0).otherwise(start - before + 2).alias("start"), F.when(after == 0, F.char_length(text)).otherwise(end + after - 1).alias("end"))


def paragraph_numbers(text: Column) -> Column:
    """Number of the paragraph of each line: a new one begins after a blank line and at a sectioning command."""
    blank = lambda x: F.trim(x) == ""
    head = lambda x: x.rlike(r"^\s*\\(?:paragraph|subsection|subsubsection)\{")
    new = lambda lines, i: (F.coalesce(blank(F.get(lines, i - 1)), F.lit(True)) | head(F.get(lines, i)))
    sizes = lambda lines: F.transform(lines, lambda x, i: (~blank(x) & new(lines, i)).cast("int"))
    numbers = lambda lines: F.transform(F.arrays_zip(lines.alias("line"), running_ends(sizes(lines)).alias("n")), lambda z: F.when(blank(z["line"]), 0).otherwise(z["n"]))
    return let(F.split(text, "\n"), numbers)


def split_reply(text: Column) -> Column:
    """The two parts of a reply around a line of four dashes or more; the second is null without one."""
    parts = F.split(text, r"-{4,}", 2)
    return F.struct(strip(F.get(parts, F.lit(0))).alias("first"), strip(F.get(parts, F.lit(1))).alias("second"))


def instruction_rows(system: Column, user: Column, assistant: Column | None = None) -> Column:
    """A conversation of instruction, input and, for training, answer: an array of role and content."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), empty_if_null(content).alias("content"))
    return F.array(turn("system", system), turn("user", user), *([] if assistant is None else [turn("assistant", assistant)]))


def pattern_score(text: Column, scores: dict[str, float]) -> Column:
    """Sum of the scores of the patterns that occur, case aside."""
    out = F.lit(0.0)
    for pattern, score in scores.items():
        out = out + F.when(text.rlike("(?i)" + pattern), float(score)).otherwise(0.0)
    return out


def first_pattern(text: Column, names: dict[str, str], fallback: str = "unknown") -> Column:
    """The name of the first pattern, in the order given, that occurs."""
    out = F.lit(fallback)
    for pattern, name in reversed(names.items()):
        out = F.when(text.rlike("(?i)" + pattern), name).otherwise(out)
    return out
