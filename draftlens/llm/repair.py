"""Repair of turn structure: cheapest edits that make a conversation's role initials match `(s?(ua)+)?`.

A forward Viterbi pass runs over the grammar's four states (start, after s, after u, after a). Each state carries the least
(cost, audit string) that reaches it; a turn's layer is built from the one before by Keep, Rerole and Delete, and then
closed by Insert transitions, two at most, as two inserts lead from any state to any other. Audits of one state and one
cost that cover the same turns are never prefixes of each other (the one with more inserts would cost more), so the least string of
a layer stays least whatever follows. An audit also settles each turn's new role, and so the repaired turns.

How it runs
1. Rows are damaged and equal ones counted by expressions; a turn is a duplicate unless it is its text's first, found by
   grouping on a digest and joining on digest and turn, a key without repeats.
2. Rows are dealt by ranges of (conversation, turn, role, text), so that a long conversation spreads over tasks. A task
   streams its rows. A conversation that begins and ends inside it, of at most `SEGMENT` rows, is finished there.
3. Others are cut into segments. A segment's table holds the least (cost, audit) from each state to each; tables
   are joined in order by the same rule, pairs of equal length first, and the way back gives each segment its part of the audit. A last
   pass streams the segments' repaired turns through SHA-256, which can only be taken in order; it holds one segment.
   Joining tables takes some 16 bytes for each row of the conversation; texts are not among them.

Edge cases: null role and text are one space, a null turn comes first, a null conv_id is a conversation; rows of one turn
are ordered by role, then text; repeated rows are duplicates; only roles whose first letter is s, u or a can be kept, so an empty one can't;
a conversation of which nothing is left has zeros, an empty audit and no turns; an empty table gives an empty result;
extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlens.session import materialize, ship_package

RESIDUES = 20
#: Rows and characters of a segment, at most (one row of any length makes a segment).
SEGMENT = 2048
SEGMENT_CHARS = 4_000_000
#: Letters of a text that rows are dealt by; the order within a task is by the whole text.
DEALT_BY = 32

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn of this initial, from each state that lets it follow.
FOLLOWS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}

FINE, BLANK, DUPLICATE, CUT = range(4)
_BLANKS = " \t\n\x0b\x0c\r"

Layer = list  # of (cost, audit) or None, by state


def closed(layer: Layer) -> Layer:
    """The layer with what inserts reach."""
    out = list(layer)
    for _ in range(2):
        for p, q in ((START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
            if out[p] is not None:
                new = (out[p][0] + INSERT, out[p][1] + "I")
                if out[q] is None or new < out[q]:
                    out[q] = new
    return out


def step(layer: Layer, role: str, fault: int, copies: int) -> Layer:
    """The layer after one row and its further copies, which are duplicates."""
    out: Layer = [None] * 4
    forced = copies if fault in (BLANK, DUPLICATE) else copies - 1
    tail, more = "D" * forced, DELETE * forced

    def offer(q: int, cost: int, audit: str) -> None:
        new = (cost + more, audit + tail)
        if out[q] is None or new < out[q]:
            out[q] = new

    extra, keeps = TRUNCATED if fault == CUT else 0, FOLLOWS.get(role[:1], {})
    for p, have in enumerate(layer):
        if have is None:
            continue
        cost, audit = have
        if forced == copies:
            offer(p, cost, audit)
            continue
        offer(p, cost + DELETE, audit + "D")
        if p in keeps:
            offer(keeps[p], cost + KEEP + extra, audit + "K")
        for to in ("u", "a"):
            if p in FOLLOWS[to]:
                offer(FOLLOWS[to][p], cost + REROLE + extra, audit + "R")
    return closed(out)


def begun(state: int) -> Layer:
    return closed([(0, "") if q == state else None for q in range(4)])


def ended(layer: Layer) -> tuple[int, str, int]:
    """Least (cost, audit, state) of the states a conversation may end in."""
    return min((*layer[q], q) for q in (START, ASSISTANT) if layer[q] is not None)


def joined(a: list[Layer], b: list[Layer]) -> list[Layer]:
    """Tables of two runs of rows, one after the other, as one."""
    out = []
    for row in a:
        best: Layer = [None] * 4
        for m, left in enumerate(row):
            if left is None:
                continue
            for q, right in enumerate(b[m]):
                if right is not None:
                    new = (left[0] + right[0], left[1] + right[1])
                    if best[q] is None or new < best[q]:
                        best[q] = new
        out.append(best)
    return out


def turns(rows: list[tuple], audit: str, state: int = START) -> list[tuple[str, str, str]]:
    """(role, text, edit) of the turns that an audit leaves of rows (turn, role, text, fault, copies)."""
    out, at, left = [], -1, 0
    for edit in audit:
        if edit == "I":
            role, text = ("assistant" if state == USER else "user"), ""
        else:
            if not left:
                at += 1
                left = rows[at][4]
            left -= 1
            if edit == "D":
                continue
            role, text = rows[at][1], rows[at][2]
            if edit == "R":
                role = "assistant" if state == USER else "user"
        state = FOLLOWS[role[:1]][state]
        out.append((role, text, edit))
    return out


def lines(done: list[tuple[str, str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text, _ in done)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after damage, equal rows counted."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % RESIDUES
    text = F.when(hit == 1, "").when(hit == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    role = F.when(hit == 4, "user").otherwise(said("role"))
    rows = conversations.filter(hit != 0).select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(hit == 3, 2).otherwise(1).alias("n"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("copies"))


def _faults(rows: DataFrame) -> DataFrame:
    """rows with each one's fault."""
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    marked = rows.withColumn("h", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)).withColumn("place", place)
    first = marked.groupBy(F.col("conv_id").alias("c"), F.col("h").alias("g")).agg(F.min("place").alias("first"))
    met = marked.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("g")) & (F.col("place") == F.col("first")), "left")
    trimmed = F.rtrim(F.col("text"), F.lit(_BLANKS))
    last = F.right(trimmed, F.lit(1))
    fault = F.when(trimmed == "", BLANK).when(F.col("g").isNull(), DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)
    return met.select("conv_id", "turn", "role", "text", fault.alias("fault"), "copies")


class Counts:
    """What is counted in a run of rows, in a form that runs can be added in order."""

    __slots__ = ("blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "distinct", "low_turn", "high_turn")

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, role: str, fault: int, copies: int) -> None:
        initial = role[:1]
        self.blank += copies if fault == BLANK else 0
        self.duplicate += copies if fault == DUPLICATE else copies - 1 if fault != BLANK else 0
        self.truncated += fault == CUT
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += copies - 1  # a turn beside its copy
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None:
            self.distinct += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def join(self, later: Counts) -> None:
        for c in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, c, getattr(self, c) + getattr(later, c))
        if later.first is not None:
            if self.last is not None:
                self.illegal += self.last + later.first not in LEGAL
            self.first = later.first if self.first is None else self.first
            self.last = later.last
        if later.low is not None:
            self.distinct += later.distinct - (later.low == self.high)
            self.low = later.low if self.low is None else self.low
            self.high = later.high

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


_TURN = pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.int32()), ("copies", pa.int64())])
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_SEEN = "blank long, duplicate long, truncated long, illegal long, distinct long, first string, last string, low long, high long"
_SEEN_FIELDS = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("distinct", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64())]
_RESULT_FIELDS = [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())]


def _result(seen: Counts, cost: int, audit: str, digest: str) -> dict:
    return {"gaps": seen.gaps(), "blank": seen.blank, "duplicate": seen.duplicate, "truncated": seen.truncated, "illegal": seen.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest}


def _seen(c: Counts) -> dict:
    return {name: getattr(c, name) for name, _ in _SEEN_FIELDS}


def _again(d: dict) -> Counts:
    out = Counts()
    for name, value in d.items():
        setattr(out, name, value)
    return out


def _first_pass(id_type: pa.DataType, segment: int, chars: int):
    """Rows in order -> finished conversations (with result and turns) and segments of others (with table, counts and rows)."""
    schema = pa.schema([
        ("conv_id", id_type), ("part", pa.int32()), ("seq", pa.int64()), ("result", pa.struct(_RESULT_FIELDS)), ("turns", pa.list_(_TURN)),
        ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("seen", pa.struct(_SEEN_FIELDS)), ("rows", pa.list_(_ROW)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size, who, own, alone = 0, None, False, False
        out: list[dict] = []

        def finished() -> dict:
            seen, layer = Counts(), begun(START)
            for turn, role, text, fault, copies in held:
                seen.add(turn, role, fault, copies)
                layer = step(layer, role, fault, copies)
            cost, audit, _ = ended(layer)
            done = turns(held, audit)
            digest = hashlib.sha256(lines(done).encode("utf-8", "surrogatepass")).hexdigest()
            return {"conv_id": who, "part": part, "seq": seq, "result": _result(seen, cost, audit, digest), "turns": [dict(zip(("role", "text", "edit"), t, strict=True)) for t in done]}

        def cut() -> dict:
            seen, table = Counts(), [begun(p) for p in range(4)]
            for turn, role, text, fault, copies in held:
                seen.add(turn, role, fault, copies)
                table = [step(layer, role, fault, copies) for layer in table]
            flat = [x for layer in table for x in layer]
            rows = [dict(zip(("turn", "role", "text", "fault", "copies"), r, strict=True)) for r in held]
            return {"conv_id": who, "part": part, "seq": seq, "costs": [x and x[0] for x in flat], "audits": [x and x[1] for x in flat], "seen": _seen(seen), "rows": rows}

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        # alone: the conversation began inside this task; nothing of it was cut off yet
        for k, (conv, turn, role, text, fault, copies) in enumerate(rows()):
            if k == 0 or conv != who:
                if own:
                    out.append(finished() if alone else cut())
                    seq += 1
                held, size, who, own, alone = [], 0, conv, True, k > 0
            elif len(held) >= segment or size > chars:
                out.append(cut())
                seq += 1
                held, size, alone = [], 0, False
            if copies:  # not so in the row that stands for the conversation itself
                held.append((turn, role, text, fault, copies))
                size += len(text)
            if len(out) >= 256 or out and size > chars:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if own:
            out.append(cut())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _fold(id_type: pa.DataType):
    """Segments in order, without rows -> each one's start state and part of the audit, and the result so far on the first."""
    schema = pa.schema([("conv_id", id_type), ("part", pa.int32()), ("seq", pa.int64()), ("place", pa.int64()), ("state", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()), ("seen", pa.struct(_SEEN_FIELDS))])

    def settled(segments: list[dict]) -> list[dict]:
        seen, stack, tables = Counts(), [], []
        for s in segments:
            seen.join(_again(s["seen"]))
            flat = [None if c is None else (c, a) for c, a in zip(s["costs"], s["audits"], strict=True)]
            table, size = [flat[p * 4 : p * 4 + 4] for p in range(4)], 1
            tables.append(table)
            while stack and stack[-1][0] == size:
                table, size = joined(stack.pop()[1], table), size * 2
            stack.append((size, table))
        whole = stack.pop()[1]
        while stack:
            whole = joined(stack.pop()[1], whole)
        cost, audit, _ = ended(whole[START])
        out, state, at = [], START, 0
        for k, (s, table) in enumerate(zip(segments, tables, strict=True)):
            # the segment's part of the audit is one of its own least ones, and no two of them begin alike and differ in state
            q, part = max(((q, x[1]) for q, x in enumerate(table[state]) if x is not None and audit.startswith(x[1], at)), key=lambda t: len(t[1]))
            out.append({"conv_id": s["conv_id"], "part": s["part"], "seq": s["seq"], "place": k, "state": state, "audit": part, "cost": cost, "seen": _seen(seen)})
            state, at = q, at + len(part)
        assert at == len(audit)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for s in _by_conversation(batches):
            if held and s["conv_id"] != held[0]["conv_id"]:
                yield pa.RecordBatch.from_pylist(settled(held), schema)
                held = []
            held.append(s)
        if held:
            yield pa.RecordBatch.from_pylist(settled(held), schema)

    return run


def _repaired(id_type: pa.DataType):
    """Segments with rows, start state and audit -> their repaired turns."""
    schema = pa.schema([("conv_id", id_type), ("place", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), ("seen", pa.struct(_SEEN_FIELDS)), ("turns", pa.list_(_TURN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                for s in batch.slice(at, 1).to_pylist():
                    done = turns([tuple(r.values()) for r in s["rows"]], s["audit"], s["state"])
                    given = [dict(zip(("role", "text", "edit"), t, strict=True)) for t in done]
                    yield pa.RecordBatch.from_pylist([{"conv_id": s["conv_id"], "place": s["place"], "audit": s["audit"], "cost": s["cost"], "seen": s["seen"], "turns": given}], schema)

    return run


def _digests(id_type: pa.DataType):
    """Repaired segments in order -> one result a conversation."""
    schema = pa.schema([("conv_id", id_type), *_RESULT_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, audit, hasher, said = None, [], None, False

        def result() -> pa.RecordBatch:
            made = _result(_again(first["seen"]), first["cost"], "".join(audit), hasher.hexdigest())
            return pa.RecordBatch.from_pylist([{"conv_id": first["conv_id"], **made}], schema)

        for batch in batches:
            for at in range(batch.num_rows):
                (s,) = batch.slice(at, 1).to_pylist()
                if s["place"] == 0:
                    if first is not None:
                        yield result()
                    first, audit, hasher, said = s, [], hashlib.sha256(), False
                audit.append(s["audit"])
                text = lines([tuple(t.values()) for t in s["turns"]])
                if text:
                    hasher.update((("\n" if said else "") + text).encode("utf-8", "surrogatepass"))
                    said = True
        if first is not None:
            yield result()

    return run


_TURNS = "array<struct<role: string, text: string, edit: string>>"
_ROWS = "array<struct<turn: long, role: string, text: string, fault: int, copies: long>>"


def repair(conversations: DataFrame, segment: int = SEGMENT, chars: int = SEGMENT_CHARS) -> tuple[DataFrame, DataFrame]:
    """(report, repaired): per conversation its counts, cost, audit and digest; and (conv_id, place, turns) with its repaired turns in pieces."""
    spark = conversations.sparkSession
    ship_package(spark)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    id_type = conversations.select("conv_id").limit(0).toArrow().schema.field(0).type
    rows = _faults(damaged(conversations))
    standing = conversations.select("conv_id").distinct().select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("fault"), F.lit(0).cast("long").alias("copies"))
    rows = materialize(rows.unionByName(standing), "turns")
    near = F.substring("text", 1, DEALT_BY)
    dealt = rows.repartitionByRange(F.col("conv_id"), F.col("turn"), F.col("role"), near).sortWithinPartitions("conv_id", "turn", "role", "text")
    cut = f"conv_id {kind}, part int, seq long, result struct<{_colons(_RESULT)}>, turns {_TURNS}, costs array<long>, audits array<string>, seen struct<{_colons(_SEEN)}>, rows {_ROWS}"
    first = materialize(dealt.mapInArrow(_first_pass(id_type, segment, chars), cut), "segments")
    parts = first.filter("result is null")
    keys = parts.select("conv_id", "part", "seq", "costs", "audits", "seen")
    state = f"conv_id {kind}, part int, seq long, place long, state int, audit string, cost long, seen struct<{_colons(_SEEN)}>"
    settled = keys.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_fold(id_type), state)
    met = parts.select("part", "seq", "rows").join(settled, ["part", "seq"])
    done = f"conv_id {kind}, place long, audit string, cost long, seen struct<{_colons(_SEEN)}>, turns {_TURNS}"
    pieces = materialize(met.select("conv_id", "place", "audit", "cost", "seen", "state", "rows").mapInArrow(_repaired(id_type), done), "pieces")
    long_ones = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_digests(id_type), f"conv_id {kind}, {_RESULT}")
    short = first.filter("result is not null")
    report = short.select("conv_id", "result.*").unionByName(long_ones)
    return report, short.select("conv_id", F.lit(0).cast("long").alias("place"), "turns").unionByName(pieces.select("conv_id", "place", "turns"))


def _colons(fields: str) -> str:
    """Fields of a table as those of a struct."""
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split(" ") for f in fields.split(", ")))
