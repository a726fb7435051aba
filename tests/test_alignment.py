"""Alignment against dynamic programmes, the clean-up, moved selections, and edit streams against a plain loop."""

from __future__ import annotations

import hashlib
import random
import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from draftlens.functions import alignment as A
from draftlens.operators import clipboard, diffs, events
from draftlens.plans import registry


def common(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        corner = 0
        for j, d in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


def sides(ops):
    return "".join(t for op, t in ops if op <= 0), "".join(t for op, t in ops if op >= 0)


def pairs(seed, n):
    rnd = random.Random(seed)
    for _ in range(n):
        letters = rnd.choice(["ab", "abc \n", "abcdefgh é🙂"])
        a, b = ("".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in "ab")
        yield a, (a[: len(a) // 2] + b[:5] + a[len(a) // 2 + 2 :] if rnd.random() < 0.5 else b)


@pytest.mark.parametrize("kept_bits", [1 << 25, 50, 1])
def test_diffs_are_minimal(kept_bits):
    """Both sides are rebuilt, and no diff keeps more characters; rows kept and halves give the same length."""
    for a, b in pairs(3, 1200):
        ops = A.char_diff(a, b, kept_bits)
        assert sides(ops) == (a, b)
        assert sum(len(t) for op, t in ops if op == 0) == common(a, b) == A.common_length(a, b)
        assert sides(A.clean_up(ops)) == (a, b)
        assert A.indel_ratio(a, b) == (2 * common(a, b) / (len(a) + len(b)) if a + b else 1.0)


def test_clean_up():
    cleaned = lambda a, b: A.clean_up(A.char_diff(a, b))
    assert cleaned("mouse", "sofas") == [(-1, "mouse"), (1, "sofas")]
    assert cleaned("The cat came.", "The dog and cat came.") == [(0, "The"), (1, " dog and"), (0, " cat came.")]
    assert cleaned("", "") == [] and cleaned("", "x") == [(1, "x")] and cleaned("same", "same") == [(0, "same")]
    assert A.clean_up([(-1, "abcxxx"), (1, "xxxdef")]) == [(-1, "abc"), (0, "xxx"), (1, "def")]
    assert A.clean_up([(-1, "xxxabc"), (1, "defxxx")]) == [(1, "def"), (0, "xxx"), (-1, "abc")]


def test_long_pairs_take_seconds():
    rnd = random.Random(4)
    a = "".join(rnd.choice("abcdefghij klmn") for _ in range(100_000))
    letters = list(a)
    for _ in range(20_000):
        letters[rnd.randrange(len(letters))] = rnd.choice("abc")
    b = "".join(letters)
    began = time.process_time()
    assert 0.7 < A.indel_ratio(a, b) < 0.9
    ops = A.char_diff(a, b)
    assert sides(ops) == (a, b) == sides(A.clean_up(ops))
    assert time.process_time() - began < 30


def sellers(text, pattern):
    """For each place, the least distance of the pattern to a piece that begins there."""
    out = []
    for i in range(len(text)):
        row, best = list(range(len(pattern) + 1)), len(pattern)
        for c in text[i:]:
            corner, row[0] = row[0], row[0] + 1
            for j, d in enumerate(pattern, 1):
                corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (c != d))
            best = min(best, row[-1])
        out.append(best)
    return out


def test_start_distances_are_those_of_the_dynamic_programme():
    for a, b in pairs(5, 300):
        if a and b:
            assert A.start_distances(a, b[:11]) == sellers(a, b[:11])
            scores = [d / len(b) + abs(i - 7) / 100 for i, d in enumerate(sellers(a, b))]
            exact = a[7 : 7 + len(b)] == b
            want = 7 if exact else scores.index(min(scores)) if min(scores) <= 0.5 else -1
            assert A.locate(a, b, 7, distance=100) == want


def test_many_are_located_as_one_by_one(monkeypatch):
    """Texts longer and shorter than a lane, of one lane and many, patterns up to and beyond 64 characters, letters beyond U+FFFF."""
    rnd, rows = random.Random(13), []
    for k in range(300):
        text = "".join(rnd.choice("ab c.\u00e9\U0001f600") for _ in range(rnd.choice([0, 1, 7, 40, 64, 65, 200, 700])))
        size, at = rnd.choice([0, 1, 5, 20, 63, 64, 65, 90]), rnd.randrange(len(text) + 1)
        pattern = list(text[at : at + size])
        for _ in range(rnd.randrange(4)):
            pattern.insert(rnd.randrange(len(pattern) + 1), rnd.choice("abx#"))
        rows.append((text, "".join(pattern), rnd.choice([0, at, rnd.randrange(900)])))
    for lane, lanes in ((512, 1024), (16, 8)):
        monkeypatch.setattr(A, "LANE", lane)
        monkeypatch.setattr(A, "LANES", lanes)
        assert A.locate_many(rows) == [A.locate(*r) for r in rows]


def test_located_side_by_side_takes_less_time():
    rnd = random.Random(14)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    rows = [(text := " ".join(rnd.choice(words) for _ in range(300)), text[900:920] + "#" + text[921:951], 0) for _ in range(200)]
    start = time.perf_counter()
    got = A.locate_many(rows)
    many = time.perf_counter() - start
    start = time.perf_counter()
    assert got == [A.locate(*r) for r in rows]
    assert many < (time.perf_counter() - start) / 3


def test_moved_selection_and_its_sentences(spark):
    text = "First one. Second sentence here! Third? And a long last line; done."
    rows = [("a", text, "sentense her", 0), ("b", text, "zzzzqqqqxxxx", 0), ("c", None, "x", 3), ("d", text, None, 4), ("e", "", "", 0), ("f", text, "Third", 33)]
    got = {r["key"]: r for r in diffs.expanded_context(spark.createDataFrame(rows, "key string, text string, selection string, near int")).collect()}
    assert got["a"]["at"] == text.index("sentence") and got["a"]["selected"] == " Second sentence here!"
    assert got["a"]["same_before"] + got["a"]["selected"] + got["a"]["same_after"] == text
    assert got["b"]["at"] == -1 and got["b"]["selected"] is None and got["c"]["at"] == -1
    assert got["f"]["selected"] == " Third?" and got["d"]["at"] == 4 and got["e"]["at"] == 0


def test_char_diffs_query_rebuilds(spark, sf):
    """The query's counts are those of diffs that rebuild every turn of the table."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want, before = {}, {}
    for r in turns:
        if r["conv_id"] in before:
            ops = A.clean_up(A.char_diff(before[r["conv_id"]], r["text"] or ""))
            assert sides(ops) == (before[r["conv_id"]], r["text"] or "")
            want[f"{r['conv_id']}:{r['turn']}"] = tuple(sum(len(t) for op, t in ops if op == k) for k in (-1, 1, 0))
        before[r["conv_id"]] = r["text"] or ""
    got = {r["key"]: (r["deleted"], r["inserted"], r["kept"]) for r in registry.queries()["revision_char_diffs"](spark, sf).collect()}
    assert got == want


# edit streams


def cut(text):
    return re.findall(clipboard.PIECES, text)


def place(before):
    return f"({before.count(chr(10))},{len(before.split(chr(10))[-1])})"


def change(before, after):
    if before == after:
        return clipboard.SAME
    a, b = cut(before), cut(after)
    s = 0
    while s < min(len(a), len(b)) and a[s] == b[s]:
        s += 1
    e = 0
    while e < min(len(a), len(b)) - s and a[-1 - e] == b[-1 - e]:
        e += 1
    gone, new = "".join(a[s : len(a) - e]), "".join(b[s : len(b) - e])
    told = f"{new}--added" if not gone else f"{gone}--deleted" if not new else f"{gone}->{new}"
    return f"{place(''.join(a[:s]))} {told}"


def plain(edits):
    """(tie, height, undone, token) of edits (project, ts, tie, kind, text, new_text, selection), in a loop with a clipboard and a stack."""
    out, clip, stacks = [], {}, {}
    for project, _, tie, kind, text, new, selection in sorted(edits, key=lambda x: (x[0], x[1], x[2])):
        stack, undone, text = stacks.setdefault(project, []), None, text or ""
        if kind == "copy":
            clip[project] = selection if selection is not None else clip.get(project)
            token = None if selection is None else f"{place(text[: max(text.find(selection), 0)])}, {selection}"
        elif kind == "undo":
            token = clipboard.SAME
            if stack:
                undone, was, now = stack.pop()
                token = change(now, was)
        else:
            after = (new or "") if kind == "type" else text + (clip.get(project) or "")
            token = change(text, after)
            stack.append((tie, text, after))
        out.append((tie, len(stack), undone, token))
    return sorted(out)


SCHEMA = "project int, ts timestamp, tie long, kind string, text string, new_text string, selection string"


def test_edit_streams_against_a_loop(spark):
    """Undos beyond the bottom of the stack, pastes before any copy, ties of time, nulls; several days, so that state crosses the cuts."""
    from datetime import datetime, timedelta

    rnd, rows = random.Random(9), []
    texts = [None, "", "One. Two! Three?\nFour", "One. Two! Five?\nFour", "Two! Three?", "\n\n", "no stop", "A.B.C."]
    for k in range(1500):
        kind = rnd.choice(["type", "copy", "paste", "undo", "undo"])
        at = datetime(2024, 1, 1) + timedelta(hours=rnd.randrange(400))
        rows.append((rnd.choice([1, 1, 1, 2]), at, k, kind, rnd.choice(texts), rnd.choice(texts), rnd.choice(["Two!", "", "Four", "absent", None]) if kind == "copy" else None))
    got = clipboard.tokenised(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["tie"], r["height"], r["undone"], r["token"]) for r in got) == plain(rows)


def test_edit_stream_query_against_a_loop(spark, sf):
    log, turns = events.edit_log(spark.read.parquet(f"{sf}/events.parquet")), spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r[c.split(" ")[0]] for c in SCHEMA.split(", ")) for r in clipboard.bound(log, turns).collect()]
    want = [(tie, height, undone, hashlib.md5(token.encode()).hexdigest()) for tie, height, undone, token in plain(rows)]
    got = registry.queries()["edit_stream_tokens"](spark, sf).collect()
    assert sorted((r["tie"], r["height"], r["undone"], r["token_md5"]) for r in got) == want and len(want) > 500


def test_edits_that_undo_nothing_are_no_task_of_their_own(spark):
    rows = [(k % 40, datetime(2024, 1, 1 + k % 28, 0, 0, k % 60), k, ("type", "copy", "paste", "undo")[k % 4], "One. Two.", "One. Three.", "Two.") for k in range(800)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        parts = clipboard.tokenised(spark.createDataFrame(rows, SCHEMA)).withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    finally:
        for name, value in (("adaptive.enabled", "true"), ("shuffle.partitions", "4")):
            spark.conf.set(f"spark.sql.{name}", value)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 800 and max(sizes) < 240
