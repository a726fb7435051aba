"""Replay rows, the process model's choices, generated edits and registered functions, against plain Python."""

from __future__ import annotations

import difflib
import hashlib
import random
import re
import time
import unicodedata
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from draftlens import vocab
from draftlens.functions import ids, process, registered
from draftlens.functions import text as T
from draftlens.operators import diffs, metrics, replay, traces
from draftlens.plans import registry
from draftlens.sources import readers, sinks

SF = "/root/testdata/sf0.001"
Q = registry.queries()


@pytest.fixture(scope="module")
def turns(spark):
    rows = sorted((r["conv_id"], r["turn"], r["text"] or "") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect())
    return [(c, t, x, rows[k - 1][2] if k and rows[k - 1][0] == c else None) for k, (c, t, x) in enumerate(rows)]


def test_fixed_digits(spark):
    rng = random.Random(5)
    values = [0.125, 0.375, 0.145, 2.675, 1.005, -0.125, -0.001, 0.0, -0.0, 0.5, 1.5, 2.5, 99.995, 1e-9, 123456.785] + [round(rng.uniform(-9, 9), 3) for _ in range(3000)] + [k / 32 for k in range(-99, 99)]
    rows = spark.createDataFrame([(x,) for x in [*values, None]], "x double").select("x", *(ids.fixed(F.col("x"), d).alias(f"d{d}") for d in (2, 4, 6))).collect()
    for r in rows:
        for d in (2, 4, 6):
            assert r[f"d{d}"] == (None if r["x"] is None else f"{r['x']:.{d}f}")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=200))
def test_fixed_digits_of_any_number(spark, values):
    got = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x double").select("k", ids.fixed(F.col("x"), 3).alias("t")).collect()
    assert {r["k"]: r["t"] for r in got} == {k: f"{x:.3f}" for k, x in enumerate(values)}


def test_frames(spark):
    ops = [(0, "a<b"), (1, "new\n"), (-1, "   "), (2, "p"), (3, "r"), (4, "c"), (7, "none"), (0, None)]
    got = replay.frames(spark.createDataFrame([(1, ops), (2, [])], "k int, ops array<struct<op:int,text:string>>")).collect()
    want = (
        '<span>a&lt;b</span><ins style="background:#82E0AA;">new&para;<br></ins><del style="background:#F1948A;">&nbsp;&nbsp;&nbsp;</del>'
        '<ins style="background:#85C1E9 ;">p</ins><ins style="background:#C39BD3;">r</ins><ins style="background:#FFBF00;">c</ins>'
    )
    assert {r["k"]: r["diff_html"] for r in got} == {1: want, 2: ""}


def test_cards(spark):
    event = "array<struct<status:string,glucose_at_event:double>>"
    rows = [(1, 0, "a", 0, 5, None, "naive", "injection.naive", [("repair", 0.9), ("success", 0.45678)]), (1, 0, "b", 1, 2, "cold", None, None, []), (1, 0, "c", 1, 2, "cold", None, None, None), (1, 1, "d", 1, 2, "warm", None, None, [("repair", 0.0)])]
    s = spark.createDataFrame(rows, f"doc_id long, revision_index int, injection_id string, start int, end int, state string, level string, label string, trace {event}")
    got = {r["injection_id"]: (r["state"], r["level"], r["label"], r["repairs"], r["final_glucose"], r["n_events"]) for r in replay.cards(s).collect()}
    assert got == {"a": ("unknown", "naive", "injection.naive", 1, 0.457, 2), "b": ("cold", "unknown", "unknown", 0, None, 0), "c": ("cold", "unknown", "unknown", 0, None, 0), "d": ("warm", "unknown", "unknown", 1, None, 1)}
    texts = spark.createDataFrame([("x" * 50,), ("y" * 51,)], "t string").select(replay.shortened(F.col("t")).alias("s"))
    assert [r["s"] for r in texts.collect()] == ["x" * 50, "y" * 50 + "..."]


def test_titles_and_paragraphs(spark):
    log = spark.createDataFrame([(9,), (2,), (9,), (None,)], "project int")
    assert [(r["project"], r["title"]) for r in replay.titles(log).orderBy("project").collect()] == [(2, "Project 1"), (9, "Project 2")]
    docs = spark.createDataFrame([(1, "a\nb\n\nc\n\\paragraph{x}\nd"), (2, ""), (3, None)], "doc_id long, text string")
    ranges = replay.paragraph_ranges(docs)
    assert sorted(tuple(r) for r in ranges.collect()) == [(1, 1, 1, 2), (1, 2, 4, 4), (1, 3, 5, 6)]
    lines = spark.createDataFrame([(1, 2), (1, 3), (1, 6), (2, 1)], "doc_id long, line int")
    got = {(r["doc_id"], r["line"]): r["paragraph"] for r in replay.paragraph_of(lines, ranges).collect()}
    assert got == {(1, 2): 1, (1, 3): None, (1, 6): 3, (2, 1): None}


def test_repairs_and_states(spark):
    rows = [(w, m, g, k) for w in ("Method", "other") for m in ("lexical_starvation", "syntactic_collapse", "x") for g in (0.123449, 0.33335, 0.5) for k in (0, 7)]
    df = spark.createDataFrame(rows, "target string, failure string, glucose double, place int")
    got = df.select("*", process.repair_choice(F.col("target"), F.col("failure"), F.col("glucose"), F.col("place"), {"method": ("way", "means", "path")}).alias("r"), process.state_salt(F.col("target"), F.col("glucose"), F.col("place")).alias("s")).collect()
    for r in got:
        n = int(hashlib.md5(f"{r['target']}:{r['failure']}:{r['glucose']:.4f}:{r['place']}".encode()).hexdigest(), 16)
        words = ("way", "means", "path") if r["target"] == "Method" else vocab.REPAIRS["lexical_starvation"]
        options = {"lexical_starvation": [w + " " for w in words], "syntactic_collapse": vocab.REPAIRS["syntactic_collapse"]}.get(r["failure"], vocab.REPAIRS["cognitive_overflow"])
        distance = {"lexical_starvation": 1, "syntactic_collapse": 2}.get(r["failure"], 3)
        assert (r["r"]["repair"], r["r"]["distance"]) == (options[n % len(options)], distance)
        assert r["s"] == hashlib.sha256(f"{r['target']}:{r['glucose']:.6f}:{r['place']}".encode()).hexdigest()


def test_key_intervals(spark, turns):
    assert traces.key_intervals(120.0, 0, "a") == [] and traces.key_intervals(120.0, 5, "a") == traces.key_intervals(120.0, 5, "a")
    got = {r["key"]: r for r in Q["key_intervals"](spark, SF).collect()}
    for c, t, x, _ in turns:
        draw, now, want = random.Random(f"{c}:{t}"), 120.0 + c % 50, []
        while len(want) < len(x.split()):
            share = draw.uniform(-0.15, 0.15)
            now = max(80, now + share * now)
            want.append(round(now, 2))
        r = got[f"{c}:{t}"]
        assert r["n"] == len(want) and (not want or (r["least"], r["most"], r["last"]) == (min(want), max(want), want[-1]))
    none = spark.createDataFrame([(1, None, 3, "s"), (2, 100.0, None, "s"), (3, 100.0, 2, None)], "key int, latency_ms double, n int, salt string")
    assert {r["key"]: r["intervals"] for r in traces.with_intervals(none).collect()} == {1: None, 2: [], 3: None}


def test_eroded_turns(spark, turns):
    got = {(r["doc_id"], r["revision_index"]): r["seen"] for r in Q["eroded_turns"](spark, SF).collect()}
    for c, t, x, _ in turns:
        clarity = 1.0 - (t + 1) / 10.0
        want = x
        if x and clarity < 0.9:
            want = ""
            for k, ch in enumerate(x):
                lost = int(hashlib.md5(f"{c}:{k}".encode()).hexdigest(), 16) % 100 / 100.0 < 1 - clarity
                want += " " if lost and ch in ",.!?;:" else ch.lower() if lost and clarity < 0.6 else ch
        assert got[c, t] == want


def test_eroded_letters_are_not_hashed(spark):
    """Only what may change costs a hash: letters take a fraction of the time that marks take."""

    def seconds(c):
        rows = spark.range(0, 40, 1, 4).select(process.eroded(F.repeat(F.lit(c), (F.lit(10_000) + F.col("id")).cast("int")), F.lit(0.5), F.col("id").cast("string")).alias("x"))
        start = time.perf_counter()
        rows.agg(F.sum(F.char_length("x"))).collect()
        return time.perf_counter() - start

    seconds(","), seconds("a")
    assert min(seconds("a") for _ in range(3)) < 0.6 * min(seconds(",") for _ in range(3))


def test_span_sentences(spark, turns):
    texts = {(c, t): x for c, t, x, _ in turns}
    spans = {(r["doc_id"], r["revision_index"], r["injection_id"]): r for r in registry._spans(registry._revisions(spark, SF)).collect()}
    rows = Q["span_sentences"](spark, SF).collect()
    assert len(rows) == len(spans)
    for r in rows:
        text, at, places = texts[r["doc_id"], r["revision_index"]], 0, []
        for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text):
            if s.strip():
                begin = text.find(s.strip(), at)
                at = begin + len(s.strip())
                places.append((begin, at))
        span = spans[r["doc_id"], r["revision_index"], r["injection_id"]]
        first = [k for k, (a, b) in enumerate(places) if a <= span["start"] < b]
        last = [k for k, (a, b) in enumerate(places) if a < span["end"] <= b]
        assert (r["first_sentence"], r["last_sentence"]) == (first[-1] if first else 0, last[-1] if last else 0)


def plain_scores(before, after, generated):
    def ranges(x):
        return [o[1:3] for o in difflib.SequenceMatcher(None, before.split(), x.split(), autojunk=False).get_opcodes() if o[0] != "equal"]

    made, gold = ranges(generated), ranges(after)
    used, hits = set(), 0
    for a, b in made:
        for k, (c, d) in enumerate(gold):
            if k not in used and a < d and c < b:
                used.add(k)
                hits += 1
                break
    p, r = hits / (len(made) + 1e-12), hits / (len(gold) + 1e-12)
    return p, r, 2 * p * r / (p + r + 1e-12)


def test_generated_scores(spark, turns):
    got = {r["key"]: (r["precision"], r["recall"], r["f1"]) for r in Q["generated_scores"](spark, SF).collect()}
    want = {f"{c}:{t}": plain_scores(b, x, re.sub(r"^\S+\s*", "", x)) for c, t, x, b in turns if b is not None}
    assert set(got) == set(want)
    for key, three in want.items():
        assert got[key] == pytest.approx(three, abs=1e-6)
    nothing = spark.createDataFrame([("k", None, None, None)], "key string, before string, after string, generated string")
    assert [tuple(r) for r in diffs.score_generated(nothing).collect()] == [("k", 0.0, 0.0, 0.0)]


def test_evaluation_report(spark):
    gold = spark.createDataFrame([(1, 0.7, 0, 10), (2, 0.6, 20, 30), (3, None, 0, 9)], "k int, resource_coupling double, span_start_char int, span_end_char int")
    pred = spark.createDataFrame([(1, 0.9, 5, 10), (2, 0.61, None, None), (4, 1.0, 0, 99)], "k int, predicted_coupling double, pred_start int, pred_end int")
    assert [tuple(r) for r in metrics.evaluation_report(gold, pred, ["k"]).collect()] == [(round(2 / 3, 4), 0.25, 2)]
    assert [tuple(r) for r in metrics.evaluation_report(gold, pred.limit(0), ["k"]).collect()] == [(0.0, 1.0, 0)]


def test_csv_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('label,predicted,n\n"Clarity","Flu\nency",3\n"say ""x""",,oops\n')
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"), "n int, label string, predicted string").collect()
    assert [tuple(r) for r in rows] == [(3, "Clarity", "Flu\nency"), (None, 'say "x"', None)]
    with pytest.raises(ValueError, match="no column other"):
        readers.read_csv(spark, str(tmp_path / "a.csv"), "other int")
    sinks.write_predictions(spark.createDataFrame([("t", "p")], "label string, predicted string"), str(tmp_path / "p"))
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "p"), "predicted string, label string").collect()] == [("p", "t")]
    for line in ("{bad", "{worse"):
        sinks.write_failures(spark.createDataFrame([(line,)], "line string"), str(tmp_path / "f"))
    assert sorted(r["line"] for r in spark.read.json(str(tmp_path / "f")).collect()) == ["{bad", "{worse"]


def test_explode_spans(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"doc_id":"d","revisions":[{"revision_index":0,"annotations":[]},{"revision_index":1,"annotations":[{"injection_id":"i","span_start_char":2},{"injection_id":"j"}]}]}\n')
    good, bad = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), readers.AUGMENTED_DOCUMENT)
    assert bad.count() == 0
    assert [(r["revision_index"], r["injection_id"], r["span_start_char"]) for r in readers.explode_spans(good).collect()] == [(1, "i", 2), (1, "j", None)]


def test_registered_functions(spark):
    names = registered.register(spark)
    assert names == ["nfc", "ncd", "indel_ratio", "difflib_spans", "scan_pii"]
    spark.createDataFrame([("é kitten", "sitting here", "Contact me at test@example.com."), (None, "b", None), ("", "", "")], "a string, b string, t string").createOrReplaceTempView("pairs_in")
    rows = spark.sql("select a, b, nfc(a) n, ncd(a, b) c, indel_ratio(a, b) r, difflib_spans(a, b) s from pairs_in").collect()
    size = lambda s: len(zlib.compress(s.encode()))
    for r in rows:
        if r["a"] is None:
            assert (r["n"], r["c"], r["r"], r["s"]) == (None, None, None, None)
            continue
        a, b = r["a"], r["b"]
        assert r["n"] == unicodedata.normalize("NFC", a)
        assert r["c"] == pytest.approx((size(f"{a} {b}") - min(size(a), size(b))) / max(size(a), size(b)) if a else 0.0)
        assert [tuple(x) for x in r["s"]] == [o[1:3] for o in difflib.SequenceMatcher(None, a.split(), b.split(), autojunk=False).get_opcodes() if o[0] != "equal"]
        assert r["r"] == (1.0 if not a else pytest.approx(diffs.indel_ratio(a, b)))
    found = spark.sql("select f.* from pairs_in, lateral scan_pii(t) f").collect()
    assert [(r["rule_id"], r["severity"], r["span_start"], r["span_end"]) for r in found if r["rule_id"] == "email"] == [("email", found[0]["severity"], 14, 30)]


def test_kinds(spark):
    df = spark.createDataFrame([("injection.naive",), ("Idea Generation",), (None,)], "l string")
    got = df.select(T.label_kind(F.col("l")).alias("k"), T.valid_label(F.col("l")).alias("v"), T.abbreviate(F.col("l")).alias("a")).collect()
    assert [tuple(r) for r in got] == [("injection", False, "i"), ("Idea Generation", True, "I.G"), (None, False, None)]
