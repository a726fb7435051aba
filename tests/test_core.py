"""Literal cases of the analytics operators."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from draftlens import vocab
from draftlens.functions import ids
from draftlens.functions import text as T
from draftlens.functions import times
from draftlens.operators import detect, diffs, events, metrics, revisions, sessions, spans, traces


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(
    "text,want",
    [("a\r\nb\rc", "a\nb\nc"), ("a\n\n\n\nb", "a\n\nb"), ("   x  ", "x"), (None, ""), ("", "")],
)
def test_normalize(spark, text, want):
    assert one(spark, T.normalize_text(lit(text))) == want


def test_words_and_tokens(spark):
    assert one(spark, T.word_count(lit(" a  b c\n"))) == 3
    assert one(spark, T.word_count(lit(None))) == 0
    assert one(spark, T.tokens(lit("Été, l'hiver_2"))) == ["été", "l", "hiver_2"]


@pytest.mark.parametrize("a,b,want", [("", "", 1.0), ("a", "", 0.0), ("a b", "B c", 1 / 3), ("A a", "a", 1.0)])
def test_jaccard(spark, a, b, want):
    assert one(spark, T.word_jaccard(lit(a), lit(b))) == pytest.approx(want)


def test_sentences_and_offsets(spark):
    text = "One here. Two there!  Three? four. Five"
    parts = one(spark, T.sentences(lit(text)))
    assert parts == ["One here.", "Two there!", "Three? four.", "Five"]
    offs = one(spark, T.sentence_offsets(lit(text), T.sentences(lit(text))))
    assert [text[o["start"] : o["end"]] for o in offs] == parts


@pytest.mark.parametrize(
    "text,want",
    [("Sure, here it is", True), ("See [TARGET] now", True), ("[1] and [2]", False), ("Return only the modified text", True), ('"quoted"', True), ('"two" and "more"', False), ("Plain prose.", False)],
)
def test_strict_leakage(spark, text, want):
    assert one(spark, T.leaks_prompt(lit(text))) is want


def test_leakage_patterns_match_at_lines(spark):
    assert len(one(spark, T.leakage_patterns(lit("x\nhere is it, as an AI")))) == 2


@pytest.mark.parametrize(
    "reply,fallback,want",
    [("Clarity", "Invalid", "Clarity"), ("It is 'Fluency'.", "Invalid", "Fluency"), ("none", "Invalid", "Invalid"), ("none", None, "none"), ("Clarity or Text Production", "x", "Text Production")],
)
def test_parse_label(spark, reply, fallback, want):
    assert one(spark, T.parse_label(lit(reply), fallback)) == want


def test_clean_tags_and_fences(spark):
    assert one(spark, T.clean_tags(lit("<same>a</same><del>b\nc</del><add>d</add></del>"))) == "ad"
    assert one(spark, T.strip_code_fences(lit("```latex\nx = 1\n```"))) == "x = 1"
    assert one(spark, T.escape_html(lit("a<b>&\n"))) == "a&lt;b&gt;&amp;<br>"


def test_ids(spark):
    import hashlib

    assert one(spark, ids.make_id("doc", "k", lit("1"))) == "doc_" + hashlib.sha256(b"k:1").hexdigest()[:16]
    for n in (2, 100, 9973):
        assert one(spark, ids.md5_mod(lit("abc"), n)) == int(hashlib.md5(b"abc").hexdigest(), 16) % n


def test_times(spark):
    assert one(spark, times.iso_from_millis(F.lit(1_700_000_000_123).cast("long"))) == "2023-11-14T22:13:20.123000+00:00"
    assert one(spark, times.iso_from_millis(F.lit(1_700_000_000_000).cast("long"))) == "2023-11-14T22:13:20+00:00"
    assert one(spark, times.parse_iso(lit("not a time"))) is None
    assert one(spark, times.week_start(lit("2024-01"))) == dt.date(2024, 1, 1)


# metrics


@pytest.mark.parametrize("y,s,want", [([0, 0, 1, 1], [0.1, 0.4, 0.5, 0.8], 1.0), ([0, 0, 1, 1], [0.8, 0.5, 0.4, 0.1], 0.0), ([0, 1], [0.5, 0.5], 0.5), ([1, 1], [0.1, 0.2], 0.0)])
def test_auc(spark, y, s, want):
    df = spark.createDataFrame(list(zip(y, s, strict=True)), "y int, s double")
    assert metrics.auc(df, F.col("y") == 1, F.col("s")).first()["auc"] == want


def test_auc_of_opposite_scores(spark):
    rng = random.Random(4)
    rows = [(rng.random() < 0.4, rng.randint(0, 9)) for _ in range(200)]
    df = spark.createDataFrame(rows, "y boolean, s int")
    a, b = (metrics.auc(df, F.col("y"), c).first()["auc"] for c in (F.col("s"), -F.col("s")))
    assert a + b == pytest.approx(1.0, abs=2e-6)


def test_f1_and_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1)], "t int, p int")
    assert metrics.binary_f1(df, F.col("t") == 1, F.col("p") == 1).first()["f1"] == 0.5
    s = {r["metric"]: r["value"] for r in metrics.summary(metrics.confusion(df, "t", "p")).collect()}
    assert s["accuracy"] == s["micro_f1"] == 0.3333 and s["macro_f1"] == 0.25
    assert metrics.confusion(df, "t", "p", dense=True).count() == 4


def _iou(spark, a, b):
    make = lambda rows: spark.createDataFrame(rows, "start int, end int")
    got = spans.iou(make(a), make(b)).collect()
    return got[0]["iou"] if got else None


def test_iou(spark):
    assert _iou(spark, [(0, 10)], [(5, 15)]) == pytest.approx(5 / 15, abs=1e-6)
    assert _iou(spark, [(0, 10)], [(10, 20)]) == 0.0
    a, b = [(0, 4), (3, 9), (12, 15)], [(2, 13)]
    assert _iou(spark, a, b) == _iou(spark, b, a) == pytest.approx(8 / 15, abs=1e-6)


def test_kappa(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "x")], "a string, b string")
    assert metrics.kappa(df, "a", "b").first()["kappa"] == 0.0
    df = spark.createDataFrame([("x", "x"), ("y", "y"), ("x", "y"), ("y", "y")], "a string, b string")
    assert metrics.kappa(df, "a", "b").first()["kappa"] == 0.5


def test_diverse_and_rotation(spark):
    df = spark.createDataFrame([(i, "ab"[i > 7], 100 - i) for i in range(10)], "k int, g string, s int")
    got = metrics.diverse(df, "g", "s", "k", 2, 5).collect()
    assert sorted(r["g"] for r in got) == ["a", "a", "b", "b"]
    r = metrics.rotation(spark.range(9), F.col("id"), vocab.LEVELS, vocab.STATES)
    assert r.select("level", "state").distinct().count() == 9


# revisions and spans


def rev(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, revision_index int, text string")


def test_anomalies(spark):
    rows = [(1, 0, "a b c d"), (1, 2, "a b c d"), (2, 0, "x" * 100), (2, 1, "x" * 39), (3, 0, "a b c d e"), (3, 1, "v w x y z"), (4, 0, "same words"), (4, 1, "same words")]
    got = {(r["doc_id"], r["revision_index"]): r["anomaly"] for r in revisions.anomalies(rev(spark, rows)).collect()}
    assert [got[k] for k in ((1, 2), (2, 1), (3, 1), (4, 1), (1, 0))] == ["anomaly.missing_revision", "anomaly.truncation", "anomaly.large_diff", None, None]
    df = rev(spark, [(1, 0, "a"), (1, 1, "a")]).withColumn("d", F.when(F.col("revision_index") == 1, -60.0))
    assert revisions.anomalies(df, F.col("d")).filter("revision_index = 1").first()["anomaly"] == "anomaly.timestamp_jitter"


def test_state_is_the_running_maximum():
    step = {(0, 0): 0, (0, 1): 1, (0, 2): 2, (1, 0): 1, (1, 1): 1, (1, 2): 2, (2, 0): 2, (2, 1): 2, (2, 2): 2}
    for edits in itertools.product(range(3), repeat=6):
        state = 0
        for k, e in enumerate(edits):
            state = step[state, e]
            assert state == max(edits[: k + 1])


def test_trajectory(spark):
    base = " ".join(f"w{i}" for i in range(20))
    rows = [(1, 0, base), (1, 1, base), (1, 2, base.replace("w3", "q3", 1)), (1, 3, base), (1, 4, " ".join(f"n{i}" for i in range(20)))]
    c = revisions.edit_classes(rev(spark, rows), F.lit(0), F.lit(500))
    t = revisions.trajectories(c).first()
    assert (t["state"], t["flag"]) == ("assimilated", "medium")
    assert [(h["revision_index"], h["state"]) for h in t["history"]] == [(0, "cold"), (2, "warm"), (4, "assimilated")]


def test_insertion(spark):
    rec = F.array(F.struct(F.lit("i").alias("injection_id"), F.lit(13).alias("start"), F.lit(" INJECTED").alias("body")))
    got = one(spark, spans.insert_all(F.lit("Sentence one. Sentence two."), rec))
    assert got["text"] == "Sentence one. INJECTED Sentence two." and (got["spans"][0]["start"], got["spans"][0]["end"]) == (13, 22)
    both = F.array(*(F.struct(F.lit(str(k)).alias("injection_id"), F.lit(s).alias("start"), F.lit(b).alias("body")) for k, (s, b) in enumerate([(5, "XX"), (0, "Y"), (99, "Z")])))
    got = one(spark, spans.insert_all(F.lit("abcdefg"), both))
    assert got["text"] == "abYcdeXXfgZ"


TRACE = "array<struct<status:string,repair_artifact:string,glucose_at_event:double,syntactic_complexity:double>>"


def traced(spark, events_):
    return spark.createDataFrame([(1, 0, "i", "injection.naive", "warm", "low", 0, 4, [tuple(e) for e in events_])], f"doc_id long, revision_index int, injection_id string, label string, state string, flag string, start int, end int, trace {TRACE}")


def test_signatures(spark):
    e = [("success", None, 1.0, 1.0), ("failure", None, 0.9, 2.0), ("success", None, 0.8, 5.0), ("repair", "fix", 0.7, 1.0), ("success", None, 0.6, 6.0), ("success", None, 0.5, 1.0)]
    got = traces.with_signatures(traced(spark, e)).first()
    assert got["locality"] == 2.0 and got["coupling"] == pytest.approx(0.973) and got["plausible"]
    none = traces.with_signatures(traced(spark, [])).first()
    assert (none["locality"], none["coupling"], none["plausible"]) == (0.0, 0.0, False)
    flat = traces.with_signatures(traced(spark, [("failure", None, 1.0, 1.0)] * 8)).first()
    assert flat["coupling"] == 0.0


def test_validation_rows(spark):
    s = traced(spark, [("success", None, 1.0, 1.0)])
    r = rev(spark, [(1, 0, "abc")])
    kinds = {x["error_type"] for x in spans.validate(s, r).collect()}
    assert kinds == {"boundary", "causal_integrity", "earned_ambiguity"}
    assert spans.monotonicity_violations(s).count() == 0


def test_simulation_never_leaves_its_bounds(spark):
    i = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.struct((k % 9).cast("double").alias("depth"), F.lit(0.9).alias("rarity"), F.lit(0.02).alias("cost")))
    got = one(spark, traces.simulate(i))
    g = [x["glucose_before"] for x in got]
    assert len(got) == 200 and all(b <= a for a, b in zip(g, g[1:], strict=False)) and min(g) >= 0.05 and any(x["failure"] == "lexical_starvation" for x in got)


# sessions


def test_sessions_against_a_loop(spark):
    rng = random.Random(8)
    rows, t = [], dt.datetime(2024, 1, 1)
    for k in range(400):
        t += dt.timedelta(minutes=rng.choice([0.1, 1, 5, 10, 10.5, 30]))
        rows.append((1, 7, t, k, rng.choice("abc")))
    log = spark.createDataFrame(rows, "project int, author long, ts timestamp_ntz, tie long, label string")
    for by_label in (False, True):
        want, start = [], 0
        for k in range(1, len(rows)):
            if rows[k][2] - rows[k - 1][2] > dt.timedelta(minutes=10) or (by_label and rows[k][4] != rows[k - 1][4]):
                want.append((start, k))
                start = k
        got = sessions.sessions(sessions.mark_sessions(log, label_breaks=by_label)).orderBy("session").collect()
        assert [g["n"] for g in got] == [b - a for a, b in [*want, (start, len(rows))]] and sum(g["n"] for g in got) == len(rows)
        strict = sessions.sessions(sessions.mark_sessions(log, label_breaks=by_label), strict=True).orderBy("session").collect()
        long = [(a, b) for a, b in want if (rows[b - 1][2] - rows[a][2]).total_seconds() > 60]
        assert [s["n"] for s in strict] == [b - a for a, b in long]
        assert [s["label_list"] for s in strict] == [[r[4] for r in rows[a + (a > 0) : b]] for a, b in long]


def test_fit_on_constant_x(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert sessions.linear_fit(df, F.col("y"), F.col("x")).first()["slope"] is None


def test_windows_may_be_fewer(spark):
    rows = [(1, 1, dt.datetime(2024, 1, 1, 0, k), k, "a") for k in range(12)]
    log = spark.createDataFrame(rows, "project int, author long, ts timestamp_ntz, tie long, label string")
    assert events.windowed_labels(log).count() == 6
    assert events.transitions(log).count() == 0 and events.runs(log).first()["length"] == 12


# screening and diffs


def test_pii(spark):
    df = spark.createDataFrame([(1, "Contact me at test@example.com for details."), (2, "Call 555-123-4567 or 078-05-1120, 10.0.0.1."), (3, "Table Of, Ada Lovelace met éAda Lovelace")], "doc_id long, text string")
    got = detect.pii_findings(df).collect()
    email = next(r for r in got if r["rule_id"] == "email")
    assert email["snippet"] == "...act me at test@example.com for detai..." and email["severity"] == "high"
    assert {r["rule_id"] for r in got if r["doc_id"] == 2} >= {"phone", "ssn", "ip_address"}
    assert [(r["span_start"], r["span_end"]) for r in got if r["doc_id"] == 3] == [(10, 22)]


def test_templates_and_harm(spark):
    df = spark.createDataFrame([(1, "So The Findings Indicate That it works"), (2, None)], "doc_id long, text string")
    assert [r["template"] for r in detect.flags(df).orderBy("doc_id").collect()] == [True, False]
    s = spark.createDataFrame([(1, 0, 0, "injection.naive", "naive", "cold"), (2, 0, 0, "anomaly.truncation", None, None)], "doc_id long, revision_index int, ord int, label string, level string, state string")
    p = spark.createDataFrame([(1, 0, True), (2, 0, False)], "doc_id long, revision_index int, hit boolean")
    got = {r["metric"]: r["value"] for r in metrics.harm(s, p).collect()}
    assert got == {"fpr_anomaly_truncation": 0.0, "sensitivity_level_naive": 1.0, "sensitivity_state_cold": 1.0}


def test_ncd(spark):
    rows = [(1, 0, "same text " * 50), (1, 1, "same text " * 50), (1, 2, "".join(chr(97 + random.Random(i).randint(0, 25)) for i in range(500)))]
    got = [r["ncd"] for r in detect.discontinuity(rev(spark, rows)).orderBy("revision_index").collect()]
    assert got[0] == 0.0 and got[1] < 0.35 < 0.8 < got[2] <= 1.0


def test_diffs():
    assert diffs.indel_ratio("", "") == 1.0 and diffs.indel_ratio("a", "") == 0.0
    assert diffs.indel_ratio("kitten", "sitting") == pytest.approx(2 * 4 / 13)
    assert diffs.changed_spans("a b c d", "a x c d e") == [(1, 2), (4, 4)]
    assert diffs.span_f1([(0, 2)], [(1, 3)]) == pytest.approx(1.0) and diffs.span_f1([(4, 4)], [(4, 4)]) == 0.0
    assert diffs.tagged("a b", "a c") == "<same>a</same><del>b</del><add>c</add>"


def test_word_changes():
    assert diffs.word_changes([(0, "the c"), (-1, "a"), (1, "o"), (0, "t sat")]) == ["(0,4), cat->cot"]
    assert diffs.word_changes([(0, "a\nb "), (1, "new"), (0, " c")], 3) == ["(4,2), new---added"]
    assert diffs.word_changes([(0, "a "), (-1, "gone"), (4, "copied"), (0, " c")]) == ["(0,2), gone---deleted"]
    assert diffs.word_changes([(0, "same")]) == []


def test_knee():
    assert metrics.knee_point([0, 1, 2, 3, 4, 5, 6], [100, 40, 15, 10, 8, 7, 6]) == 2
    assert metrics.knee_point([0, 1], [1, 0]) is None


def test_replies_and_patterns(spark):
    got = one(spark, T.split_reply(lit("a b\n------\nc")))
    assert (got["first"], got["second"]) == ("a b", "c") and one(spark, T.split_reply(lit("x")))["second"] is None
    assert [r["role"] for r in one(spark, T.instruction_rows(lit("s"), lit(None), lit("a")))] == ["system", "user", "assistant"]
    assert one(spark, T.pattern_score(lit("Model-Large 70B"), {"large": 2, r"\d+b": 3, "mini": 9})) == 5.0
    assert one(spark, T.first_pattern(lit("abc"), {"c": "third", "a": "first"})) == "third"
    # the patterns that stand in for a missing file are lazy: they take as little as they can
    assert one(spark, T.strip_meta(lit('Here is the text:\n"quoted"'))) == 'the text:\n"quoted"'
    assert one(spark, T.strip_meta(lit('Here is the text:\n"quoted"'), (r"^Here is .*:\s*$",))) == "quoted"
    assert one(spark, T.content_quality(lit("short"))) == "too_short_chars:5"
    assert one(spark, T.escape_tex(lit("a_b{"))) == "a\\_b\\{"


def test_marks_and_selections(spark):
    text = "One. Two <b> three! Four"
    span = F.array(F.struct(F.lit(5).alias("start"), F.lit(8).alias("end"), F.lit("i").alias("id"), F.lit(None).cast("string").alias("state")))
    assert one(spark, T.highlight(lit(text), span)) == 'One. <mark data-state="unknown" data-id="i">Two</mark> &lt;b&gt; three! Four'
    got = one(spark, T.whole_sentence(lit(text), F.lit(10), F.lit(12)))
    assert text[got["start"] : got["end"]] == " Two <b> three!"
    assert one(spark, T.paragraph_numbers(lit("a\nb\n\nc\n\\paragraph{x}\nd"))) == [1, 1, 0, 2, 3, 3]
