"""Queries without SQL against plain loops over the same rows, and rules on cases of their own."""

from __future__ import annotations

import difflib
import re
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from draftlens import vocab
from draftlens.functions import text as T
from draftlens.operators import events, metrics, revisions, spans
from draftlens.plans import registry

SF = "/root/testdata/sf0.001"
Q = registry.queries()


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def turns(spark):
    rows = sorted((r["conv_id"], r["turn"], r["text"] or "") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect())
    return [(c, t, x, rows[k - 1][2] if k and rows[k - 1][0] == c else None) for k, (c, t, x) in enumerate(rows)]


def plain_sentences(text):
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text) if s.strip()]


def test_sentence_counts(spark, docs):
    got = {r["doc_id"]: r["n_sentences"] for r in Q["sentence_counts"](spark, SF).collect()}
    assert got == {i: len(plain_sentences(t)) for i, t in docs.items()}


def test_sentence_offsets(spark, docs):
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("p", T.sentences(F.col("text")))
    for r in rows.select("doc_id", T.sentence_offsets(F.col("text"), F.col("p")).alias("o")).collect():
        text, at, want = docs[r["doc_id"]], 0, []
        for s in plain_sentences(text):
            begin = text.find(s, at)
            begin = at if begin < 0 else begin
            at = begin + len(s)
            want.append((begin, at))
        assert [tuple(o) for o in r["o"]] == want


def test_conceptual_ruptures(spark, docs):
    marks = re.compile(r"(?a:\b(" + "|".join(vocab.DISCOURSE_MARKERS) + r")\b)")
    got = {}
    for r in Q["conceptual_ruptures"](spark, SF).collect():
        got.setdefault(r["doc_id"], []).append(r["at"])
    for i, text in docs.items():
        w, found = text.split(), set()
        for k in range(50, len(w) - 50, 25) if len(w) - 50 > 50 else ():
            rare = [sum(len(x) > 8 for x in part) for part in (w[k : k + 50], w[k - 50 + 1 - 1 : k])]
            if abs(rare[0] - rare[1]) / 50 > 0.28 or marks.search(" ".join(w[k : k + 15]).lower()):
                found.add(len(" ".join(w[:k])) + 1)
        assert sorted(got[i]) == (sorted(found) if found and len(w) >= 100 else [len(text) // 2])


def test_pii_findings(spark, docs):
    n = 0
    for r in Q["pii_findings"](spark, SF).collect():
        row = r.asDict()
        text, n = docs[row["doc_id"]], n + 1
        pattern = {**vocab.PII_STRICT, **vocab.PII_HEURISTIC}[row["rule_id"]]
        assert re.fullmatch(pattern, text[row["span_start"] : row["span_end"]])
    want = 0
    for text in docs.values():
        for rule, pattern in {**vocab.PII_STRICT, **vocab.PII_HEURISTIC}.items():
            found = [m[0] for m in re.finditer(pattern, text)]
            want += sum(rule in vocab.PII_STRICT or not m.startswith(tuple(vocab.PII_NOT_NAMES)) for m in found)
    assert n == want


def test_paragraph_lines(spark, docs):
    head = re.compile(r"^\s*\\(?:paragraph|subsection|subsubsection)\{")
    for r in Q["paragraph_lines"](spark, SF).collect():
        lines, n, most, open_ = docs[r["doc_id"]].split("\n"), 0, 0, False
        for line in lines:
            blank = line.strip(" ") == ""
            n += not blank and (not open_ or bool(head.match(line)))
            most, open_ = max(most, 0 if blank else n), not blank
        assert (r["n_lines"], r["n_paragraphs"]) == (len(lines), most)


def plain_ncd(a, b):
    if not a:
        return 0.0
    size = lambda s: len(zlib.compress(s.encode()))
    x, y = size(a), size(b)
    return min(1.0, max(0.0, (size(f"{a} {b}") - min(x, y)) / max(x, y)))


def test_compression(spark, turns):
    want = {(str(c), t): plain_ncd(before or "", x) for c, t, x, before in turns}
    for name in ("ncd_discontinuity", "compression_anomalies"):
        rows = Q[name](spark, SF).collect()
        assert {(r["doc_id"], r["revision_index"]): r["ncd"] for r in rows} == pytest.approx(want)
    assert all(r["anomalous"] == (r["ncd"] > vocab.NCD_CUT) for r in rows)


def test_baselines(spark, turns):
    rows = [(t % 2 == 0, plain_ncd(b or "", x), t / 10) for _, t, x, b in turns if t > 0]

    def auc(place):
        pos, neg = ([r[place] for r in rows if r[0] == y] for y in (True, False))
        return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))

    hit = sum(y and s > vocab.NCD_CUT for y, s, _ in rows)
    f1 = 2 * hit / max(1, sum(s > vocab.NCD_CUT for _, s, _ in rows) + sum(y for y, _, _ in rows))
    got = {r["metric"]: r["value"] for r in Q["baseline_scores"](spark, SF).collect()}
    assert got == pytest.approx({"ncd_auc": auc(1), "causal_coupling_auc": auc(2), "overall_f1": f1}, abs=1e-4)


def test_revision_diffs(spark, turns):
    def indel(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for k, y in enumerate(b, 1):
                last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
        return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0

    got = {r["key"]: r for r in Q["revision_diffs"](spark, SF).collect()}
    pairs = {f"{c}:{t}": (before, x) for c, t, x, before in turns if before is not None}
    assert set(got) == set(pairs)
    for key in sorted(pairs)[:40]:
        a, b = pairs[key]
        assert got[key]["ratio"] == pytest.approx(indel(a, b), abs=1e-5)
        blocks = [o for o in difflib.SequenceMatcher(None, a.split(), b.split(), autojunk=False).get_opcodes() if o[0] in ("insert", "replace")]
        assert (got[key]["n_spans"] > 0) == bool(blocks)


def test_stand_in_signatures(spark):
    rows = Q["stand_in_signatures"](spark, SF).collect()
    assert rows and all(0.05 <= r["glucose"] <= 1 and 0 <= r["fatigue"] <= 1 and r["repairs"] >= 0 and r["plausible"] == (1.0 <= r["locality"] <= 3.5 and abs(r["coupling"]) >= 0.6) for r in rows)


# rules


def test_composed_text(spark):
    parts = ["e\u0301", "\u00e9", "A\u030a", "plain", "", None, "\u1112\u1161\u11ab", "\u212b"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(parts)], "k int, x string")
    got = {r["k"]: r for r in df.select("k", T.nfc(F.col("x")).alias("n"), T.provenance_hash(F.col("x"), T.nfc(F.col("x"))).alias("h")).collect()}
    assert [got[k]["n"] for k in range(len(parts))] == [None if p is None else unicodedata.normalize("NFC", p) for p in parts]
    assert got[0]["h"] == got[1]["h"]
    # texts that composition leaves alone are not sent to Python: the condition is in the argument
    plan = df.select(T.nfc(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "composed(CASE WHEN" in plan or "composed(if" in plan


SPAN = "doc_id long, revision_index int, injection_id string, label string, start int, end int, start_sentence int, end_sentence int, state string, flag string"


def test_boundaries_and_sentences(spark):
    rows = [
        (1, 0, "a", "injection.naive", 0, 3, 0, 0, "cold", "none"),
        (1, 0, "b", "injection.naive", -1, 9, -1, 0, "cold", "none"),
        (1, 0, "c", "injection.naive", 3, 2, 2, 1, "cold", "none"),
    ]
    r = spark.createDataFrame([(1, 0, "abcd")], "doc_id long, revision_index int, text string")
    s = spark.createDataFrame(rows, SPAN)
    got = sorted((x["injection_id"], x["message"]) for x in spans.boundary_violations(s, r).collect())
    assert got == [
        ("b", "end 9 exceeds text length 4"),
        ("b", "start -1 is negative"),
        ("b", "start sentence -1 is negative"),
        ("c", "start lies after end"),
        ("c", "start sentence lies after end sentence"),
    ]
    traced = s.withColumn("trace", F.array().cast("array<struct<status:string,repair_artifact:string,glucose_at_event:double,syntactic_complexity:double>>"))
    once = spans.revision_violations(traced, r).collect()
    assert [(x["injection_id"], x["message"]) for x in once] == [("b", "Offset out of bounds")]


def test_traces_that_do_not_suffice(spark):
    one = ("failure", "x", 1.0, 2.0)
    rows = [(1, 0, i, "injection.naive", 0, 1, state, flag, [one] * n) for i, state, flag, n in (("a", "warm", "low", 2), ("b", "warm", "none", 3), ("c", "assimilated", "high", 4), ("d", "assimilated", "medium", 5), ("e", "cold", "none", 0), ("f", "assimilated", "high", 0))]
    s = spark.createDataFrame(rows, "doc_id long, revision_index int, injection_id string, label string, start int, end int, state string, flag string, trace array<struct<status:string,repair_artifact:string,glucose_at_event:double,syntactic_complexity:double>>")
    assert sorted(r["injection_id"] for r in spans.trace_sufficiency_violations(s).collect()) == ["a", "c", "f"]
    got = sorted((r["injection_id"], r["message"]) for r in spans.coupling_flag_violations(s).collect())
    assert got == [("c", "high requires coupling 0.5"), ("d", "medium requires coupling 0.3"), ("f", "high requires a trace")]


def test_two_empty_sides_agree(spark):
    none = spark.createDataFrame([], "doc_id long, start int, end int")
    one = spark.createDataFrame([(1, 0, 4)], "doc_id long, start int, end int")
    assert [r["iou"] for r in spans.iou(none, none).collect()] == [1.0]
    assert [r["iou"] for r in spans.iou(one, none).collect()] == [0.0]
    every = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert {r["doc_id"]: r["iou"] for r in spans.iou(one, none, "doc_id", every=every).collect()} == {1: 0.0, 2: 1.0}


def test_missing_revisions(spark):
    rows = [(1, k, f"text of number {k // 2}") for k in (0, 1, 3, 4, 7)]
    got = {r["revision_index"]: r["anomaly"] for r in revisions.anomalies(spark.createDataFrame(rows, "doc_id long, revision_index int, text string")).collect()}
    assert [got[k] for k in (0, 1, 3, 4, 7)] == [None, None, "anomaly.missing_revision", None, "anomaly.missing_revision"]


def test_fewer_windows_than_ten(spark):
    log = spark.createDataFrame([(1, "a", 0, 1), (1, "b", 1, 1), (1, "a", 2, 1)], "project int, label string, win int, n long")
    got = {r["label"]: r["w1"] for r in events.uniform_distance(log).collect()}
    assert got == {"a": round((abs(0.5 - 1 / 3) * 2 + 1 / 3) / 3, 6), "b": round((2 / 3 + 1 / 3 * 2) / 3, 6)}


def plain_models(rows, k, cap, limit, budget=True):
    """rows: (key, vendor, priority, score, cost)."""
    by, chosen, count = {}, [], {}
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        by.setdefault(r[1], []).append(r)
    vendors = sorted(by, key=lambda v: (min(r[2] for r in by[v]), v))

    def take(r):
        chosen.append(r[0])
        count[r[1]] = count.get(r[1], 0) + 1

    for v in vendors:
        if len(chosen) < k:
            for r in (r for r in by[v] if limit is None or r[4] <= limit):
                take(r)
                break
    for v in vendors[:6]:
        for r in by[v][1:]:
            if len(chosen) < k and (limit is None or r[4] <= limit) and r[0] not in chosen and count.get(v, 0) < cap:
                take(r)
    for r in sorted(rows, key=lambda r: (r[4], -r[3], r[0])) if budget else ():
        if len(chosen) < k and r[0] not in chosen and count.get(r[1], 0) < cap:
            take(r)
    return chosen


@pytest.mark.parametrize("k,cap,limit", [(5, 3, None), (12, 3, 6.0), (40, 2, 6.0), (9, 1, 2.0)])
def test_model_selection(spark, k, cap, limit):
    rows = [(i, f"v{i * 7 % 9}", i * 7 % 9 % 5, 100 - i * 13 % 31, float(i * 5 % 11)) for i in range(45)]
    df = spark.createDataFrame(rows, "key int, vendor string, priority int, score int, cost double")
    assert [r["key"] for r in metrics.select_models(df, k, cap, limit).collect()] == plain_models(rows, k, cap, limit)


def test_sessions_are_one_pass(spark):
    """Two readings of the log, its rows and the table of edges; twice that where the sessions kept are numbered."""
    for name, most in (("sessions_gap", 2), ("label_runs", 2), ("intention_sessions", 4)):
        plan = Q[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= most


def test_erosion_of_moving_spans(spark):
    """Runs of equal edges, edges that come back, gaps in the numbers, spans of no size and a span that is seen once."""
    edges = {"a": [(0, 10), (0, 10), (2, 10), (2, 14), (0, 10), (0, 10)], "b": [(5, 5), (5, 6), (5, 5)], "c": [(1, 4)], "d": [(0, 100)] * 4}
    rows = [(1, 2 * k, i, s, e) for i, held in edges.items() for k, (s, e) in enumerate(held)]
    got = {(r["injection_id"], r["revision_index"]): (r["erosion"], r["n_later"]) for r in spans.erosion(spark.createDataFrame(rows, "doc_id long, revision_index int, injection_id string, start int, end int")).collect()}
    want = {}
    for i, held in edges.items():
        for k, (s, e) in enumerate(held[:-1]):
            moved = [(abs(s2 - s) + abs(e2 - e)) / max(e - s, 1) for s2, e2 in held[k + 1 :]]
            want[i, 2 * k] = (round(min(1.0, sum(moved) / len(moved)), 6), len(moved))
    assert got == want
