"""Places in texts by one walk, medians by ranges, totals by cuts, the manifest of files, and plans without a task for all rows."""

from __future__ import annotations

import random
import statistics
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from draftlens import vocab
from draftlens.functions import text as T
from draftlens.operators import events, metrics, ordering, revisions
from draftlens.plans import registry

ODD = ["", " ", "One. Two! Three", ". A. B", "no stop", "  Lead. Next?  Last.  ", "A.\n\nB.\u00a0C", "x\x00y. Z", "Mail a@b.co or c@d.org. Call", "é. É. Ê", "...  A  ..."]


def test_offsets_by_walk_are_those_by_search(spark, sf):
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    rows = texts.select("text", T.sentence_offsets(F.col("text")).alias("walk"), T.offsets_of(F.col("text"), T.sentences(F.col("text"))).alias("search"))
    for r in rows.collect():
        assert r["walk"] == r["search"], r["text"]


def test_running_ends(spark):
    lists = [[], [3], [0, 0], list(range(1, 50)), [7] * 101]
    got = spark.createDataFrame([(x,) for x in lists], "x array<int>").select(T.running_ends(F.col("x")).alias("e")).collect()
    assert [r["e"] for r in got] == [[sum(x[: k + 1]) for k in range(len(x))] for x in lists]


def test_personal_data_places(spark):
    text = "Write to Ann.Lee@mail.example.org, or to bob@x.org; call +1 555 123 4567. "
    df = spark.createDataFrame([(text * 3,), ("",), (None,)], "text string")
    for rule in (*vocab.PII_STRICT, *vocab.PII_HEURISTIC):
        for r in df.select("text", T.pii_matches(F.col("text"), rule).alias("m"), T.pii_places(F.col("text"), rule).alias("p")).collect():
            assert [r["text"][p["start"] : p["end"]] for p in r["p"]] == r["m"]


def test_walks_are_linear(spark):
    """Ten times the text takes about ten times as long, not a hundred times; a million characters take seconds."""
    unit = "Some words stand here. Mail to ann@mail.org now! "
    took = []
    for n in (2_100, 21_000):
        df = spark.createDataFrame([(unit * n,)], "text string")
        pick = [F.size(T.sentence_offsets(F.col("text"))), F.size(T.paragraph_numbers(F.replace("text", F.lit("!"), F.lit("\n")))), *(F.size(T.pii_places(F.col("text"), r)) for r in vocab.PII_STRICT)]
        df.select(*pick).collect()
        began = time.time()
        row = df.select(*pick).collect()[0]
        took.append(time.time() - began)
        assert row[0] == 2 * n and row[1] == n + 1
    assert took[1] < 40 and took[1] < 40 * max(took[0], 0.2)


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_exact_median(spark, keys):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 1, 2]), rnd.choice([None, 0.5, 1e9, rnd.random(), rnd.random()])) for _ in range(501)] + [(3, None), (4, 2.0), (4, 8.0)] + [(5, 7.0)] * 400
    got = ordering.exact_median(spark.createDataFrame(rows, "k int, v double"), F.col("v"), "m", *keys).collect()
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k if keys else 0, []).append(v)
    assert {(r["k"] if keys else 0): r["m"] for r in got} == {k: pytest.approx(statistics.median(v)) for k, v in groups.items()}


def test_cut_orders(spark):
    """Least sums, last values and totals across cuts are those of a loop."""
    rnd, begin = random.Random(4), datetime(2024, 1, 1)
    rows = [(rnd.choice([1, 1, 2]), begin + timedelta(hours=rnd.randrange(300)), k, rnd.randrange(-3, 4), rnd.choice([None, "a", "b"])) for k in range(400)]
    df = spark.createDataFrame(rows, "project int, ts timestamp, tie long, v int, s string")
    out = ordering.last_before(ordering.running_least(df, F.col("v"), "least", "project"), F.col("s"), "last", "project")
    got = {r["tie"]: (r["least"], r["last"]) for r in out.collect()}
    for p in (1, 2):
        least, last = None, None
        for _, _, tie, v, s in sorted((r for r in rows if r[0] == p), key=lambda r: (r[1], r[2])):
            least = v if least is None else min(least, v)
            assert got[tie] == (least, last)
            last = s or last


def test_active_totals(spark):
    rev = [(d, i) for d in (1, 2) for i in range(0, 30, 3)]
    born = [(1, 4, 10), (1, 4, 5), (1, 29, 1), (2, 0, 7), (9, 1, 1)]
    got = revisions.active_totals(spark.createDataFrame(rev, "doc_id long, revision_index int"), spark.createDataFrame(born, "doc_id long, born int, size int"), grain=4).collect()
    want = {}
    for d, i in rev:
        held = [s for e, b, s in born if e == d and b <= i]
        if held:
            want[d, i] = (len(held), sum(held))
    assert {(r["doc_id"], r["revision_index"]): (r["n_active"], r["chars"]) for r in got} == want


def test_documents_are_composed(spark):
    edits = [(1, 1_000, 1, "e\u0301", "cafe\u0301  ", "a", None), (1, 2_000, 2, None, "A\u030a", "b", None), (1, 90_000_000, 3, "", "late", "c", None)]
    rows = revisions.build_documents(spark.createDataFrame(edits, "project int, timestamp long, tie long, before_text string, after_text string, label string, high_level string")).orderBy("revision_index").collect()
    assert [(r["revision_index"], r["text"], r["before_text"]) for r in rows] == [(0, "caf\u00e9", "\u00e9"), (1, "\u00c5", ""), (2, "late", "")]


@pytest.mark.parametrize("name", ["gap_stats", "session_duration_stats", "calibration_report", "cosine_consecutive", "merged_runs", "edit_stream_tokens"])
def test_no_task_for_all_rows(spark, sf, name):
    """Windows stand on keys with their cuts, or on tables of a row a cut: none above scanned rows has a project, label or constant alone."""
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan()

    def walk(node, aggregated):
        here = node.nodeName()
        below = aggregated or here in ("Aggregate",)
        if here == "Window":
            keys = node.partitionSpec().mkString(",")
            over_rows = not has_aggregate(node)
            assert not over_rows or "_bucket" in keys or "_part" in keys or "author" in keys, (name, keys)
        for k in range(node.children().size()):
            walk(node.children().apply(k), below)

    def has_aggregate(node):
        return node.nodeName() == "Aggregate" or any(has_aggregate(node.children().apply(k)) for k in range(node.children().size()))

    walk(plan, False)


def test_similarity_sessions_query(spark, sf):
    """Sessions that an unlike edit begins, against a loop."""
    log = events.edit_log(spark.read.parquet(f"{sf}/events.parquet")).orderBy("project", "ts", "tie").collect()
    want, before, session = {}, None, {}
    for r in log:
        p = r["project"]
        if before is None or before["project"] != p:
            session[p], start = 0, True
        else:
            gap = (r["ts"] - before["ts"]).total_seconds() / 60 > 10
            top = max(r["value"], before["value"])
            session[p] += gap or (min(r["value"], before["value"]) / top if top else 1.0) < 0.5
        want[p, session[p]] = want.get((p, session[p]), 0) + 1
        before = r
    got = registry.queries()["sessions_similarity"](spark, sf).collect()
    assert {(r["project"], r["session"]): r["n"] for r in got} == want


def test_selected_spans(spark):
    """No two overlap, the draw is that of a loop, and it is the same again."""
    rnd = random.Random(6)
    rows = [(d, s, s + rnd.randrange(0, 12), rnd.randrange(5)) for d in range(6) for s in (rnd.randrange(60) for _ in range(40))] + [(9, 3, 3, 1)]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, priority int")
    got = {}
    for r in metrics.select_spans(df, 5, 17).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    import hashlib

    for d in range(6):
        own = sorted({(-p, hashlib.sha256(f"17:{d}:{s}:{e}".encode()).hexdigest(), s, e) for i, s, e, p in rows if i == d and e > s})
        kept = []
        for _, _, s, e in own:
            if len(kept) < 5 and not any(s < b and a < e for a, b in kept):
                kept.append((s, e))
        assert got[d] == kept
    assert 9 not in got


def test_manifest(spark, tmp_path):
    from draftlens.sources import readers, sinks

    folder = tmp_path / "artifacts"
    (folder / "sub").mkdir(parents=True)
    for name, data in (("a.txt", b"one"), ("sub/b.bin", bytes(range(256)) * 50), ("c.txt", b"c"), ("d.txt", b"d")):
        (folder / name).write_bytes(data)
    manifest = str(tmp_path / "manifest")
    sinks.write_manifest(spark, str(folder), manifest)
    state = lambda: {r["path"]: r["state"] for r in readers.verify_manifest(spark, str(folder), manifest).collect()}
    assert state() == {}
    (folder / "a.txt").write_bytes(b"two")
    (folder / "c.txt").unlink()
    (folder / "sub/new.txt").write_bytes(b"n")
    assert state() == {"a.txt": "changed", "c.txt": "missing", "sub/new.txt": "extra"}
