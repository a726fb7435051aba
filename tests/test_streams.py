"""Stateful sessions against the batch operator, upserts that are replayed, consent withdrawn between batches."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from draftlens.operators import sessions
from draftlens.streaming import tables
from draftlens.streaming.sessions import stream_sessions

EDIT = "project int, ts timestamp, tie long, label string, likeness double"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def edits(seed, n=240):
    rnd, out, minute = random.Random(seed), [], 0.0
    for k in range(n):
        minute += rnd.choice([0, 0.25, 1, 3, 9.5, 10, 10.5, 45])
        out.append((rnd.choice([1, 1, 1, 2, 3]), minute, k, rnd.choice("ab"), rnd.choice([None, 0.1, 0.8, 0.9, 0.95])))
    return out


def stamp(minute):
    return f"2024-01-{1 + int(minute // 1440):02d}T{int(minute // 60) % 24:02d}:{int(minute) % 60:02d}:{minute % 1 * 60:06.3f}Z"


def write_files(folder, rows, files):
    """Rows as JSON files, shuffled within each; a last one moves the watermark on."""
    folder.mkdir()
    size = -(-len(rows) // files)
    for k in range(files):
        part = rows[k * size : (k + 1) * size]
        random.Random(k).shuffle(part)
        (folder / f"{k:03d}.json").write_text("\n".join(json.dumps({"project": p, "ts": stamp(m), "tie": t, "label": x, "likeness": s}) for p, m, t, x, s in part))


def dated(folder):
    """Files are read in the order of their times, which are a second apart."""
    for k, name in enumerate(sorted(os.listdir(folder))):
        os.utime(folder / name, (1_700_000_000 + k, 1_700_000_000 + k))


def streamed(spark, folder, target, name, **how):
    dated(folder)
    source = spark.readStream.schema(EDIT).option("maxFilesPerTrigger", 1).json(str(folder))
    found = stream_sessions(source, **how)
    run = found.writeStream.format("parquet").option("path", str(target / "out")).option("checkpointLocation", str(target / "check")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(str(target / "out"))


@pytest.mark.parametrize(("label_breaks", "least"), [(False, None), (True, 0.5)])
def test_stream_sessions_are_the_batch_sessions(rocks, tmp_path, label_breaks, least):
    """Files shuffled within themselves: same sessions and causes, however the rows come in; the open ones close by the watermark."""
    rows = edits(5)
    later = [(9, rows[-1][1] + m, 10_000 + m, "z", None) for m in (200, 400, 600)]
    folder = tmp_path / "in"
    write_files(folder, rows, 6)
    for k, r in enumerate(later):
        (folder / f"9{k}.json").write_text(json.dumps({"project": r[0], "ts": stamp(r[1]), "tie": r[2], "label": r[3], "likeness": r[4]}))
    got = streamed(rocks, folder, tmp_path, "sessions", label_breaks=label_breaks, least_similarity=least, late="90 minutes")
    log = rocks.createDataFrame([(p, stamp(m), t, x, s) for p, m, t, x, s in rows], "project int, at string, tie long, label string, likeness double")
    log = log.select("project", F.to_timestamp("at").alias("ts"), "tie", "label", "likeness")
    marked = sessions.mark_sessions(log, label_breaks=label_breaks, similarity="likeness" if least else None, least_similarity=least or 0)
    want = sessions.sessions(marked).select("project", "session", "start_ts", "end_ts", "n", "label", F.coalesce("closed_by", F.lit("gap")).alias("closed_by"))
    order = lambda df: sorted(tuple(r) for r in df.filter("project <> 9").collect())
    assert order(got) == order(want)


def test_late_rows_are_left_out_and_idle_state_expires(rocks, tmp_path):
    from datetime import timedelta

    folder = tmp_path / "in"
    folder.mkdir()
    steps = [[(1, 0.0, 1)], [(1, 1.0, 2)], [(2, 300.0, 3)], [(2, 301.0, 5)], [(1, 2.0, 4), (2, 5000.0, 6)], [(2, 5001.0, 7)], [(1, 6000.0, 8)], [(2, 9000.0, 9)], [(2, 9500.0, 10)]]
    for k, part in enumerate(steps):
        (folder / f"{k:03d}.json").write_text("\n".join(json.dumps({"project": p, "ts": stamp(m), "tie": t, "label": "a"}) for p, m, t in part))
    got = streamed(rocks, folder, tmp_path, "late", late="10 minutes", keep=timedelta(hours=24)).filter("project = 1").orderBy("start_ts").collect()
    # the edit at 2.0 is behind the watermark; after a day without edits a project is forgotten, and numbers begin anew
    assert [(r["session"], r["n"], r["closed_by"]) for r in got] == [(0, 2, "gap"), (0, 1, "gap")]


def test_upserts_can_be_replayed(spark, tmp_path):
    path = str(tmp_path / "table")
    batch = lambda rows: spark.createDataFrame(rows, "k int, v string, at long")
    first, second = batch([(1, "a", 1), (1, "b", 3), (2, "c", 1)]), batch([(1, "late", 2), (2, "d", 2), (3, None, 1)])
    state = lambda: sorted((r["k"], r["v"]) for r in tables.read_upserted(spark, path, ["k"], "at").collect())
    with pytest.raises(FileNotFoundError):
        state()
    tables.upsert_batch(first, 0, path, ["k"], "at")
    tables.upsert_batch(second, 1, path, ["k"], "at")
    want = [(1, "b"), (2, "d"), (3, None)]
    assert state() == want
    for n, rows in ((1, second), (0, first)):
        tables.upsert_batch(rows, n, path, ["k"], "at")
        assert state() == want
    tables.compact(spark, path, ["k"], "at")
    assert state() == want
    tables.upsert_batch(first, 0, path, ["k"], "at")  # folded in, so it is passed over
    assert state() == want
    tables.upsert_batch(batch([(1, "new", 9)]), 2, path, ["k"], "at")
    assert state() == [(1, "new"), (2, "d"), (3, None)]


def test_consent_is_read_with_each_batch(spark, tmp_path):
    folder, path, consent = tmp_path / "in", str(tmp_path / "table"), tmp_path / "consent"
    folder.mkdir(), consent.mkdir()
    put = lambda k, rows: (folder / f"{k}.json").write_text("\n".join(json.dumps({"project": p, "k": i, "at": a}) for p, i, a in rows))
    allow = lambda *projects: (consent / "now.json").write_text("\n".join(json.dumps({"project": p}) for p in projects))

    def run():
        source = spark.readStream.schema("project int, k int, at long").json(str(folder))
        now = lambda s: s.read.schema("project int").json(str(consent))
        tables.upsert_stream(source, path, str(tmp_path / "check"), ["project", "k"], "at", now).awaitTermination()
        return sorted((r["project"], r["k"], r["at"]) for r in tables.read_upserted(spark, path, ["project", "k"], "at").collect())

    allow(1, 2)
    put(0, [(1, 1, 1), (2, 1, 1), (3, 1, 1)])
    assert run() == [(1, 1, 1), (2, 1, 1)]
    allow(1, 3)
    put(1, [(1, 1, 2), (2, 1, 2), (3, 1, 2)])
    assert run() == [(1, 1, 2), (2, 1, 1), (3, 1, 2)]
    assert run() == [(1, 1, 2), (2, 1, 1), (3, 1, 2)]
