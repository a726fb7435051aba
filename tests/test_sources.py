"""Sources, sinks and streams: round trips in a temporary folder."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from draftlens.operators import revisions
from draftlens.sources import readers, sinks
from draftlens.streaming import events as stream


def test_documents_round_trip(spark, tmp_path):
    edits = spark.createDataFrame([(1, 2000, 1, "a", " b\r\n", "Clarity", "revision"), (1, 1000, 0, None, None, "Fluency", None), (2, 5, 0, "x", "é", "Clarity", "g")], "project int, timestamp long, tie int, before_text string, after_text string, label string, high_level string")
    built = revisions.build_documents(edits).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssxxx")).drop("ts")
    docs = sinks.nest_revisions(built)
    path = str(tmp_path / "docs")
    sinks.write_documents(docs, path)
    good, bad = readers.read_jsonl(spark, path, readers.SEED_DOCUMENT)
    assert bad.count() == 0
    back = {(r["doc_id"], r["revision_index"]): r["text"] for r in readers.explode_revisions(good).collect()}
    assert back == {(r["doc_id"], r["revision_index"]): r["text"] for r in built.collect()} and len(back) == 3
    sinks.append_documents(docs, path)
    assert readers.line_count(spark, path) == 4
    assert readers.unfinished(docs, docs.limit(1)).count() == 1


def test_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"doc_id": "a", "revisions": []}\n{broken\n\n{"doc_id": "b"}\n')
    good, bad = readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), readers.SEED_DOCUMENT)
    assert sorted(r["doc_id"] for r in good.collect()) == ["a", "b"] and [r["line"] for r in bad.collect()] == ["{broken"]


def test_sequences_splits_and_checksums(spark, tmp_path):
    for k, v in ((2, "two \n"), (10, "ten"), (1, "one")):
        (tmp_path / f"iter_{k}.txt").write_text(v)
    assert [(r["idx"], r["value"]) for r in readers.read_sequence(spark, str(tmp_path)).orderBy("idx").collect()] == [(1, "one"), (2, "two"), (10, "ten")]
    sums = {r["path"].rsplit("/", 1)[1]: r["checksum"] for r in readers.checksums(spark, str(tmp_path), "iter_*").collect()}
    assert sums["iter_10.txt"] == "sha256:" + hashlib.sha256(b"ten").hexdigest()
    (tmp_path / "d").mkdir()
    spark.range(3).toPandas().to_parquet(tmp_path / "d/train-0.parquet")
    spark.range(9).toPandas().to_parquet(tmp_path / "d/val-0.parquet")
    assert readers.read_split(spark, str(tmp_path / "d"), "train").count() == 3
    with pytest.raises(ValueError):
        readers.read_split(spark, str(tmp_path), "nope")


def test_last_write_wins(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "only")], "key string, line int, v string")
    assert sorted(r["v"] for r in readers.last_by_key(df, ["key"], "line").collect()) == ["new", "only"]


def test_metrics_sink(spark, tmp_path):
    sinks.write_metrics(spark.createDataFrame([("b", 2.0), ("a", 1.0)], "metric string, value double"), str(tmp_path / "m"))
    assert [r["metric"] for r in spark.read.option("header", "true").csv(str(tmp_path / "m/csv")).collect()] == ["a", "b"]


def test_stream(spark, tmp_path):
    rows = [{"timestamp": 1_700_000_000_000 + 60_000 * k, "project": p, "username": "u", "onkey": "copy" if k == 1 else None} for k in (0, 1, 2, 30, 31) for p in ("yes", "no")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(r) for r in rows))
    consent = spark.createDataFrame([("yes",)], "project string")
    got = stream.ingest(stream.read_events(spark, str(tmp_path / "in")), consent)
    q = stream.append_to(got.select("project", "kind", "line", "message", "ts"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 5 and out.filter("kind = 'copy'").count() == 1 and {r["message"] for r in out.collect()} == {"No Message"}
    assert sorted(r["n"] for r in stream.gap_sessions(out).collect()) == [2, 3]
    s = stream.gap_sessions(got).writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert [r["n"] for r in spark.table("sessions_out").collect()] == [3]  # the later session is still open
    assert [r["n"] for r in stream.windowed_counts(out, "1 day").collect()] == [5]


def test_scratch_tables(spark, tmp_path, monkeypatch):
    import pytest

    from draftlens import session

    made = session.materialize(spark.range(5), "test")
    path = made.inputFiles()[0].rsplit("/", 1)[0]
    assert session.is_written(spark, path) and made.count() == 5
    session.remove(spark, path)
    assert not session.is_written(spark, path)

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Elsewhere)


def test_spread_leaves_large_tables(spark, tmp_path):
    from draftlens import session

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    assert session.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(one, 10).rdd.getNumPartitions() == one.rdd.getNumPartitions()
