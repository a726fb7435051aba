"""Registered queries on texts longer than any bound that once cut them, against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from draftlens import vocab
from draftlens.operators import traces
from draftlens.plans import registry


def folder(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def long_texts(n_words=(0, 1, 59, 60, 61, 400, 3000)):
    rng = random.Random(5)
    return [(k, " ".join("w" * rng.randint(1, 14) for _ in range(n)), "en", "made", n) for k, n in enumerate(n_words)]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"


def simulated(words):
    """The recurrence as the reference writes it: failures, glucose after, latencies."""
    g, out = vocab.GLUCOSE_START, []
    for w in words:
        depth, rarity, cost = len(w) % 9, len(w) % 10 / 10.0, 0.004
        failed = (g < vocab.GLUCOSE_STARVED and rarity > 0.4 + (1.0 - g) * 0.6) or depth > vocab.COLLAPSE_BASE + g * vocab.COLLAPSE_FACTOR
        cost *= 2.7 if failed else 1.0
        out.append((failed, max(vocab.GLUCOSE_FLOOR, g - cost), round(115 + 90 * math.log(1 + depth) * (1.12 - g), 2)))
        g = max(vocab.GLUCOSE_FLOOR, g * vocab.GLUCOSE_DECAY ** (1.0 + depth / 10.0))
        g = max(vocab.GLUCOSE_FLOOR, g - cost)
    return out


def test_resource_simulation_takes_all_words(spark, tmp_path):
    rows = long_texts()
    got = {r["doc_id"]: r for r in registry.queries()["resource_simulation"](spark, folder(spark, tmp_path, "documents", rows, DOCUMENTS)).collect()}
    assert set(got) == {r[0] for r in rows if r[1]}
    for k, text, *_ in rows:
        if text:
            failed, after, slow = zip(*simulated(text.split()), strict=True)
            assert got[k]["n_failures"] == sum(failed) and got[k]["least_glucose"] == pytest.approx(min(after), abs=1e-6)
            assert got[k]["mean_latency"] == pytest.approx(sum(slow) / len(slow), abs=2e-3)


def test_rows_of_events_are_those_of_the_fold(spark):
    i = F.transform(F.sequence(F.lit(1), F.col("key") * 40), lambda k: F.struct((k % 9).cast("double").alias("depth"), (k % 10 / 10.0).alias("rarity"), F.lit(0.02).alias("cost")))
    rows = spark.range(1, 6).select(F.col("id").alias("key")).select("key", i.alias("intentions"))
    names = ("failure", "glucose_before", "glucose_after", "fatigue", "latency_ms")
    want = {(r["key"], r["k"]): r["e"] for r in rows.select("key", F.posexplode(traces.simulate(F.col("intentions"))).alias("k", "e")).collect()}
    for most in (7, 1 << 16):
        got = traces.simulate_rows(rows, most=most).collect()
        assert len(got) == len(want) == 40 * 15
        for r in got:
            e = want[r["key"], r["k"]]
            assert r["failure"] == e["failure"] and [r[c] for c in names[1:]] == pytest.approx([e[c] for c in names[1:]], abs=1e-9)


def test_traces_side_by_side_are_those_one_by_one():
    """Exactly, whatever their lengths; columns may be left out."""
    rnd = np.random.default_rng(8)
    sizes = np.array([0, 1, 700, *rnd.integers(0, 90, 60), 2, 0])
    depth, rarity, cost = rnd.integers(0, 9, sizes.sum()).astype(float), rnd.random(sizes.sum()), rnd.random(sizes.sum()) / 50
    decay = vocab.GLUCOSE_DECAY ** (1.0 + depth / 10.0)
    got, want = traces._walks(depth, rarity, cost, decay, sizes, 1.0), [[], [], []]
    for start, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
        for all_, own in zip(want, traces._walk(*(x[start : start + n] for x in (depth, rarity, cost, decay)), 1.0)[:3], strict=True):
            all_ += own
    assert [x.tolist() for x in got] == want and set(want[2]) == {-1, 0, 1}
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.StructArray.from_arrays([depth, rarity, cost], ["depth", "rarity", "cost"]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), lists], names=["key", "intentions"])
    for most in (50, 1 << 16):
        made = pa.Table.from_batches(traces._simulated(1.0, most, ("k", "glucose_after"))([batch]))
        assert made.column_names == ["key", "k", "glucose_after"] and made["glucose_after"].to_pylist() == want[1]
        assert made["key"].to_pylist() == np.repeat(range(len(sizes)), sizes).tolist() and made["k"].to_pylist() == [k for n in sizes for k in range(n)]


def signatures(words):
    """Locality, coupling and plausible as the reference's engine computes them."""
    fails, depth = [float(len(w) > 9) for w in words], [float(len(w) % 7) for w in words]
    coupling = 0.0
    if len(words) > 10 and any(fails):
        x, y = fails[:-1], depth[1:]
        mx, my = sum(x) / len(x), sum(y) / len(y)
        vx, vy = sum((a - mx) ** 2 for a in x), sum((b - my) ** 2 for b in y)
        if vx > 0 and vy > 0:
            coupling = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / math.sqrt(vx * vy)
    at = [k for k, f in enumerate(fails) if f]
    locality = sum(min(r - f for r in at if r >= f) for f in at) / len(at) if at else 0.0
    return locality, coupling, vocab.LOCALITY_LOW <= locality <= vocab.LOCALITY_HIGH and abs(coupling) >= 0.6


def test_engine_signatures_take_all_words(spark, tmp_path):
    late = " ".join(["short"] * 60 + ["abundantly", "to"] * 9 + ["short"] * 4)  # no failure among the first 60 words
    rows = [*long_texts(), (90, late, "en", "made", 0), (91, None, "en", "made", 0)]
    got = {r["doc_id"]: r for r in registry.queries()["engine_signatures"](spark, folder(spark, tmp_path, "documents", rows, DOCUMENTS)).collect()}
    assert len(got) == len(rows) and abs(got[90]["coupling"]) > 0.5
    for k, text, *_ in rows:
        locality, coupling, plausible = signatures((text or "").split())
        assert (got[k]["locality"], got[k]["plausible"]) == (pytest.approx(locality, abs=5e-3), plausible)
        assert got[k]["coupling"] == pytest.approx(coupling, abs=6e-4)


def test_edit_changes_keep_the_whole_tail(spark, tmp_path):
    """The change reaches to the next white space, wherever in the turn that is."""
    texts = ["", "short", "a b " * 8 + "c" * 300 + " end", "x" * 1900, "words of a turn " * 90, None]
    rows = [(1, k, "user", t) for k, t in enumerate(texts)]
    got = {r["key"]: r["change"] for r in registry.queries()["edit_changes"](spark, folder(spark, tmp_path, "conversations", rows, "conv_id long, turn int, role string, text string")).collect()}
    for k, text in enumerate(t or "" for t in texts):
        head = text[:20]
        start = max((i + 1 for i, c in enumerate(head) if c.isspace()), default=0)
        # what stays as it is before and behind the change, up to white space
        tail = text[35:]
        stop = next((i for i, c in enumerate(tail) if c.isspace()), len(tail))
        old = head[start:] + text[20:35] + tail[:stop]
        new = head[start:] + "new words" + tail[:stop]
        assert got[f"1:{k}"] == f"(0,{start}), " + (f"{old}->{new}" if old.strip() else f"{new}---added")
