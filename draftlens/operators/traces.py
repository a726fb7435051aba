"""Process traces: signatures of failure and repair, and the resource fold that makes a trace.

A trace is an array of structs with status, repair_artifact, glucose_at_event and syntactic_complexity. Signatures are
array expressions in one row; traces of a passage are some hundred events at most, so no shuffle is needed.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlens import vocab
from draftlens.session import ship_package

FAILURES = ("lexical_starvation", "syntactic_collapse")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r of two arrays of doubles of one length; null where either does not vary.

    One walk over both: sums of values less the first ones, so that what does not vary sums to exactly zero.
    """
    zero = F.lit(0.0)
    begin = F.struct(F.lit(0).alias("n"), *(zero.alias(k) for k in ("x0", "y0", "x", "y", "xx", "yy", "xy")))

    def step(acc: Column, p: Column) -> Column:
        x0, y0 = (F.when(acc["n"] == 0, p[k]).otherwise(acc[k + "0"]) for k in "xy")
        u, v = p["x"] - x0, p["y"] - y0
        sums = {"x": u, "y": v, "xx": u * u, "yy": v * v, "xy": u * v}
        return F.struct((acc["n"] + 1).alias("n"), x0.alias("x0"), y0.alias("y0"), *((acc[k] + c).alias(k) for k, c in sums.items()))

    def finish(acc: Column) -> Column:
        n = acc["n"]
        vx, vy = n * acc["xx"] - acc["x"] * acc["x"], n * acc["yy"] - acc["y"] * acc["y"]
        return F.when((n > 1) & (vx > 0) & (vy > 0), F.try_divide(n * acc["xy"] - acc["x"] * acc["y"], F.sqrt(vx * vy)))

    return F.aggregate(F.zip_with(x, y, lambda a, b: F.struct(a.alias("x"), b.alias("y"))), begin, step, finish)


def lagged_correlation(x: Column, y: Column) -> Column:
    """r of x at each step with y at the next."""
    n = F.size(x)
    return F.when(n > 2, correlation(F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(y, F.lit(2), F.greatest(n - 1, F.lit(0)))))


def rises(values: Column, tolerance: float = vocab.GLUCOSE_TOLERANCE) -> Column:
    """Whether any value lies above the one before by more than the tolerance."""
    n = F.size(values)
    pairs = F.zip_with(F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(values, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: b > a + tolerance)
    return F.when(n > 1, F.exists(pairs, lambda p: p)).otherwise(False)


def repair_locality(failed: Column, repaired: Column) -> Column:
    """Mean of next repair - failure + 1 over failures with a repair at or after them; zero without any.

    Read backwards, the place of the next repair is carried along, so a trace is walked once.
    """
    both = F.reverse(F.zip_with(failed, repaired, lambda f, r: F.struct(f.alias("f"), r.alias("r"))))
    begin = F.struct(F.lit(-1).alias("away"), F.lit(0).alias("n"), F.lit(0.0).alias("total"))

    def step(acc: Column, e: Column) -> Column:
        away = F.when(e["r"], F.lit(0)).when(acc["away"] >= 0, acc["away"] + 1).otherwise(F.lit(-1))
        counts = e["f"] & (away >= 0)
        return F.struct(away.alias("away"), (acc["n"] + counts.cast("int")).alias("n"), (acc["total"] + F.when(counts, away + 1).otherwise(0)).alias("total"))

    return F.aggregate(both, begin, step, lambda acc: F.coalesce(F.try_divide(acc["total"], acc["n"]), F.lit(0.0)))


def with_signatures(rows: DataFrame, trace: str = "trace") -> DataFrame:
    """Adds locality (2 digits), coupling (3 digits) and plausible. A failure is any status but success."""
    failed = F.transform(trace, lambda e: e["status"] != "success")
    repaired = F.transform(trace, lambda e: F.coalesce(e["repair_artifact"], F.lit("")) != "")
    flags = F.transform(failed, lambda f: f.cast("double"))
    r = F.coalesce(lagged_correlation(flags, F.transform(trace, lambda e: e["syntactic_complexity"])), F.lit(0.0))
    enough = (F.size(trace) > vocab.TRACE_FOR_COUPLING) & F.exists(failed, lambda f: f)
    out = rows.withColumns({"_loc": F.coalesce(repair_locality(failed, repaired), F.lit(0.0)), "_r": F.when(enough, r).otherwise(0.0)})
    plausible = F.col("_loc").between(vocab.LOCALITY_LOW, vocab.LOCALITY_HIGH) & (F.abs("_r") > vocab.COUPLING_PLAUSIBLE)
    return out.withColumns({"locality": F.round("_loc", 2), "coupling": F.round("_r", 3) + F.lit(0.0), "plausible": plausible}).drop("_loc", "_r")


def signature_anomaly(locality: Column, coupling: Column) -> Column:
    return F.when(locality > vocab.LOCALITY_ANOMALY, "anomaly.process_violation").when(F.abs(coupling) < vocab.COUPLING_ANOMALY, "anomaly.no_resource_coupling")


def anomaly_spans(spans: DataFrame) -> DataFrame:
    """New spans, on the offsets of injections whose signatures no human shows; the id keeps the first eight characters of the injection's."""
    rows = with_signatures(spans.filter(F.col("label").startswith("injection.")), "trace")
    rows = rows.withColumn("_a", signature_anomaly(F.col("locality"), F.col("coupling"))).filter("_a is not null")
    return rows.select("doc_id", "revision_index", F.concat(F.lit("anom_"), F.substring("injection_id", 1, 8)).alias("injection_id"), F.col("_a").alias("label"), F.lit("high").alias("flag"), "start", "end", "locality", "coupling")


def with_anomalies(spans: DataFrame) -> DataFrame:
    """The spans, and after each injection whose signatures no human shows the anomaly on its offsets: all columns of spans, in one pass.

    An anomaly has the injection's trace, offsets and other columns, but its own id, label and flag, no level and state, and, where
    spans have them, the detector as generator and prompt, seed zero and no provenance. Spans without a trace stay as they are.
    """
    own = {
        "injection_id": F.concat(F.lit("anom_"), F.substring("injection_id", 1, 8)),
        "label": signature_anomaly(F.col("_s.locality"), F.col("_s.coupling")),
        "flag": F.lit("high"),
        "level": F.lit(None),
        "state": F.lit(None),
        "generator_class": F.lit("detector"),
        "prompt_hash": F.lit("detector"),
        "rng_seed": F.lit(0),
        "provenance_hash": F.lit(None),
    }
    kinds = {f.name: f.dataType for f in spans.schema.fields}
    signed = with_signatures(spans.select(F.struct(*(F.col(f"`{c}`") for c in spans.columns)).alias("_row"), "injection_id", F.col("trace").alias("trace"), "label"))
    signed = signed.withColumn("_s", F.struct("locality", "coupling"))
    kept = F.struct(*(F.col(f"_row.`{c}`").alias(c) for c in spans.columns))
    new = F.struct(*((own[c].cast(kinds[c]) if c in own else F.col(f"_row.`{c}`")).alias(c) for c in spans.columns))
    odd = F.col("label").startswith("injection.") & F.col("trace").isNotNull() & own["label"].isNotNull()
    return signed.select(F.inline(F.when(odd, F.array(kept, new)).otherwise(F.array(kept))))


def state_from_signatures(plausible: Column, coupling: Column, locality: Column) -> Column:
    r = F.abs(coupling)
    return F.when(plausible & (r > vocab.COUPLING_ASSIMILATED), "assimilated").when((r >= vocab.COUPLING_WARM) & (locality <= vocab.LOCALITY_WARM), "warm").otherwise("cold")


def flag_from_state(state: Column) -> Column:
    return F.when(state == "assimilated", "high").when(state == "warm", "medium").otherwise("none")


def latency(depth: Column, glucose: Column) -> Column:
    return F.round(115 + 90 * F.log(1 + depth) * (1.12 - glucose), 2)


def allocation(glucose: Column, fatigue: Column, demand: Column) -> Column:
    """Shares for words, syntax and attention, three digits."""
    syntax = F.greatest(F.lit(0.3), glucose * 1.3) * F.when(demand > 5.0, 0.7).otherwise(1.0)
    one = lambda c, name: F.round(F.least(F.lit(1.0), c), 3).alias(name)
    return F.struct(one(glucose * (1 - fatigue * 0.4), "lexical"), one(syntax, "syntactic"), one(F.greatest(F.lit(0.1), glucose - fatigue * 0.5), "attention"))


def simulate(intentions: Column, glucose: float = vocab.GLUCOSE_START) -> Column:
    """Walk intentions (depth, rarity, cost) through the resource recurrence: an array of events.

    The floor and the failure branch make the recurrence non-linear, so it is a fold; the accumulator grows with the trace
    and is copied at each step, so this is for short traces. simulate_rows() takes any length.
    """
    event = "array<struct<failure:string,glucose_before:double,glucose_after:double,fatigue:double,latency_ms:double>>"
    begin = F.struct(F.lit(glucose).alias("g"), F.lit(0.0).alias("tired"), F.array().cast(event).alias("out"))
    floor = F.lit(vocab.GLUCOSE_FLOOR)

    def step(acc: Column, i: Column) -> Column:
        g = acc["g"]
        starved = (g < vocab.GLUCOSE_STARVED) & (i["rarity"] > 0.4 + (1.0 - g) * 0.6)
        collapsed = i["depth"] > vocab.COLLAPSE_BASE + g * vocab.COLLAPSE_FACTOR
        failure = F.when(starved, "lexical_starvation").when(collapsed, "syntactic_collapse")
        cost = i["cost"] * F.when(failure.isNotNull(), 2.7).otherwise(1.0)
        worn = F.greatest(floor, g * F.pow(F.lit(vocab.GLUCOSE_DECAY), 1.0 + i["depth"] / 10.0))
        tired = F.least(F.lit(1.0), acc["tired"] + 1.0 / vocab.FATIGUE_TOKENS)
        made = F.struct(failure.alias("failure"), g.alias("glucose_before"), F.greatest(floor, g - cost).alias("glucose_after"), tired.alias("fatigue"), latency(i["depth"], g).alias("latency_ms"))
        return F.struct(F.greatest(floor, worn - cost).alias("g"), tired.alias("tired"), F.array_append(acc["out"], made).alias("out"))

    return F.aggregate(intentions, begin, step, lambda acc: acc["out"])


def _walk(depth: np.ndarray, rarity: np.ndarray, cost: np.ndarray, decay: np.ndarray, glucose: float) -> tuple[list[float], list[float], list[int], float]:
    """Glucose before and after each intention, the kind of failure (-1: none), and the glucose that is left."""
    floor, starved, g = vocab.GLUCOSE_FLOOR, vocab.GLUCOSE_STARVED, glucose
    before, after, kinds = [], [], []
    for d, r, c, w in zip(depth.tolist(), rarity.tolist(), cost.tolist(), decay.tolist(), strict=True):
        kind = 0 if g < starved and r > 0.4 + (1.0 - g) * 0.6 else 1 if d > vocab.COLLAPSE_BASE + g * vocab.COLLAPSE_FACTOR else -1
        c *= 1.0 if kind < 0 else 2.7
        before.append(g)
        after.append(max(floor, g - c))
        kinds.append(kind)
        g = max(floor, max(floor, g * w) - c)
    return before, after, kinds, g


#: Traces that go side by side; fewer go one by one.
ABREAST = 24


def _walks(depth: np.ndarray, rarity: np.ndarray, cost: np.ndarray, decay: np.ndarray, sizes: np.ndarray, glucose: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_walk of traces that lie one behind the other, a step of all at once while there are enough of them."""
    before, after, kinds = np.empty(len(depth)), np.empty(len(depth)), np.empty(len(depth), dtype=np.int32)
    starts, order = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
    steps = int(sizes[order[ABREAST - 1]]) if len(sizes) >= ABREAST else 0
    alive = np.searchsorted(-sizes[order], -np.arange(steps), side="left")  # traces of more intentions than steps done
    ends = np.cumsum(alive)
    at = np.repeat(np.arange(steps), alive)
    place = starts[order][np.arange(len(at)) - np.repeat(ends - alive, alive)] + at
    d_, r_, c_, w_ = depth[place], rarity[place], cost[place], decay[place]
    b_, a_, k_ = np.empty(len(at)), np.empty(len(at)), np.empty(len(at), dtype=np.int32)
    floor, g = vocab.GLUCOSE_FLOOR, np.full(len(sizes), glucose)
    for n, e in zip(alive.tolist(), ends.tolist(), strict=True):
        own = slice(e - n, e)
        g = g[:n]
        weak = (g < vocab.GLUCOSE_STARVED) & (r_[own] > 0.4 + (1.0 - g) * 0.6)
        kind = np.where(weak, 0, np.where(d_[own] > vocab.COLLAPSE_BASE + g * vocab.COLLAPSE_FACTOR, 1, -1))
        c = c_[own] * np.where(kind < 0, 1.0, 2.7)
        left, worn = g - c, g * w_[own]
        b_[own], a_[own], k_[own] = g, np.where(left > floor, left, floor), kind
        worn = np.where(worn > floor, worn, floor) - c
        g = np.where(worn > floor, worn, floor)
    before[place], after[place], kinds[place] = b_, a_, k_
    for rank, row in enumerate(order[: int((sizes > steps).sum())].tolist()):
        rest = slice(starts[row] + steps, starts[row] + sizes[row])
        before[rest], after[rest], kinds[rest], _ = _walk(depth[rest], rarity[rest], cost[rest], decay[rest], float(g[rank]) if steps else glucose)
    return before, after, kinds


def _events(depth: np.ndarray, before, after, kinds, k: np.ndarray) -> list[pa.Array]:
    """Columns of the events; k: their places in their traces."""
    slow = 115 + 90 * np.log(1 + depth) * (1.12 - np.asarray(before))
    kinds = np.asarray(kinds, dtype=np.int32)
    failure = pa.array(FAILURES, pa.string()).take(pa.array(kinds, pa.int32(), mask=kinds < 0))
    return [pa.array(k, pa.int32()), failure, pa.array(before, pa.float64()), pa.array(after, pa.float64()), pa.array(np.minimum(1.0, (k + 1) / vocab.FATIGUE_TOKENS)), pa.array([round(x, 2) for x in slow.tolist()], pa.float64())]


EVENTS = {"k": "int", "failure": "string", "glucose_before": "double", "glucose_after": "double", "fatigue": "double", "latency_ms": "double"}


def _simulated(glucose: float, most: int, columns: Sequence[str] = tuple(EVENTS)):
    names = ["key", *columns]

    def rows(key: pa.Array, events: list[pa.Array]) -> pa.RecordBatch:
        made = dict(zip(EVENTS, events, strict=True))
        return pa.RecordBatch.from_arrays([key, *(made[c] for c in columns)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("intentions")
            values = lists.flatten()
            depth, rarity, cost = (values.field(c).to_numpy(zero_copy_only=False) for c in ("depth", "rarity", "cost"))
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            first = 0
            while first < len(sizes):
                start = int(ends[first] - sizes[first])
                if sizes[first] > most:  # a long trace in pieces
                    g = glucose
                    for a in range(start, int(ends[first]), most):
                        b = min(a + most, int(ends[first]))
                        *made, g = _walk(depth[a:b], rarity[a:b], cost[a:b], vocab.GLUCOSE_DECAY ** (1.0 + depth[a:b] / 10.0), g)
                        key = batch.column("key").take(pa.array([first] * (b - a), pa.int32()))
                        yield rows(key, _events(depth[a:b], *made, np.arange(a - start, b - start)))
                    first += 1
                    continue
                # traces up to the next long one, of some `most` events in all
                long_ = np.flatnonzero(sizes[first:] > most)
                last = min(int(np.searchsorted(ends, start + most)) + 1, len(sizes), first + int(long_[0]) if len(long_) else len(sizes))
                own, group = slice(start, int(ends[last - 1])), sizes[first:last]
                made = _walks(depth[own], rarity[own], cost[own], vocab.GLUCOSE_DECAY ** (1.0 + depth[own] / 10.0), group, glucose)
                k = np.arange(group.sum()) - np.repeat(np.cumsum(group) - group, group)
                key = batch.column("key").take(pa.array(np.repeat(np.arange(first, last), group), pa.int32()))
                if len(k):
                    yield rows(key, _events(depth[own], *made, k))
                first = last

    return run


def simulate_rows(rows: DataFrame, glucose: float = vocab.GLUCOSE_START, most: int = 1 << 16, columns: Sequence[str] = tuple(EVENTS)) -> DataFrame:
    """rows (key, intentions as simulate() takes them) -> a row for each event, with its place k in the trace; of its columns those named.

    Linear in the length of a trace. Traces of a batch take their steps side by side, so that a step is numpy's; events are
    handed on in pieces of about `most`, and a trace of more goes alone.
    """
    ship_package(rows.sparkSession)
    key = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "intentions").mapInArrow(_simulated(glucose, most, columns), ", ".join([f"key {key}", *(f"{c} {EVENTS[c]}" for c in columns)]))


def revision_summary(spans: DataFrame) -> DataFrame:
    """By revision: spans, least glucose, mean locality of those with one, share plausible."""
    rows = with_signatures(spans, "trace").withColumn("_g", F.array_min(F.transform("trace", lambda e: e["glucose_at_event"])))
    return rows.groupBy("doc_id", "revision_index").agg(
        F.count("*").alias("n"),
        F.round(F.min("_g"), 6).alias("least_glucose"),
        F.round(F.coalesce(F.avg(F.when(F.col("locality") > 0, F.col("locality"))), F.lit(0.0)), 6).alias("mean_locality"),
        F.round(F.avg(F.col("plausible").cast("double")), 6).alias("plausible_share"),
    )


def document_trajectory(spans: DataFrame, revisions: DataFrame) -> DataFrame:
    """By document of revisions: spans by state, repairs, the last revision's glucose, means of locality and coupling, share of plausible revisions.

    A revision's glucose is the least of its spans' last events, one without them; its locality and coupling are means over its
    spans; it is plausible if all of them are. Means over a document leave out revisions whose value is zero, and are zero for none.
    """
    end = F.element_at("trace", -1)["glucose_at_event"]
    rows = with_signatures(spans.filter(F.size("trace") > 0), "trace")
    state = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s)
    traced = rows.groupBy("doc_id", "revision_index").agg(
        F.min(F.when(end != 0, end)).alias("g"),
        F.avg("locality").alias("l"),
        F.avg("coupling").alias("c"),
        F.min("plausible").alias("p"),
        F.sum(F.size(F.filter("trace", lambda e: e["status"] == "repair"))).alias("repairs"),
    )
    held = spans.groupBy("doc_id", "revision_index").agg(F.count("*").alias("n"), *(state(s) for s in vocab.STATES))
    keys = ["doc_id", "revision_index"]
    snaps = revisions.select(*keys).distinct().join(held.join(traced, keys, "left"), keys, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    mean = lambda c, name: F.round(F.coalesce(F.avg(F.when(F.col(c) != 0, F.col(c))), F.lit(0.0)), 6).alias(name)
    return snaps.groupBy("doc_id").agg(
        F.count("*").alias("n_revisions"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_spans"),
        *(total(s) for s in vocab.STATES),
        total("repairs"),
        F.round(F.max_by(F.least(F.lit(1.0), F.coalesce("g", F.lit(1.0))), "revision_index"), 6).alias("final_glucose"),
        mean("l", "mean_locality"),
        mean("c", "mean_coupling"),
        F.round(F.avg(F.coalesce("p", F.lit(True)).cast("double")), 6).alias("plausible_share"),
    )


def _coupling(doc: np.ndarray, flags: np.ndarray, depth: np.ndarray, n_docs: int) -> np.ndarray:
    """r of each document's flags with the depth one event later; zero where it says nothing. Rows of a document adjoin."""
    size = np.bincount(doc, minlength=n_docs)
    at = np.flatnonzero(doc[1:] == doc[:-1])
    d, n = doc[at], np.maximum(size - 1, 1)
    first = (np.cumsum(size) - size)[d]
    # less the first values, so that what does not vary has a variance of exactly zero
    x, y = flags[at] - flags[first], depth[at + 1] - depth[first + 1]
    total = lambda v: np.bincount(d, weights=v, minlength=n_docs)
    x, y = x - (total(x) / n)[d], y - (total(y) / n)[d]
    xx, yy, xy = total(x * x), total(y * y), total(x * y)
    told = (size > 10) & (np.bincount(doc, weights=flags, minlength=n_docs) > 0) & (xx > 0) & (yy > 0)
    return np.divide(xy, np.sqrt(xx * yy), out=np.zeros(n_docs), where=told)


def _engine(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("events")
            values = lists.flatten()
            flags, depth = values.field("failure").is_valid().to_numpy(zero_copy_only=False).astype(float), values.field("depth").to_numpy(zero_copy_only=False)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size, dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(size)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    s, e = ends[a] - size[a], ends[b - 1]
                    r = _coupling(np.repeat(np.arange(b - a), size[a:b]), flags[s:e], depth[s:e], b - a)
                    yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), pa.array(r)], names=["key", "r"])

    return run


def engine_signatures(rows: DataFrame, most: int = 1 << 18) -> DataFrame:
    """Signatures by the simulation's own rule, over its events (failure, depth): a failure repairs itself at once.

    rows (key, events) -> key, locality, coupling, plausible. Locality has no one added, so with each repair at its failure
    it is zero; coupling needs more than ten events; plausible asks for |r| of 0.6 or more. Traces of whole texts are long,
    so sums run over Arrow batches, about `most` events at once. Kept beside with_signatures(), which is the default.
    """
    ship_package(rows.sparkSession)
    key = rows.schema["key"].dataType.simpleString()
    locality, r = F.lit(0.0), F.col("r")
    plausible = locality.between(vocab.LOCALITY_LOW, vocab.LOCALITY_HIGH) & (F.abs(r) >= 0.6)
    return rows.select("key", "events").mapInArrow(_engine(most), f"key {key}, r double").select("key", locality.alias("locality"), F.round(r, 3).alias("coupling"), plausible.alias("plausible"))


#: Shortest interval between keys in milliseconds, and the share by which one may differ from the one before.
SHORTEST_MS, JITTER = 80, 0.15


def key_intervals(first: float, n: int, salt: str) -> list[float]:
    """n intervals between keys, a random walk from `first` that the salt decides, never below the shortest."""
    draw, out, now = random.Random(salt), [], first
    for _ in range(n):
        now = max(SHORTEST_MS, now + draw.uniform(-JITTER, JITTER) * now)
        out.append(round(now, 2))
    return out


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # lists of a few rows at a time
            part = batch.slice(at, 256)
            rows = zip(*(part.column(c).to_pylist() for c in ("latency_ms", "n", "salt")), strict=True)
            made = [None if f is None or s is None else key_intervals(f, n or 0, s) for f, n, s in rows]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(made, pa.list_(pa.float64()))], names=["key", "intervals"])


def with_intervals(rows: DataFrame) -> DataFrame:
    """rows (key, latency_ms, n, salt) -> the intervals of the n keys; null where latency or salt is. The walk is a seeded generator's."""
    ship_package(rows.sparkSession)
    key = rows.schema["key"].dataType.simpleString()
    return rows.select("key", F.col("latency_ms").cast("double").alias("latency_ms"), F.col("n").cast("int").alias("n"), "salt").mapInArrow(_intervals, f"key {key}, intervals array<double>")
