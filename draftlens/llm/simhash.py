"""SimHash near-duplicates found in the segment-popcount embedding.

A fingerprint maps to the bit counts of its 32 segments of two bits. The Manhattan distance of two such vectors is a
lower bound of the Hamming distance, so pairs within `radius` bits are pairs within `radius` in the embedding. That
range join runs on grids: the coordinates are dealt to radius // 2 + 1 groups, so that two vectors within the radius
differ by one at most in one group. Each group has its grid of cells of side one; a fingerprint is at home in its own
cell and visits the neighbouring cells, those at Manhattan distance one. As such a step changes the parity of the
counts' sum, only fingerprints of even sums visit, and each pair still meets where one of the two is at home. Pairs that meet are
tested by the lower bound over all segments, then exactly.

Only distinct fingerprints take part, each with its smallest doc_id. A cell with more than `chunk` fingerprints is
divided by the other groups' coordinates (cut into radius + 1 bands, one of which a pair must agree in). What is
crowded even then is cut into chunks, and each pair of chunks is a unit of work of its own; a unit returns a spanning
forest of the links found in it, so it gives as many rows as it has fingerprints, not as many as it has pairs, and loses
no component.

Edge cases: null and empty texts have fingerprint zero and link like any other; repeated rows stay rows; a null doc_id
never names a component unless it has no other; extra columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlens.llm.spreading import join_hot
from draftlens.session import fresh, materialize, ship_package

SHINGLE = 3
SEED = 42
RADIUS = 3
CHUNK = 1024
SEGMENTS = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text: bit set where over half of the shingles' XXH64 have it set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])


def _groups(radius: int) -> list[list[int]]:
    """The segments of each group; two vectors within radius differ by one at most in one of them."""
    n = radius // 2 + 1
    return [list(range(g, SEGMENTS, n)) for g in range(n)]


def _mask(segments: list[int]) -> int:
    return _signed(sum(3 << (2 * s) for s in segments))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_FIELDS = np.uint64(0x5555555555555555)


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Where the embeddings are within radius, and then the fingerprints."""
    pa_, pb = a - ((a >> np.uint64(1)) & _FIELDS), b - ((b >> np.uint64(1)) & _FIELDS)
    # |difference| of two-bit fields that hold 0, 1 or 2: it is even where the fields' low bits agree
    low = (pa_ ^ pb) & _FIELDS
    both = ((pa_ ^ pb) >> np.uint64(1)) & _FIELDS & ~low
    bound = np.bitwise_count(low).astype(np.int64) + 2 * np.bitwise_count(both)
    return (bound <= radius) & (np.bitwise_count(a ^ b) <= radius)


def _forest(fp: np.ndarray, home: np.ndarray, part: np.ndarray, across: bool, radius: int) -> np.ndarray:
    """Pairs of places that span the links of one unit: those of which one is at home and, across chunks, of different parts."""
    n = len(fp)
    near = np.zeros((n, n), dtype=bool)
    for s in range(0, n, 128):
        near[s : s + 128] = _near(fp[s : s + 128, None], fp[None, :], radius)
    near &= home[:, None] | home[None, :]
    if across:
        near &= part[:, None] != part[None, :]
    np.fill_diagonal(near, False)
    waiting, pairs = near.any(axis=1), []
    for start in np.flatnonzero(waiting).tolist():
        if not waiting[start]:
            continue
        waiting[start], edge = False, np.array([start])
        while len(edge):
            at = np.flatnonzero(waiting)
            links = near[np.ix_(edge, at)]
            reached = links.any(axis=0)
            pairs.append(np.stack([edge[links.argmax(axis=0)[reached]], at[reached]], axis=1))
            edge = at[reached]
            waiting[edge] = False
    return np.concatenate(pairs) if pairs else np.zeros((0, 2), dtype=np.int64)


def _links(radius: int):
    """Sorted rows (cell, i, j, part, home, fp) -> spanning forests of the links in each unit (cell, i, j)."""

    def work(cell, i, j, part, home, fp) -> tuple[np.ndarray, np.ndarray]:
        change = np.ones(len(cell), dtype=bool)
        change[1:] = (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        start = np.flatnonzero(change)
        size = np.diff(np.append(start, len(cell)))
        a, b = [], []
        # small units all at once, by the distance of rows in them
        small = (size > 1) & (size <= 16) & (i[start] == j[start])
        rows = np.repeat(small, size)
        last = np.repeat(start + size, size)
        for step in range(1, 16):
            at = np.flatnonzero(rows & (np.arange(len(cell)) + step < last))
            at = at[home[at] | home[at + step]]
            at = at[_near(fp[at], fp[at + step], radius)]
            a.append(fp[at])
            b.append(fp[at + step])
        for s, n in zip(start[~small & (size > 1)].tolist(), size[~small & (size > 1)].tolist(), strict=True):
            own = slice(s, s + n)
            pairs = fp[own][_forest(fp[own], home[own], part[own], bool(i[s] != j[s]), radius)]
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None

        def give(columns):
            a, b = work(*columns)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)]
            new[5] = new[5].view(np.uint64)
            columns = new if kept is None else [np.concatenate(x) for x in zip(kept, new, strict=True)]
            if not len(columns[0]):
                continue
            cell, i, j = columns[:3]
            same = (cell == cell[-1]) & (i == i[-1]) & (j == j[-1])
            cut = len(cell) - int(same[::-1].argmin() if not same.all() else len(cell))
            kept = [x[cut:] for x in columns]
            if cut:
                yield give([x[:cut] for x in columns])
        if kept is not None:
            yield give(kept)

    return run


def _embedding(fp: Column) -> Column:
    """The sum of each two bits in their place, without a subtraction that could overflow."""
    half, low = F.shiftrightunsigned(fp, 1), F.lit(0x5555555555555555)
    return fp.bitwiseXOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))


def _cells(p: Column, segments: list[int], group: int, reach: int) -> Column:
    """(g, home, cell) of the group's own cell and of those to visit."""
    own = p.bitwiseAND(F.lit(_mask(segments)))
    place = lambda home, x: F.struct(F.lit(group).alias("g"), F.lit(home).alias("home"), F.xxhash64(F.lit(group), x).alias("cell"))
    home = F.array(place(True, own))
    if not reach:
        return home
    low = [_signed(1 << (2 * s)) for s in segments]
    both = [_signed(3 << (2 * s)) for s in segments]
    # a count of 0 or 1 becomes the other by its low bit, one of 1 or 2 by both bits
    up = F.filter(F.array(*map(F.lit, low)), lambda m: F.shiftleft(m, 1).bitwiseAND(own) == 0)
    down = F.filter(F.array(*map(F.lit, both)), lambda m: m.bitwiseAND(own) != 0)
    steps = F.transform(F.concat(up, down), lambda m: place(False, own.bitwiseXOR(m)))
    odd = F.bit_count(own.bitwiseAND(F.lit(_signed(sum(1 << (2 * s) for s in segments))))).bitwiseAND(F.lit(1)) == 1
    return F.when(odd, home).otherwise(F.concat(home, steps))


def near_links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Spanning forests (a, b) of the links between the distinct fingerprints in fps (fp long)."""
    groups = _groups(radius)
    placed = fps.select("fp", _embedding(F.col("fp")).alias("p"))
    made = [_cells(F.col("p"), own, g, radius // len(groups)) for g, own in enumerate(groups)]
    cells = placed.select("fp", "p", F.explode(F.concat(*made)).alias("x")).select("fp", "p", "x.*")

    def met(rows: DataFrame) -> DataFrame:
        """Rows of cells in which one at home meets another, with their number n."""
        full = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("met")).filter("n > 1 and met")
        # sizes of exploded rows are not known to the planner, which would broadcast them
        return rows.hint("merge").join(full.select("cell", "n"), "cell")

    first = materialize(met(cells), "cells")
    bands = [[s for s in range(SEGMENTS) if s not in own or len(groups) == 1] for own in groups]
    keys = [F.array(*(F.xxhash64(F.lit(b), "cell", F.col("p").bitwiseAND(F.lit(_mask(rest[b :: radius + 1])))) for b in range(radius + 1))) for rest in bands]
    divided = F.element_at(F.array(*keys), F.col("g") + 1)
    dense = first.filter(F.col("n") > chunk).drop("n").withColumn("cell", F.explode(divided))
    units = (
        first.filter(F.col("n") <= chunk)
        .unionByName(met(dense))
        .withColumn("parts", F.ceil(F.col("n") / chunk).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("cell", F.least("k", "part").alias("i"), F.greatest("k", "part").alias("j"), (F.col("part") > F.col("k")).cast("int").alias("side"), "home", "fp")
    )
    # a row of chunk c is in the units (k, c) and (c, k) for all k, and once in (c, c)
    return units.repartition(F.col("cell"), F.col("i"), F.col("j")).sortWithinPartitions("cell", "i", "j").mapInArrow(_links(radius), "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, root), root the least node of each component: alternating large and small stars.

    All joins are of two shuffled sides: links grow with the input, so none passes through the driver. Rounds grow with the logarithm of the nodes; links that do not settle in `rounds` raise, so no component is given in part.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, "links")
        # done when every node hangs on a root
        open_ = new.select("u").join(new.select(F.col("v").alias("u")).hint("merge"), "u", "left_semi").limit(1).count()
        many = new.groupBy("u").count().filter("count > 1").limit(1).count()
        edges = new
        if not open_ and not many:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")


def _named(docs: DataFrame, radius: int, chunk: int, mark: str = "") -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fp long, root (which tells components apart), component_id; mark too, a long."""
    ship_package(docs.sparkSession)
    marked = [F.col(mark)] if mark else []
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *marked)
    marks = materialize(base.mapInArrow(_fingerprints, "doc_id long, fp long" + (f", {mark} long" if mark else "")), "fingerprints")
    distinct = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(near_links(distinct.select("fp"), radius, chunk))
    named = distinct.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named, "roots")
    labels = materialize(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), "labels")
    of = materialize(join_hot(named, labels, ["root"], F.col("fp"), named.count(), "m").select("fp", "n", "root", "component_id"), "named")
    return join_hot(marks, of, ["fp"], F.xxhash64(*marks.columns), marks.count())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fp long, component_id."""
    return _named(docs, radius, chunk).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs less all but one row of each group of near-duplicates: the one of smallest doc_id, nulls last.

    Rows are told apart by doc_id and a hash of their text: of rows of one doc_id those in other groups are judged there,
    and of those in one group the text of least hash stays.
    """
    i, h = fresh(docs, "id", "hash")
    rows = docs.withColumn(h, F.xxhash64(F.col("text").cast("string")))
    least = _named(rows, radius, CHUNK, h).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = least.groupBy("root", F.col("doc_id").alias(i)).agg(F.min(h).alias(h))
    keep = materialize(keep.select(i, F.col(h).alias(i + "h")), "kept")
    return rows.join(keep.hint("merge"), F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(i + "h")), "left_semi").dropDuplicates(["doc_id", h]).drop(h)
