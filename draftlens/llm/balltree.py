"""Centroid clustering of integer vectors, filtered through metric trees.

A vector's components become floor(scale * x). Each task sorts its vectors into ball trees, each over `TREE` vectors at
most, and writes them to a table once; a node stores its radius, its count and the integer sum of its vectors. A round
sends the centroids down each tree. With the ball's centre at distance d from a centroid and d' from the nearest one,
the triangle inequality rules the former out where d > d' + 2 * radius; a ball that only one centroid is left for is
added by its count and sum, without a look at its vectors, and others are opened. Vectors of leaves that stay open are
compared exactly, in whole numbers. Tasks add up their own counts and sums, so a round shuffles one row a task and
centroid, and the driver gets one row a centroid.

Edge cases: rows without exactly `width` components, or with a null or non-finite one, take no part; a null vec_id is the
empty string in the order of the first centroids; repeated rows are vectors of their own; of fewer vectors than centroids
asked for there are fewer centroids, and an empty table gives an empty result; extra columns are left alone. A component
beyond 2**27 after scaling raises, as squared distances would not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlens.session import materialize, ship_package

WIDTH = 64
SCALE = 1024
K = 8
ROUNDS = 10
SEED = 3
#: Vectors of one tree, and of a leaf, at most (a ball of equal vectors is a leaf of any size).
TREE = 16384
LEAF = 24
#: Scaled components beyond this raise.
MOST = 1 << 27


def integer_vectors(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<bigint>) of the rows that take part."""
    e = F.col("embedding")
    whole = F.size(e) == width
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    small = F.forall(e, lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) <= MOST)
    v = F.when(small, scaled).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST} after scaling")).cast("array<bigint>"))
    return vectors.filter(F.coalesce(whole & finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


class Tree:
    """Ball tree over the rows of v: `order` sorts them, nodes are runs of that order; children of node i are left[i] and left[i] + 1."""

    def __init__(self, v: np.ndarray):
        self.order = np.arange(len(v))
        start, stop, left, radius, sums = [0], [len(v)], [], [], []
        at = 0
        while at < len(start):
            s, e = start[at], stop[at]
            own = v[self.order[s:e]]
            total = own.sum(axis=0, dtype=np.int64)
            off = own - total / (e - s)
            far = float(np.sqrt((off * off).sum(axis=1).max()))
            sums.append(total)
            radius.append(far * (1 + 1e-9) + 1e-6 if own.min(axis=0).tolist() != own.max(axis=0).tolist() else 0.0)
            if e - s > LEAF and radius[-1]:
                axis = int(np.argmax((off * off).sum(axis=0)))
                half = (e - s) // 2
                self.order[s:e] = self.order[s:e][np.argpartition(own[:, axis], half)]
                left.append(len(start))
                start += [s, s + half]
                stop += [s + half, e]
            else:
                left.append(-1)
            at += 1
        self.start, self.stop, self.left = (np.array(x, dtype=np.int32) for x in (start, stop, left))
        self.radius, self.sums = np.array(radius), np.array(sums, dtype=np.int64)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances in whole numbers: in floating point while all sums stay below 2**53, else in long integers."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * most * most * v.shape[1] < 1 << 53:
        a, c = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    out = np.empty((len(v), len(centroids)), dtype=np.int64)
    for j, c in enumerate(centroids.astype(np.int64)):
        d = v.astype(np.int64) - c
        out[:, j] = (d * d).sum(axis=1)
    return out


def filtered(start, stop, left, radius, sums, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes whose ball goes whole, their centroids, leaves that stay open)."""
    nodes, may = np.zeros(1, dtype=np.int64), np.ones((1, len(centroids)), dtype=bool)
    whole, to, open_ = [], [], []
    while len(nodes):
        centre = sums[nodes] / (stop[nodes] - start[nodes])[:, None]
        gap = np.sqrt(((centre[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2))
        gap[~may] = np.inf
        least = gap.min(axis=1)
        # the slack is far above rounding errors, and opens balls that it need not
        may &= gap <= (least + 2 * radius[nodes] + 1e-6 * (1 + least))[:, None]
        one = may.sum(axis=1) == 1
        whole.append(nodes[one])
        to.append(may[one].argmax(axis=1))
        leaf = left[nodes] < 0
        open_.append(nodes[~one & leaf])
        on = ~one & ~leaf
        nodes, may = np.concatenate([left[nodes[on]], left[nodes[on]] + 1]).astype(np.int64), np.concatenate([may[on], may[on]])
    return np.concatenate(whole), np.concatenate(to), np.concatenate(open_)


def _runs(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All places of the runs start..stop."""
    size = (stop - start).astype(np.int64)
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


_NODES = "starts binary, stops binary, lefts binary, radii binary, sums binary"


def _trees(width: int):
    """(vec_id, v) -> a row for each tree."""

    def made(ids: pa.Array, v: np.ndarray) -> pa.RecordBatch:
        t = Tree(v)
        small = np.int32
        columns = [v[t.order].astype(small), t.start, t.stop, t.left, t.radius, t.sums]
        ids = ids.take(pa.array(t.order))
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([lists, *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names=["ids", "v", "starts", "stops", "lefts", "radii", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, have = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                rows = batch.slice(at, TREE)
                ids.append(rows.column(0))
                parts.append(rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
                have += rows.num_rows
                while have >= TREE:
                    all_ids, v = pa.concat_arrays(ids), np.concatenate(parts)
                    yield made(all_ids[:TREE], v[:TREE])
                    ids, parts, have = [all_ids[TREE:]], [v[TREE:]], have - TREE
        if have:
            yield made(pa.concat_arrays(ids), np.concatenate(parts))

    return run


def _read(row: dict, width: int):
    nodes = [np.frombuffer(row[c], dtype=d) for c, d in (("starts", np.int32), ("stops", np.int32), ("lefts", np.int32), ("radii", np.float64))]
    return np.frombuffer(row["v"], dtype=np.int32).reshape(-1, width), [*nodes, np.frombuffer(row["sums"], dtype=np.int64).reshape(-1, width)]


def _sums(centroids: list[list[int]], width: int):
    """Trees -> the task's count and sums of each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, dtype=np.int64)
        count, total = np.zeros(len(c), dtype=np.int64), np.zeros((len(c), width), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                v, nodes = _read(row, width)
                start, stop, _, _, sums = nodes
                whole, to, leaves = filtered(*nodes, c)
                np.add.at(count, to, (stop - start)[whole])
                np.add.at(total, to, sums[whole])
                own = v[_runs(start[leaves], stop[leaves])]
                label = distances(own, c).argmin(axis=1)
                count += np.bincount(label, minlength=len(c))
                for j in range(len(c)):
                    total[j] += own[label == j].sum(axis=0, dtype=np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * width, pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c)), pa.int32()), pa.array(count), lists], names=["cluster", "n", "sums"])

    return run


def _labels(centroids: list[list[int]], width: int):
    """Trees -> (vec_id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, dtype=np.int64)
        for batch in batches:
            for ids, row in zip(batch.column(0), batch.drop_columns(["ids"]).to_pylist(), strict=True):
                v, nodes = _read(row, width)
                start, stop, *_ = nodes
                whole, to, leaves = filtered(*nodes, c)
                label = np.full(len(v), -1, dtype=np.int32)
                label[_runs(start[whole], stop[whole])] = np.repeat(to, (stop - start)[whole])
                at = np.flatnonzero(label < 0)
                near = distances(v[at], c)
                label[at] = near.argmin(axis=1)
                gap = np.empty(len(v), dtype=np.int64)
                gap[at] = near.min(axis=1, initial=np.iinfo(np.int64).max)
                for j in range(len(c)):
                    own = np.flatnonzero((label == j))
                    own = own[~np.isin(own, at)]
                    gap[own] = distances(v[own], c[j : j + 1])[:, 0]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(label, pa.int32()), pa.array(gap)], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors of least SHA-256 of `seed:vec_id`, ties by components."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in kept.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def fit(trees: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS, width: int = WIDTH) -> list[list[int]]:
    """Centroids after `rounds` of assignment and exact floor(sum / count); one without vectors stays."""
    for _ in range(rounds):
        parts = trees.drop("ids").mapInArrow(_sums(centroids, width), "cluster int, n long, sums array<long>")
        total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
        new = list(centroids)
        for r in total.filter("n > 0").collect():  # a row a centroid
            new[r["cluster"]] = [s // r["n"] for s in r["sums"]]
        if new == centroids:
            break
        centroids = new
    return centroids


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """Per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of long)."""
    spark = vectors.sparkSession
    ship_package(spark)
    kept = integer_vectors(vectors, width, scale)
    first = first_centroids(kept, k, seed)
    if not first:
        return kept.limit(0).select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.col("v").alias("centroid"))
    trees = materialize(kept.mapInArrow(_trees(width), f"ids array<long>, v binary, {_NODES}"), "trees")
    centroids = fit(trees, first, rounds, width)
    labels = materialize(trees.mapInArrow(_labels(centroids, width), "vec_id long, cluster int, distance long"), "labels")
    inertia = [0] * len(centroids)
    for r in labels.groupBy("cluster").agg(F.sum("distance").alias("s")).collect():  # a row a centroid
        inertia[r["cluster"]] = r["s"]
    named = [(j, inertia[j], sum(inertia), c) for j, c in enumerate(centroids)]
    table = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return labels.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: Column) -> Column:
    """SHA-256 of a centroid's components, as decimal integers joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)
