"""Clustering through ball trees against plain rounds, and its edge cases."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlens.llm import balltree


def plain(rows, k=8, rounds=10, seed=3, width=64):
    """rows (vec_id, list) -> sorted (vec_id, cluster, distance, cluster_inertia, inertia, digest), in Python's whole numbers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(((name(i), v) for i, v in kept))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((gap(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *near(v)) for i, v in kept]
    of = [sum(d for _, d, j in found if j == c) for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, of[j], sum(of), digests[j]) for i, d, j in found), key=str)


def result(table, **how):
    found = balltree.cluster(table, **how).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", balltree.digest(F.col("centroid")))
    return sorted((tuple(r) for r in found.collect()), key=str)


SCHEMA = "vec_id long, embedding array<double>, cluster string, n int"


def test_clusters_against_plain(spark, monkeypatch):
    """Tight groups, a hot vector, ties, repeated rows, null ids and vectors that take no part; small trees."""
    monkeypatch.setattr(balltree, "TREE", 300)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 64)) * 3
    rows = [(k, (centres[k % 12] + rng.normal(size=64) * 0.02).tolist()) for k in range(700)]
    rows += [(1000 + k, [0.25] * 64) for k in range(300)] + [(None, [-0.5] * 64), (None, [1.5] * 64), (7, [0.0] * 64)] + rows[:5]
    rows += [(3000, None), (3001, [1.0] * 63), (3002, [1.0] * 63 + [None]), (3003, [1.0] * 63 + [float("nan")]), (3004, [1.0] * 63 + [float("-inf")]), (3005, [])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    assert result(table) == plain(rows)


def test_whole_balls_are_assigned():
    """Balls of tight groups go whole, and none of their vectors belongs elsewhere."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, size=(8, 64))
    v = (centres[rng.integers(0, 8, 4000)] + rng.integers(-30, 30, size=(4000, 64))).astype(np.int64)
    tree = balltree.Tree(v)
    assert sorted(tree.order.tolist()) == list(range(4000))
    whole, to, open_ = balltree.filtered(tree.start, tree.stop, tree.left, tree.radius, tree.sums, centres)
    label = balltree.distances(v, centres).argmin(axis=1)[tree.order]
    covered = 0
    for node, j in zip(whole.tolist(), to.tolist(), strict=True):
        own = slice(tree.start[node], tree.stop[node])
        assert (label[own] == j).all()
        assert (v[tree.order[own]].sum(axis=0) == tree.sums[node]).all()
        covered += tree.stop[node] - tree.start[node]
    assert covered > 3500
    assert covered + (tree.stop - tree.start)[open_].sum() == 4000


def test_large_components_stay_exact(spark):
    """Components for which doubles would round, and one beyond the bound, which raises."""
    rows = [(k, [float(100_000 + (k * 7919 % 13) * (1 + j)) if j % 2 else -131_072.0 + k for j in range(64)]) for k in range(40)]
    assert result(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)) == plain(rows)
    with pytest.raises(Exception, match="beyond"):
        result(spark.createDataFrame([(1, [200_000.0] * 64, "x", 1)], SCHEMA))


def test_few_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [1.0] * 64)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    assert result(table) == plain(rows)
    assert result(table.limit(0)) == []
    narrow = [(i, v[:3]) for i, v in rows]
    assert result(spark.createDataFrame([(i, v, "x", 1) for i, v in narrow], SCHEMA), width=3, k=2, rounds=2) == plain(narrow, 2, 2, width=3)
