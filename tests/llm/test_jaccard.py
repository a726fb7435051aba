"""The similarity join against all pairs, with classes, crowding and sketch set so that every path is taken."""

import random
import re
from collections import defaultdict

import pytest

from draftlens.llm import jaccard

SCHEMA = "doc_id long, text string, sid long, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=3):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def plain(rows, threshold=90):
    """rows (doc_id, text) -> sorted (doc_id, n_shingles, component_id)."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders, first = defaultdict(list), {}
    for k, own in enumerate(sets):
        if own in first:
            parent[find(k)] = find(first[own])
        elif own:
            first[own] = k
    for own, k in first.items():
        shared = defaultdict(int)
        for s in own:
            for other in holders[s]:
                shared[other] += 1
            holders[s].append(k)
        for other, both in shared.items():
            if 100 * both >= threshold * (len(own) + len(sets[other]) - both):
                parent[find(k)] = find(other)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            least[find(k)] = min(least.get(find(k), i), i)
    return ordered((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is not None, x or 0) for x in r])


def made_up(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    rows = [(None, None), (1, ""), (2, "A b"), (3, "a B"), (4, "x"), (5, None), (None, "q r s t"), (6, "q r s t"), (6, "Q R S T"), (7, " \t\n"), (8, "\u00c4 b c"), (9, "\u00e4 b c")]
    base = [[rnd.choice(words) for _ in range(rnd.choice([8, 9, 10, 11, 12, 40, 100, 300]))] for _ in range(30)]
    lines = [[rnd.choice(words) for _ in range(12)] for _ in range(14)]
    for k in range(700):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
            p = rnd.randrange(len(w))
            w[p : p + 1] = rnd.choice([[], [rnd.choice(words)], [f"u{k}"]])
        if k % 3 == 0:
            w = sum(rnd.sample(lines, rnd.choice([8, 9, 10])), [])
        rows.append((10 + k, rnd.choice([" ", "\n", "\x0b "]).join(w)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("frequent", "crowd", "bits"), [((32, 1024), 24, 16), ((2, 5), 4, 8), ((1, 10**9), 2, 8)])
def test_links_against_all_pairs(spark, monkeypatch, frequent, crowd, bits):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = made_up(3)
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(4)
    want = plain(rows)
    assert sum(i != c for i, _, c in want) > 100
    assert ordered(jaccard.near_sets(table, bits=bits, crowd=crowd).collect()) == want


def test_prefix_holds_a_shared_combination():
    """Linked sets share a key for any classes and order, the theorem that the join rests on."""
    rnd = random.Random(8)
    for _ in range(1500):
        n = rnd.choice([1, 2, 3, 5, 9, 10, 11, 20, 63, 64, 70, 130])
        a = {rnd.getrandbits(60) for _ in range(n)}
        b = set(a)
        for _ in range(rnd.randrange(1 + n // 8)):
            b.discard(next(iter(b)))
            if rnd.random() < 0.5:
                b.add(rnd.getrandbits(60))
        both, union = len(a & b), len(a | b)
        if a == b or 100 * both < 90 * union:
            continue
        kind = {x: rnd.choice([1, 1, 2, 3]) if rnd.random() < 0.9 else 2 for x in a | b}
        rank = {x: rnd.random() for x in a | b}
        keys = []
        for own in (a, b):
            prefix = sorted(own, key=rank.get)[: jaccard.longest_prefix(len(own), 90)]
            # those of class 1 that only one set has are passed over, as in the index
            keys.append(jaccard.signatures(len(own), [(p, x, kind[x]) for p, x in enumerate(prefix) if x in a & b or kind[x] > 1], 90))
        assert keys[0] & keys[1]


def test_empty_table_and_long_text(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert jaccard.near_sets(table, bits=8).count() == 0
    text = " ".join(f"w{k}" for k in range(1_500_000))
    rows = [(1, text), (2, text + " and more"), (3, text[::-1])]
    made = jaccard.near_sets(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA), bits=16).collect()
    assert ordered(made) == [(1, 1_499_998, 1), (2, 1_500_000, 1), (3, 1_499_998, 3)]


def test_sketch_of_one_cell_only_costs_time(spark):
    """An order that tells nothing apart loses no link."""
    rows = made_up(4)[:300]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    assert ordered(jaccard.near_sets(table, bits=1).collect()) == plain(rows)
