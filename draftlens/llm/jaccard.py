"""Similarity join of shingle sets by token-combination prefixes, and its components.

Documents link when threshold * |union| <= 100 * |intersection| of their sets of `shingle`-word shingles (threshold in hundredths).
A set of n shingles can miss m = n - ceil(threshold * n / 100) of them at most in a partner. All sets are sorted in one global order, rare
shingles first. Shingles fall into classes by how many sets have them in their prefixes, and a class of k (1 for rare
ones, 2 and 3 for frequent ones) is dealt by hash to subclasses. A prefix is long enough once the sum over subclasses of
max(0, its shingles - k + 1) exceeds m: if a partner shared less than k shingles of each subclass, it would miss more
than m. So linked sets share a combination of k shingles of one subclass, all of them in both prefixes, and combinations,
not single shingles, are indexed for frequent classes. The number of subclasses follows the power of two below n; a set near the next one
is indexed for both.

How it runs
1. One scan gives each document the size and a 128-bit digest of its set, and counts shingles in a sketch of `1 << CELL_BITS` cells,
   merged by block. Its levels, of fixed size, are broadcast; they only decide the order, so their errors cost time, never a link. At more
   shingles a cell the order tells fewer of the frequent ones apart, but those far above the mean stay last.
2. A second scan writes the longest prefix of each distinct set. Exact counts of prefix shingles drop those of one set and
   settle the classes; the rest give the index of combinations.
3. A set in crowded buckets is an owner in the largest of them. Owners are compared with all members of that bucket inside tasks, by
   products of 0/1 matrices over the shingles at hand; a crowded bucket is cut into parts of bounded size, and each pair of parts is a unit that returns
   a spanning forest of its links, so a group of near copies makes no rows for its pairs. All other pairs of a bucket, in which neither
   is a member of the other's own bucket, become rows.
4. Pairs are bounded by their prefixes first: what one has up to the end of the shorter prefix and the other has not is missed for certain. Those
   left are verified on whole sets, which are read for them alone. Components come from links by alternating stars.

Equal sets are one from step 2 on. Edge cases: a document without words (null text too) has size 0 and is its own component; a
null doc_id names a component only if it has no other, and one that is linked with nothing stays null; repeated rows stay rows;
extra columns are left alone; an empty table gives an empty result. Shingles are told apart by 64-bit hashes within a pair (56 bits and
the level in prefixes), sets by 128-bit digests.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlens.llm import wordhash
from draftlens.llm.simhash import components
from draftlens.llm.spreading import join_hot
from draftlens.session import materialize, ship_package

SHINGLE = 3
THRESHOLD = 90
#: Cells of the sketch (a byte each once merged) and of one of its blocks.
CELL_BITS = 24
BLOCK_BITS = 16
#: Shingles in the prefixes of more sets than these are of class 2, 3.
FREQUENT = (32, 1024)
#: Shingles of a set for each subclass of class 2, 3; a prefix has a tenth of them.
SPLIT = (128, 64)
#: Buckets of more members than this are crowded; a part of one has so many members, and shingles in all of them, at most.
CROWD = 24
PART = 1024
PART_SHINGLES = 1_000_000
#: Columns of a matrix.
COLUMNS = 4096
#: Ids that may be broadcast.
BROADCAST_IDS = 500_000


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all distinct shingles, in this order; of a text of fewer words the whole sequence is one."""
    w = wordhash.Words(buf, offsets, wordhash.SPACE, lower=True)
    at = w.inside(size)
    doc, h = w.doc[at], w.windows(size)[at] if len(at) else np.zeros(0, np.uint64)
    few = np.flatnonzero((w.count > 0) & (w.count < size))
    if len(few):
        whole = []
        for d in few.tolist():
            own = w.hash[w.first[d] : w.first[d + 1]]
            whole.append(int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8, key=b"few").digest(), "little"))
        doc, h = np.concatenate([doc, few]), np.concatenate([h, np.array(whole, dtype=np.uint64)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _set_digest(own: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _each(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted set) of all texts."""
    for at, to, buf, offsets in wordhash.slices(column):
        doc, h = shingle_sets(buf, offsets, size)
        edge = np.searchsorted(doc, np.arange(to - at + 1))
        for d in range(to - at):
            yield at + d, h[edge[d] : edge[d + 1]]


def _long_list(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(wordhash.as_long(flat)))


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    return (wordhash.mix(h) >> np.uint64(64 - bits)).astype(np.int64)


_COUNTED = "doc_id long, n long, d1 long, d2 long, block int, counts binary"


def _count(size: int, bits: int):
    """Rows (doc_id, text) -> (doc_id, n, d1, d2) of each, and the task's sketch in blocks."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_ = np.zeros(1 << bits, dtype=np.uint8), False
        for batch in batches:
            n, d1, d2 = [], [], []
            seen = np.zeros(0, dtype=np.int64)
            for _, own in _each(batch.column(1), size):
                a, b = _set_digest(own) if len(own) else (None, None)
                n.append(len(own))
                d1.append(a)
                d2.append(b)
                seen = _cells(own, bits)
                if len(seen):
                    any_ = True
                    # a set's shingles rarely share a cell; where they do the cell counts once, which is as good
                    counts[seen] += counts[seen] < 255
            nothing = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), *nothing], schema=schema)
        if any_:
            step = 1 << min(BLOCK_BITS, bits)
            for k in range(0, 1 << bits, step):
                own = counts[k : k + step]
                if own.any():
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([k // step], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], schema=schema)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks -> the levels of each range of cells: twelve for each doubling of the count."""
    block, total = None, None

    def given() -> pa.RecordBatch:
        level = np.minimum(255, np.round(12 * np.log2(1 + total))).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "levels"])

    for batch in batches:
        for b, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(zlib.decompress(data.as_py()), dtype=np.uint8)
            if b != block:
                if block is not None:
                    yield given()
                block, total = b, np.zeros(len(own), dtype=np.int64)
            total += own
    if block is not None:
        yield given()


def _places(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Shingles as numbers in the global order: by level, then by hash."""
    return ((level.astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))) ^ np.uint64(1 << 63)


def allowed(n, threshold: int):
    """Shingles that a set of n can miss in a partner."""
    return n - (threshold * n + 99) // 100


def subclasses(level: int) -> list[int]:
    """Subclasses of each frequent class at a level (the power of two below a set's size)."""
    return [max(1, (1 << level) // s) for s in SPLIT]


def levels_of(n: int, threshold: int) -> list[int]:
    """Levels that a set of n is indexed for: its own, and the next if a larger partner may be there."""
    own = n.bit_length() - 1
    return [own, own + 1] if 100 * n // threshold >= 2 << own else [own]


def longest_prefix(n: int, threshold: int) -> int:
    most = max(sum((k + 1) * g for k, g in enumerate(subclasses(level))) for level in levels_of(n, threshold))
    return min(n, int(allowed(n, threshold)) + 1 + most)


def _prefixes(size: int, threshold: int, bits: int, ranks):
    """Rows (doc_id, text, t) -> (d1, d2, n, doc_id, t, prefix) in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(ranks.value, dtype=np.uint8)
        for batch in batches:
            rows, n, d1, d2, prefix = [], [], [], [], []
            for row, own in _each(batch.column(1), size):
                if not len(own):
                    continue
                most = longest_prefix(len(own), threshold)
                placed = np.sort(wordhash.as_long(_places(own, rank[_cells(own, bits)])))[:most]
                a, b = _set_digest(own)
                rows.append(row)
                n.append(len(own))
                d1.append(a)
                d2.append(b)
                prefix.append(placed)
            at = pa.array(rows, pa.int64())
            columns = [pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int64()), batch.column(0).take(at), batch.column(2).take(at), _long_list(prefix)]
            yield pa.RecordBatch.from_arrays(columns, names=["d1", "d2", "n", "doc_id", "t", "prefix"])

    return run


def signatures(n: int, known: list[tuple[int, int, int]], threshold: int) -> set[int]:
    """Keys of a set of n, of whose prefix `known` has (place, shingle, class) of each shingle that other sets have too."""
    out: set[int] = set()
    need = int(allowed(n, threshold)) + 1
    known = sorted(known)
    for level in levels_of(n, threshold):
        groups, held, at, have = subclasses(level), {}, 0, 0
        for place, token, kind in known:
            have, at = have + place - at, place + 1  # those passed over are of class 1
            if have >= need:
                break
            if kind == 1:
                have += 1
                out.add(_key((token,)))
            else:
                g = token % groups[kind - 2]
                others = held.setdefault((kind, g), [])
                have += len(others) >= kind - 1
                out.update(_key((level, kind, *sorted((token, *c)))) for c in combinations(others, kind - 1))
                others.append(token)
            if have >= need:
                break
    return out


def _key(parts: tuple[int, ...]) -> int:
    packed = b"".join((p & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little") for p in parts)
    return int.from_bytes(hashlib.blake2b(packed, digest_size=8).digest(), "little", signed=True)


def _index(threshold: int):
    """(sid, n, prefix, known) -> (key, sid, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                keys, sids, sizes = [], [], []
                for r in batch.slice(at, 64).to_pylist():
                    places = np.searchsorted(r["prefix"], [x["token"] for x in r["known"]]).tolist()
                    made = signatures(r["n"], [(p, x["token"], x["kind"]) for p, x in zip(places, r["known"], strict=True)], threshold)
                    keys += made
                    sids += [r["sid"]] * len(made)
                    sizes += [r["n"]] * len(made)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64())], names=["key", "sid", "n"])

    return run


def _sets(size: int):
    """Rows (doc_id, text) -> (d1, d2, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [own for _, own in _each(batch.column(1), size) if len(own)]
            made = [_set_digest(own) for own in kept]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), _long_list(kept)], names=["d1", "d2", "tokens"])

    return run


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets share."""
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    kept = count[column] > 1
    row, column = row[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.diag(size).astype(np.float32)
    own = np.zeros(len(sets), dtype=np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        s, e = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        m[row[s:e], column[s:e] - at] = 1
        both = m @ m.T
        own += np.diag(both).astype(np.int64)
        out += both
    out[np.diag_indices(len(sets))] -= own
    return out.astype(np.int64)


def _units(threshold: int):
    """Sorted rows (key, i, j, part, owner, sid, tokens) -> spanning forests of the links that each unit (key, i, j) has."""

    def forest(rows: list[tuple]) -> list[tuple[int, int]]:
        part, owner, sid = (np.array([r[k] for r in rows]) for k in range(3))
        both = shared([r[3] for r in rows])
        size = np.diag(both)
        near = 100 * both >= threshold * (size[:, None] + size[None, :] - both)
        near &= owner[:, None] | owner[None, :]
        if part.min() != part.max():
            near &= part[:, None] != part[None, :]
        np.fill_diagonal(near, False)
        waiting, out = near.any(axis=1), []
        for start in np.flatnonzero(waiting).tolist():
            edge = [start] if waiting[start] else []
            waiting[start] = False
            while edge:
                x = edge.pop()
                reached = np.flatnonzero(near[x] & waiting)
                waiting[reached] = False
                out += [(int(sid[x]), int(sid[y])) for y in reached]
                edge += reached.tolist()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def given() -> pa.RecordBatch:
            pairs = forest(held) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in batches:
            lists = batch.column(6)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for k, (key, i, j, part, owner, sid) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True)):
                if (key, i, j) != unit:
                    if held:
                        yield given()
                    unit, held = (key, i, j), []
                held.append((part, owner, sid, flat[ends[k] : ends[k + 1]].copy()))
        if held:
            yield given()

    return run


def _bounded(pairs: DataFrame, distinct: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that may link by what their prefixes say."""
    left = distinct.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
    right = distinct.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))
    met = pairs.join(left, "a").join(right, "b")
    end = F.least(F.element_at("pa", -1), F.element_at("pb", -1))
    seen = lambda p: F.size(F.filter(p, lambda x: x <= F.col("end")))
    met = met.withColumn("end", end).withColumn("both", F.size(F.array_intersect("pa", "pb")))
    most = F.least(F.col("na") - seen("pa"), F.col("nb") - seen("pb")) + F.col("both")
    return met.withColumn("most", most).filter(F.col("most") * 100 >= (F.col("na") + F.col("nb") - F.col("most")) * threshold).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that link by their whole sets."""
    left = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    met = pairs.join(left, "a").join(right, "b")
    both, union = F.size(F.array_intersect("ta", "tb")), F.size("ta") + F.size("tb")
    met = met.select("a", "b", both.cast("long").alias("both"), union.cast("long").alias("sum"))
    return met.filter(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * threshold).select("a", "b")


def _few(df: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def set_links(texts: DataFrame, found: DataFrame, blocks: DataFrame, size: int, threshold: int, bits: int, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(distinct sets with sid, d1, d2; links a, b between sids, enough of them to span each component)."""
    spark = texts.sparkSession
    merged = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "block int, levels binary")
    step = 1 << min(BLOCK_BITS, bits)
    rank = bytearray(1 << bits)
    for r in merged.collect():  # as many bytes as there are cells
        rank[r["block"] * step : (r["block"] + 1) * step] = r["levels"]
    ranks = spark.sparkContext.broadcast(bytes(rank))

    marked = texts.select("doc_id", "text", F.xxhash64("text").alias("t"))
    prefixes = marked.mapInArrow(_prefixes(size, threshold, bits, ranks), "d1 long, d2 long, n long, doc_id long, t long, prefix array<long>")
    distinct = materialize(prefixes.dropDuplicates(["d1", "d2"]).withColumn("sid", F.monotonically_increasing_id()), "prefixes")

    tokens = distinct.select("sid", F.explode("prefix").alias("token"))
    kind = F.lit(1) + sum(((F.col("sets") > most).cast("int") for most in FREQUENT), F.lit(0))
    counts = tokens.groupBy("token").agg(F.count("*").alias("sets")).filter("sets > 1").select("token", kind.alias("kind"))
    known = tokens.join(materialize(counts, "counts"), "token").groupBy("sid").agg(F.collect_list(F.struct("token", "kind")).alias("known"))
    known = distinct.select("sid", "n", "prefix").join(known, "sid")
    index = materialize(known.mapInArrow(_index(threshold), "key long, sid long, n long"), "index")
    full = materialize(index.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "full")
    index = materialize(index.join(full, "key"), "buckets")

    def whole(sids: DataFrame) -> DataFrame:
        """(sid, tokens) of these distinct sids, from the texts."""
        wanted = materialize(sids.join(distinct.select("sid", "d1", "d2", "doc_id", "t"), "sid"), "wanted")
        ids = _few(wanted.select(F.col("t").alias("wt"), F.col("doc_id").alias("wid")))
        chosen = marked.join(ids, (F.col("t") == F.col("wt")) & F.col("doc_id").eqNullSafe(F.col("wid")), "left_semi")
        raw = chosen.select("doc_id", "text").mapInArrow(_sets(size), "d1 long, d2 long, tokens array<long>")
        return materialize(raw.join(wanted.select("sid", "d1", "d2"), ["d1", "d2"]).select("sid", "tokens").dropDuplicates(["sid"]), "sets")

    # crowded buckets: owners meet members
    crowded = index.filter(F.col("m") > crowd)
    owned = materialize(crowded.groupBy("sid").agg(F.max(F.struct("m", "key")).alias("x")).select("sid", F.col("x.key").alias("own")), "owners")
    rooms = crowded.join(owned.select(F.col("own").alias("key")).distinct(), "key")
    parts = rooms.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / PART, F.sum("n") / PART_SHINGLES)).cast("int").alias("parts"))
    rooms = materialize(rooms.join(parts, "key").join(owned, "sid").select("key", "sid", "n", "own", "parts"), "rooms")
    dealt = rooms.join(whole(rooms.select("sid").distinct()), "sid").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = dealt.select("key", F.least("k", "part").alias("i"), F.greatest("k", "part").alias("j"), "part", (F.col("own") == F.col("key")).alias("owner"), "sid", "tokens")
    forests = materialize(units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_units(threshold), "a long, b long"), "forests")

    # all other pairs of a bucket
    member_of = rooms.groupBy("sid").agg(F.first("own").alias("own"), F.collect_set("key").alias("rooms"))
    members = materialize(index.select("key", "sid", "n").join(member_of, "sid", "left"), "members")
    one, two = (members.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("sid", "n", "own", "rooms"))) for side in "ab")
    met = F.coalesce(F.array_contains("rooms_b", F.col("own_a")) | F.array_contains("rooms_a", F.col("own_b")), F.lit(False))
    close = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold
    pairs = one.join(two, (one["key"] == two["key"]) & (F.col("sid_a") < F.col("sid_b")) & close & ~met)
    bounded = materialize(_bounded(pairs.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b")).distinct(), distinct, threshold), "pairs")
    sids = bounded.select(F.col("a").alias("sid")).unionByName(bounded.select(F.col("b").alias("sid"))).distinct()
    links = forests.unionByName(_linked(bounded, whole(sids), threshold))
    return distinct.select("sid", "d1", "d2"), links


def near_sets(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, bits: int = CELL_BITS, crowd: int = CROWD) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = materialize(texts.mapInArrow(_count(shingle, bits), _COUNTED), "counted")
    found, blocks = counted.filter("block is null").select("doc_id", "n", "d1", "d2"), counted.filter("block is not null").select("block", "counts")
    sets, links = set_links(texts, found, blocks, shingle, threshold, bits, crowd)
    groups = found.filter("d1 is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    roots = components(links)
    named = sets.join(groups, ["d1", "d2"]).join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = materialize(named, "roots")
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m")), "least")
    of = materialize(join_hot(named, least, ["root"], F.col("sid"), named.count(), "m").select("d1", "d2", "rows", "component_id"), "named")
    out = join_hot(found, of, ["d1", "d2"], F.xxhash64(*found.columns), found.count(), "rows", F.col("d1").isNotNull())
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("d1").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


