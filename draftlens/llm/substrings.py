"""Substring deduplication behind a count-min prefilter.

A window is `size` consecutive words of one document. Every word covered by a window whose word sequence also starts
in a document with a smaller doc_id goes. Windows are judged on the input, not on what is left.

How it runs
1. One scan hashes every window, and gives each document a digest (SHA-256 of its words). Documents of the same words
   are one from here on, that of the smallest doc_id; the others are passed over in the scans below. A window is filed under its minimiser, the least hash among the runs of `stem` words
   in it: equal windows have equal minimisers, and neighbours mostly share one, so a document has about one key for
   13 words.
2. Count-min sketch of the keys, two rows of cells, 8 to 16 times as many as there are keys. A partition counts its
   keys in arrays of counters that stop at two, and writes them in blocks of `1 << BLOCK_BITS` cells, as bit arrays or
   as lists of cells, whichever is smaller. Blocks of one range of cells are added up in one array as they stream by; no
   task holds more than one such array and a bounded number of keys. The count of a key's cell is never below the number
   of documents with the key, nor that below the number with the window, so a window whose estimate is 1 can't be
   repeated. The merged sketch, a bit for each cell that reaches two, is broadcast if it takes at most
   `SKETCH_BROADCAST` bytes, as its size is known by then, and a second scan looks its keys up; beyond that keys
   are joined with the cells, and what is left of them with the texts.
3. Second pass: windows estimated repeated, and no others, get a 128-bit BLAKE2 digest of their words and are grouped by
   it, so that groups are those of equal words. The smallest doc_id of each group is kept. Groups are counted before
   their rows are shuffled again; frequent windows are met by broadcast (see spreading.py).

Edge cases: a null or empty text has no words; a text of fewer than `size` words loses nothing; of rows that repeat a
doc_id none counts as smaller than another; null doc_ids are never the smaller one, and their rows lose what repeats
nowhere smaller, that is nothing; extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlens.llm.spreading import join_hot
from draftlens.llm.wordhash import Words, as_long, mix, sliding_min, slices
from draftlens.session import fresh, materialize, ship_package

SIZE = 50
STEM = 25
#: Rows of the sketch; the most bits of a cell's number; cells of a block; keys that a task counts at a time.
SKETCH_ROWS = 2
SKETCH_BITS = 40
BLOCK_BITS = 18
KEYS_AT_ONCE = 2_000_000
#: Rows of a batch of windows.
PART = 200_000
SKETCH_BROADCAST = 64_000_000
#: Copies of other documents (doc_id and a mark) that are broadcast to be passed over; more are joined.
COPIES_BROADCAST = 500_000


def _keys(words: Words, size: int, stem: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows, and their minimisers."""
    at = words.inside(size)
    if not len(at):
        return at, np.zeros(0, dtype=np.uint64)
    return at, sliding_min(words.windows(stem, 1), size - stem + 1)[at]


def _joined(words: Words, data: bytes, d: int, keep: np.ndarray | None = None) -> bytes:
    """The words of document d, or those kept, joined by one space."""
    a, b = words.first[d], words.first[d + 1]
    pairs = zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)
    if keep is None:
        return b" ".join([data[s:e] for s, e in pairs])
    return b" ".join([data[s:e] for (s, e), k in zip(pairs, keep.tolist(), strict=True) if k])


def _signatures(size: int, stem: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in slices(batch.column(1)):
                words = Words(buf, offsets)
                at, keys = _keys(words, size, stem)
                doc = words.doc[at] if len(at) else np.zeros(0, dtype=np.int64)
                order = np.lexsort((keys, doc))
                doc, keys = doc[order], keys[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
                doc, keys = doc[new], keys[new]
                n, data = b - a, buf.tobytes()
                ends = np.searchsorted(doc, np.arange(n + 1))
                digests = [hashlib.sha256(_joined(words, data, d)).digest() for d in range(n)]
                own = np.frombuffer(b"".join(digests), dtype="<i8").reshape(n, 4)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n),
                        batch.column(2).slice(a, n),
                        pa.array(words.count, pa.int64()),
                        pa.array(own[:, 0].copy()),
                        pa.array(own[:, 1].copy()),
                        pa.array([x.hex() for x in digests], pa.string()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(as_long(keys))),
                    ],
                    names=["doc_id", "mark", "n_words", "d1", "d2", "sha", "keys"],
                )

    return run


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each key in a row of the sketch."""
    return mix(keys + np.uint64(row)) >> np.uint64(64 - bits)


def _partial_sketch(bits: int):
    """Lists of keys -> blocks (row, block, dense, data) of the counts of bounded runs of keys."""
    low = min(bits, BLOCK_BITS)

    def blocks(keys: np.ndarray) -> Iterator[tuple[int, int, bool, bytes]]:
        for row in range(SKETCH_ROWS):
            cells, n = np.unique(_cells(keys, row, bits), return_counts=True)
            block = (cells >> np.uint64(low)).astype(np.int64)
            edges = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist()
            inner, twice = (cells & np.uint64((1 << low) - 1)).astype(np.uint32), n > 1
            for s, e in zip(edges, [*edges[1:], len(cells)], strict=True):
                if 4 * (e - s) > (1 << low) // 4:
                    count = np.zeros((2, 1 << low), dtype=bool)
                    count[0, inner[s:e]], count[1, inner[s:e][twice[s:e]]] = True, True
                    yield row, int(block[s]), True, np.packbits(count).tobytes()
                else:
                    yield row, int(block[s]), False, (inner[s:e] * np.uint32(2) + twice[s:e]).astype("<u4").tobytes()

    def rows(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for got in _runs(blocks(np.concatenate(keys)), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["row", "block", "dense", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                keys = batch.column(0).slice(at, 64).flatten().to_numpy().view(np.uint64)
                held.append(keys)
                n += len(keys)
                if n >= KEYS_AT_ONCE:
                    yield from rows(held)
                    held, n = [], 0
        if n:
            yield from rows(held)

    return run


def _runs(items: Iterator, size: int) -> Iterator[list]:
    out = []
    for x in items:
        out.append(x)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def _merged_sketch(bits: int):
    """Blocks in the order of (row, block) -> a bit array for each block, of the cells that reach two."""
    low = min(bits, BLOCK_BITS)

    def give(at: tuple[int, int], twice: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["row", "block", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, np.zeros(1 << low, dtype=bool), np.zeros(1 << low, dtype=bool)
        for batch in batches:
            for row, block, dense, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (row, block):
                    if at is not None and twice.any():
                        yield give(at, twice)
                    at = (row, block)
                    once[:], twice[:] = False, False
                if dense:
                    own, own_twice = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=2 << low).reshape(2, -1).view(bool)
                    twice |= own_twice | (once & own)
                    once |= own
                else:
                    cells = np.frombuffer(data, dtype="<u4")
                    place = cells >> 1
                    twice[place] |= once[place] | ((cells & 1) == 1)
                    once[place] = True
        if at is not None and twice.any():
            yield give(at, twice)

    return run


def sketch(keys: DataFrame, bits: int) -> DataFrame:
    """The merged count-min sketch of the lists in keys (keys array<long>): row, block, bits."""
    parts = keys.select("keys").mapInArrow(_partial_sketch(bits), "row int, block long, dense boolean, data binary")
    return parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(_merged_sketch(bits), "row int, block long, bits binary")


def _estimated(keys: np.ndarray, tables: list, bits: int) -> np.ndarray:
    """Which keys are estimated at two or more."""
    low = min(bits, BLOCK_BITS)
    out = np.ones(len(keys), dtype=bool)
    for row, (blocks, data) in enumerate(tables):
        if not len(blocks):
            return np.zeros(len(keys), dtype=bool)
        cells = _cells(keys, row, bits)
        block = (cells >> np.uint64(low)).astype(np.int64)
        at = np.minimum(np.searchsorted(blocks, block), len(blocks) - 1)
        inner = (cells & np.uint64((1 << low) - 1)).astype(np.int64)
        out &= (blocks[at] == block) & ((data[at, inner >> 3] >> (7 - (inner & 7)).astype(np.uint8)) & 1 == 1)
    return out


def _tables(made: DataFrame, bits: int) -> list:
    """The merged sketch in the driver: for each row the blocks that have bits, and these."""
    width, out = (1 << min(bits, BLOCK_BITS)) + 7 >> 3, []
    for row in range(SKETCH_ROWS):
        got = made.filter(F.col("row") == row).select("block", "bits").toArrow().sort_by("block")
        out.append((got["block"].to_numpy().astype(np.int64), np.frombuffer(b"".join(got["bits"].to_pylist()), dtype=np.uint8).reshape(-1, width)))
    return out


def _explode_cells(bits: int):
    """Merged blocks -> the cells that reach two."""
    low = min(bits, BLOCK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                inner = np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=1 << low))
                yield pa.RecordBatch.from_arrays([pa.array((block << low) + inner, pa.int64())], names=["cell"])

    return run


def _key_cells(bits: int, row: int):
    """(doc_id, mark, key) -> the same with the key's cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _cells(batch.column(2).to_numpy().view(np.uint64), row, bits).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=[*batch.schema.names, "cell"])

    return run


def repeated_keys(docs: DataFrame, made: DataFrame, bits: int) -> DataFrame:
    """docs (doc_id, mark, keys) with the keys that the merged sketch estimates at two or more, by joins with its cells."""
    out = docs.select("doc_id", "mark", F.explode("keys").alias("key"))
    for row in range(SKETCH_ROWS):
        full = made.filter(F.col("row") == row).select("block", "bits").mapInArrow(_explode_cells(bits), "cell long")
        out = out.mapInArrow(_key_cells(bits, row), "doc_id long, mark int, key long, cell long").join(full, "cell", "left_semi").drop("cell")
    return out.groupBy("doc_id", "mark").agg(F.collect_set("key").alias("keys"))


def _digests(words: Words, data: bytes, at: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of the windows at the words `at`, of their words joined by one space."""
    out = []
    edges = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])).tolist()
    for s, e in zip(edges, [*edges[1:], len(at)], strict=True):
        d = int(doc[s])
        first, last = words.first[d], words.first[d + 1]
        text = _joined(words, data, d)
        ends = np.cumsum(words.end[first:last] - words.start[first:last] + 1) - 1
        begin = np.append(0, ends[:-1] + 1)
        k = at[s:e] - first
        out += [hashlib.blake2b(text[x:y], digest_size=16).digest() for x, y in zip(begin[k].tolist(), ends[k + size - 1].tolist(), strict=True)]
    both = np.frombuffer(b"".join(out), dtype="<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _windows(size: int, stem: int, bits: int = 0, held=None):
    """(doc_id, mark, text, keys) -> the windows whose minimisers are among keys, or estimated repeated by the tables held: (h1, h2, doc_id, mark, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in slices(batch.column(2), 1_000_000):
                words = Words(buf, offsets)
                at, keys = _keys(words, size, stem)
                if not len(at):
                    continue
                doc = words.doc[at]
                if held is not None:
                    hit = _estimated(keys, held.value, bits)
                else:
                    edges = np.searchsorted(doc, np.arange(b - a + 1))
                    hit = np.zeros(len(at), dtype=bool)
                    for d in np.flatnonzero(np.diff(edges)).tolist():
                        mine = batch.column(3).slice(a + d, 1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                        hit[edges[d] : edges[d + 1]] = np.isin(keys[edges[d] : edges[d + 1]], mine)
                at, doc = at[hit], doc[hit]
                if not len(at):
                    continue
                h1, h2 = _digests(words, buf.tobytes(), at, doc, size)
                # a window that a document repeats is one row, with all its places
                order = np.lexsort((at, h2, h1, doc))
                at, doc, h1, h2 = at[order], doc[order], h1[order], h2[order]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                start = np.flatnonzero(new)
                place = at - words.first[doc]
                ids, marks = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                for s in range(0, len(start), PART):
                    some = start[s : s + PART]
                    end = start[s + PART] if s + PART < len(start) else len(at)
                    places = pa.ListArray.from_arrays(pa.array(np.append(some, end) - some[0], pa.int32()), pa.array(place[some[0] : end], pa.int32()))
                    of = pa.array(doc[some])
                    yield pa.RecordBatch.from_arrays([pa.array(h1[some]), pa.array(h2[some]), ids.take(of), marks.take(of), places], names=["h1", "h2", "doc_id", "mark", "pos"])

    return run


def _kept(n: int, at: np.ndarray, size: int) -> np.ndarray:
    """Which of n words no window that starts at one of `at` covers."""
    step = np.zeros(n + size + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return np.cumsum(step)[:n] == 0


def _rest(words: Words, data: bytes, d: int, keep: np.ndarray) -> str:
    """The text of document d without the other words; the spaces before a removed word go with it."""
    f, lo, hi = words.first[d], int(words.offsets[d]), int(words.offsets[d + 1])
    out, last = [], lo
    for i in np.flatnonzero(~keep).tolist():
        s = int(words.end[f + i - 1]) if i else lo
        out.append(data[last:s] if s > last else b"")
        last = max(last, int(words.end[f + i]))
    return b"".join([*out, data[last:hi]]).decode("utf-8", "replace").lstrip()


def _rewrite(size: int, text: int, n_chars: int | None, keep_emptied: bool):
    """(columns of docs, whole, pos) -> the columns, with what is left of texts that lose words at pos or as whole copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b, buf, offsets in slices(whole.column(text)):
                batch = whole.slice(a, b - a)
                copy = batch.column(batch.num_columns - 2).fill_null(False).to_numpy(zero_copy_only=False)
                pos = batch.column(batch.num_columns - 1)
                hit = copy | pos.is_valid().to_numpy(zero_copy_only=False)
                columns = batch.columns[:-2]
                if hit.any():
                    words, data, left = Words(buf, offsets, hashes=False), buf.tobytes(), []
                    for d in np.flatnonzero(hit).tolist():
                        at = np.zeros(0, dtype=np.int64) if copy[d] else pos.slice(d, 1).flatten().to_numpy(zero_copy_only=False)
                        left.append("" if copy[d] else _rest(words, data, d, _kept(int(words.count[d]), at, size)))
                    put = lambda c, values: pc.replace_with_mask(columns[c], pa.array(hit), pa.array(values).cast(columns[c].type))  # noqa: B023, E731
                    columns[text] = put(text, left)
                    if n_chars is not None:
                        columns[n_chars] = put(n_chars, [len(x) for x in left])
                    if not keep_emptied:
                        stays = np.ones(len(hit), dtype=bool)
                        stays[hit] = [bool(x.strip()) for x in left]
                        columns = [c.filter(pa.array(stays)) for c in columns]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-2])

    return run


def _cut(size: int, with_text: bool):
    """(doc_id, mark, text, positions) -> what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, removed, shas, texts = [], [], [], []
            for a, b, buf, offsets in slices(batch.column(2)):
                words, data = Words(buf, offsets, hashes=False), buf.tobytes()
                for d in range(b - a):
                    n = int(words.count[d])
                    keep = _kept(n, batch.column(3).slice(a + d, 1).flatten().to_numpy(zero_copy_only=False), size)
                    rows.append(a + d)
                    removed.append(n - int(keep.sum()))
                    shas.append(hashlib.sha256(_joined(words, data, d, keep)).hexdigest())
                    if with_text:
                        texts.append(_rest(words, data, d, keep))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1)), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts if with_text else [None] * len(rows), pa.string())],
                names=["doc_id", "mark", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def _found(docs: DataFrame, size: int, stem: int, sketch_bits: int | None, broadcast_bytes: int, broadcast_copies: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """named: each row's doc_id, mark, n_words, sha, and least and least_mark of the document of the same words; texts: those to look at; marked: their places to cut."""
    if not 0 < stem <= size:
        raise ValueError("stem must lie between 1 and size")
    spark = docs.sparkSession
    ship_package(spark)
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.hash(text).alias("mark"))  # mark tells rows of one doc_id apart
    sig = materialize(base.mapInArrow(_signatures(size, stem), "doc_id long, mark int, n_words long, d1 long, d2 long, sha string, keys array<long>"), "windows")

    # documents of the same words are one, under the smallest doc_id
    row = ["doc_id", "mark"]
    eligible = (F.col("n_words") >= size) & F.col("doc_id").isNotNull()
    least = sig.filter(eligible).groupBy("d1", "d2").agg(F.min(F.struct(*row)).alias("x"), F.count("*").alias("n"))
    least = materialize(least.select("d1", "d2", "n", F.col("x.doc_id").alias("least"), F.col("x.mark").alias("least_mark")), "distinct")
    named = materialize(join_hot(sig.drop("keys"), least, ["d1", "d2"], F.xxhash64(*row, "n_words"), sig.count(), eligible=eligible), "named")
    second = (F.col("doc_id") != F.col("least")) | (F.col("mark") != F.col("least_mark"))
    copies = named.filter(eligible & second).select(*row).distinct()
    held = F.broadcast(copies) if copies.count() <= broadcast_copies else copies
    own = sig.filter(eligible).select(*row, "keys").join(held, row, "left_anti")
    bits = sketch_bits
    if bits is None:
        bits = min(SKETCH_BITS, max(10, (8 * (own.agg(F.sum(F.size("keys"))).first()[0] or 0)).bit_length()))
    made = materialize(sketch(own, bits), "sketch")
    schema, texts = "h1 long, h2 long, doc_id long, mark int, pos array<int>", base.filter("doc_id is not null").select(*row, "text").join(held, row, "left_anti")
    if (made.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) <= broadcast_bytes:
        rows = texts.mapInArrow(_windows(size, stem, bits, spark.sparkContext.broadcast(_tables(made, bits))), schema)
    else:
        rows = texts.join(repeated_keys(own, made, bits), row).select(*row, "text", "keys").mapInArrow(_windows(size, stem), schema)
    rows = materialize(rows, "repeated")

    groups = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("x"), F.count("*").alias("n")).filter("m < x").drop("x")
    met = join_hot(rows, materialize(groups, "groups"), ["h1", "h2"], F.xxhash64(*row, "h1"), rows.count())
    marked = met.filter(F.col("doc_id") > F.col("m")).groupBy(*row).agg(F.array_distinct(F.flatten(F.collect_list("pos"))).alias("pos"))
    return named, texts, marked


def find_repeats(
    docs: DataFrame, size: int = SIZE, stem: int = STEM, sketch_bits: int | None = None, with_text: bool = False, broadcast_bytes: int = SKETCH_BROADCAST, broadcast_copies: int = COPIES_BROADCAST
) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, and mark (a hash of text), kept_text.

    kept_text is null where nothing was removed; without with_text it is so for all but whole copies.
    """
    named, texts, marked = _found(docs, size, stem, sketch_bits, broadcast_bytes, broadcast_copies)
    row = ["doc_id", "mark"]
    cut = texts.join(marked, row).mapInArrow(_cut(size, with_text), "doc_id long, mark int, n_removed long, kept_sha256 string, kept_text string")
    cut = cut.groupBy(*row).agg(*(F.first(c).alias(c) for c in ("n_removed", "kept_sha256", "kept_text")))
    empty = hashlib.sha256(b"").hexdigest()
    copy = F.col("least").isNotNull() & (F.col("doc_id") > F.col("least"))
    return named.join(cut.withColumnRenamed("mark", "least_mark"), ["doc_id", "least_mark"], "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        "mark",
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )


def remove_repeats(
    docs: DataFrame,
    keep_emptied: bool = True,
    size: int = SIZE,
    stem: int = STEM,
    sketch_bits: int | None = None,
    broadcast_bytes: int = SKETCH_BROADCAST,
    broadcast_copies: int = COPIES_BROADCAST,
) -> DataFrame:
    """docs with repeated words cut from text (and n_chars, if there, counted anew); other columns stay, and rows, save those that lose all
    their words where keep_emptied is false (rows that had none before stay). Texts are shuffled once, to meet their places."""
    named, _, marked = _found(docs, size, stem, sketch_bits, broadcast_bytes, broadcast_copies)
    places = named.join(marked.withColumnRenamed("mark", "least_mark"), ["doc_id", "least_mark"], "left")
    i, m, w, p = fresh(docs, "id", "mark", "whole", "pos")
    whole = F.col("least").isNotNull() & (F.col("doc_id") > F.col("least"))
    places = places.select(F.col("doc_id").alias(i), F.col("mark").alias(m), whole.alias(w), F.col("pos").alias(p)).filter(F.col(w) | F.col(p).isNotNull()).dropDuplicates([i, m])
    met = docs.join(places, (F.col("doc_id").cast("long") == F.col(i)) & (F.hash(docs["text"].cast("string")) == F.col(m)), "left").select(*docs.columns, w, p)
    n_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return met.mapInArrow(_rewrite(size, docs.columns.index("text"), n_chars, keep_emptied), docs.schema)
