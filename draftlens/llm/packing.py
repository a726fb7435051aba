"""Packing token ids of documents into sequences by first-fit decreasing, group by group.

Tokenising and cutting happen in one scan: a document's ids, its end id included, are cut at multiples of the capacity,
and of each piece only its place, length and checksum go on. Pieces are dealt to groups at random (by a hash, so that a
task run again deals the same way). Within a group, pieces go by falling length to the first sequence with room, found by
a tournament tree over what room the sequences have left: a node holds the most room below it, so the search descends to
the leftmost leaf that fits, in a logarithm of the number of sequences. A piece of full length is a sequence of its own.

Edge cases: null and empty texts are the end id alone; texts of any length, of white space alone too, are encoded whole; rows that repeat a doc_id are packed like any other and told apart
only by their place; ties in length are broken by doc_id, start and checksum; extra columns are left alone; an empty
table gives no pieces. Sequence ids are the group's number in the high bits and the sequence's in the low 32.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlens.llm.tokenizer_files import byte_ranks, default_path, library
from draftlens.session import materialize, ship_package

CAPACITY = 2048
GROUP = 20_000
#: Token ids in one batch of pieces.
IDS_AT_ONCE = 500_000
END_ID = 1
#: Texts of these characters alone mean the same to both libraries, whatever Unicode tables they were built with.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]")
_SPECIAL = "<|endoftext|>"
_LONG_BLANK = re.compile(r"\s{1000}")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_ids(text: str, vocabulary: str, ranks: str | None, pattern: str) -> np.ndarray:
    """The ids of the library for vocabulary, by way of the same vocabulary's ranks where that is safe.

    Long runs of white space go to the library too: the faster one's pattern backtracks over them.
    """
    if ranks is None or _SPECIAL in text or _PLAIN.search(text) or _LONG_BLANK.search(text):
        return np.array(library(vocabulary).encode(text, add_special_tokens=False).ids, dtype="<u4")
    try:
        return byte_ranks(ranks, pattern).encode_to_numpy(text).astype("<u4", copy=False)
    except ValueError:  # the pattern's own limits
        return np.array(library(vocabulary).encode(text, add_special_tokens=False).ids, dtype="<u4")


def _pieces(vocabulary: str, ranks: str | None, pattern: str, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], dtype="<u4")

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def rows(of: pa.Array, pieces: list[tuple[int, int, int, int, int]], held: list[np.ndarray]) -> pa.RecordBatch:
        row, *numbers = (pa.array(x, pa.int64()) for x in (zip(*pieces, strict=True) if pieces else [()] * 5))
        columns = [of.take(row), *numbers]
        if with_ids:
            ends = np.concatenate([[0], np.cumsum([p[2] for p in pieces], dtype=np.int64)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held).view(np.int32) if held else [], pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, held, n_held = [], [], 0
            for k, text in enumerate(batch.column(1)):
                ids = np.concatenate([token_ids(text.as_py() or "", vocabulary, ranks, pattern), end])
                n = len(ids)
                for s in range(0, n, capacity):
                    own = ids[s : s + capacity]
                    pieces.append((k, s, len(own), zlib.crc32(own.tobytes()), n))
                    if with_ids:
                        held.append(own)
                        n_held += len(own)
                        if n_held >= IDS_AT_ONCE:
                            yield rows(batch.column(0), pieces, held)
                            pieces, held, n_held = [], [], 0
            yield rows(batch.column(0), pieces, held)

    return run


class Rooms:
    """A tournament tree over bins: the most room in each subtree; take() gives the first bin with room for a piece."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.size)

    def take(self, length: int) -> int:
        most, node = self.most, 1
        while node < self.size:
            node *= 2
            if most[node] < length:
                node += 1
        bin_ = node - self.size
        most[node] -= length
        node //= 2
        while node:
            left, right = most[2 * node], most[2 * node + 1]
            most[node] = left if left > right else right
            node //= 2
        return bin_


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths must fall."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    full = int((lengths == capacity).sum())
    bins[:full] = np.arange(full)
    rooms, used = Rooms(max(1, len(lengths) - full), capacity), {}
    for k, n in enumerate(lengths[full:].tolist(), full):
        b = rooms.take(n)
        bins[k], offsets[k] = full + b, used.get(b, 0)
        used[b] = offsets[k] + n
    return bins, offsets


def _pack(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], na_position="last", kind="stable")
        bins, offsets = first_fit_decreasing(out["length"].to_numpy(), capacity)
        return out.assign(sequence_id=(out["grp"].to_numpy() << 32) + bins, offset=offsets).drop(columns="grp")

    return run


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    ranks: str | None = None,
    capacity: int = CAPACITY,
    group: int = GROUP,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; and with_ids the piece's ids, an array.

    Groups are a tenth as large with ids, so that a group's ids fit a worker (GROUP / 10 * capacity * 4 bytes, 16 MB).
    """
    import public_tokenizers

    spark = docs.sparkSession
    ship_package(spark)
    if vocabulary is None:
        vocabulary, ranks = default_path("byte_bpe_50k.json"), default_path("byte_bpe_50k.tiktoken")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    pieces = materialize(base.mapInArrow(_pieces(vocabulary, ranks, public_tokenizers.PATTERN, capacity, end_id, with_ids), schema), "pieces")
    groups = max(1, -(-pieces.count() // (max(1, group // 10) if with_ids else group)))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    if with_ids:  # partitions grow in number with the ids, not in size
        dealt = dealt.repartition(groups, "grp")
    return dealt.groupBy("grp").applyInPandas(_pack(capacity), schema + ", sequence_id long, offset long")
