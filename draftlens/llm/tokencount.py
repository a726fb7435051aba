"""Token counts by a whole-token shortcut.

Offline, each vocabulary string that ends a word is encoded alone by the library; those that come back as the one token
they are form the whole-token set. A text falls into pieces at white space, which no token of this tokenizer spans; a
piece falls into pre-tokens. A pre-token in the set counts one, at once; only the rest are merged, by the library.
Counts of pieces are remembered in each worker, in a table of bounded size.

The shortcut is used for pieces whose characters, and their lower-case forms, all lie in the range where composition and character
class are settled (below U+0250, no controls) and that hold no "<|", which could begin a special string. Any other piece goes to the
library whole, and its count is remembered like any other; only blanks, tabs and line ends cut pieces, which no character joins across.
Both ways give the library's own count.

Edge cases: null and empty texts have no bytes and no tokens; a text of white space has no tokens; rows are returned one
for one, repeated or not; extra columns are left alone.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlens.llm.tokenizer_files import default_path, library
from draftlens.session import ship_package

LIMIT = 2048
#: Pieces that a worker remembers.
REMEMBERED = 400_000
_PLAIN_END = 0x250
_BLANK = re.compile("[ \t\n\r]+")
#: Letters below U+0250 whose lower-case form is not one character below it.
_LEAVING = "".join(chr(c) for c in range(_PLAIN_END) if not (len(chr(c).lower()) == 1 and ord(chr(c).lower()) < _PLAIN_END))
_HARD = re.compile(f"[^\t\n\r\x20-\x7e\xa1-ɏ]|[{_LEAVING}]|<\\|")


def _pretoken_pattern() -> re.Pattern:
    """Contractions, letter runs, single numerals, runs of anything else, for lower-cased characters below U+0250."""
    kinds = {c: unicodedata.category(chr(c))[0] for c in range(_PLAIN_END)}
    letters = "".join(re.escape(chr(c)) for c, k in kinds.items() if k == "L")
    numbers = "".join(re.escape(chr(c)) for c, k in kinds.items() if k == "N")
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, back to bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}


def whole_tokens(path: str, suffix: str = "</w>") -> frozenset[str]:
    """Vocabulary strings that end a word and that the library, given them alone, returns as the one token they are."""
    tokenizer, letters = library(path), _byte_letters()
    names, texts = [], []
    for name, number in tokenizer.get_vocab(with_added_tokens=False).items():
        body = name[: -len(suffix)] if name.endswith(suffix) else ""
        if body and all(c in letters for c in body):
            try:
                text = bytes(letters[c] for c in body).decode()
            except UnicodeDecodeError:
                continue
            names.append(number)
            texts.append(text)
    encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for n, t, e in zip(names, texts, encoded, strict=True) if e.ids == [n])


class Counter:
    """Tokens of texts by the shortcut, with the library for the rest."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.library, self.whole, self.pattern = library(path), whole_tokens(path), _pretoken_pattern()
        self.known: dict[str, int] = {}
        self.merged: dict[str, int] = {}
        self.hard: dict[str, int] = {}
        self.remembered = remembered

    def merge(self, pretoken: str) -> int:
        n = self.merged.get(pretoken)
        if n is None:
            n = len(self.library.encode(pretoken, add_special_tokens=False).ids)
            if len(self.merged) < self.remembered:
                self.merged[pretoken] = n
        return n

    def piece(self, piece: str) -> int:
        n = sum(1 if p in self.whole else self.merge(p) for p in self.pattern.findall(piece))
        if len(self.known) < self.remembered and len(piece) < 64:
            self.known[piece] = n
        return n

    def mixed(self, text: str) -> int:
        """Tokens of a text that holds pieces which only the library can judge."""
        known, total = self.known, 0
        for piece in _BLANK.split(text):
            if not piece:
                continue
            if _HARD.search(piece):
                n = self.hard.get(piece)
                if n is None:
                    n = len(self.library.encode(piece, add_special_tokens=False).ids)
                    if len(self.hard) < self.remembered and len(piece) < 64:
                        self.hard[piece] = n
            else:
                low = piece.lower()
                n = known.get(low)
                n = self.piece(low) if n is None else n
            total += n
        return total

    def count(self, text: str) -> int:
        if _HARD.search(text):
            return self.mixed(text)
        known, total = self.known, 0
        for piece in text.lower().split():
            n = known.get(piece)
            total += self.piece(piece) if n is None else n
        return total


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            texts = batch.column(1)
            n = [count(x.as_py() or "") for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit."""
    ship_package(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    path = vocabulary or default_path("word_bpe_49k.json")
    counted = base.mapInArrow(_counts(path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
