"""Benchmark decontamination, in DataFrame functions alone.

Texts are cut into words of letters, digits and anything beyond ASCII, and lower-cased in A-Z. A benchmark item's windows
are its runs of `size` words, or all its words where it has fewer. The distinct windows are a hash set.

Each document is read once. Its words are exploded next to the array they came from, so a window is a slice of it and
nothing is copied; a word that begins no window is passed over by a look-up of first words, and the window of any other
is hashed and looked up in the set. A hit is verified word by word, so no collision of hashes marks a document. (Look-ups
use the engine's lower case, which merges at least what A-Z does; verification uses A-Z alone.) A word that no text can
hold stands at the end of each document and in the set; its row brings the number of words through the same pass.

Both sets are broadcast when the benchmark has at most `broadcast_windows` windows (its size does not follow the corpus).
Beyond that, hashes of windows are made inside the row, and only (document, place, length, hash) are shuffled, to meet
the set's hashes, each of which is there `SALTS` times, so that a frequent window is as many tasks. The documents with a hit then
meet their text again and are verified as above.

Edge cases: null and empty texts have no words and are clean; null item_ids count as the empty string's item; repeated
rows are judged alike and all returned; items of equal text all count; an empty benchmark leaves every document clean;
extra columns are left alone.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlens.session import fresh, materialize

SIZE = 10
BROADCAST_WINDOWS = 200_000
#: Contaminated documents that are broadcast to be dropped, some 16 bytes each.
BROADCAST_IDS = 500_000
SALTS = 16
_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: No text has this word: its one character separates words.
_END = "\x01"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    for c in string.ascii_uppercase:
        text = F.replace(text, F.lit(c), F.lit(c.lower()))
    return text


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _SEPARATOR), "")


def words(text: Column) -> Column:
    return raw_words(ascii_lower(text))


def _key(gram: Column) -> Column:
    return F.xxhash64(F.lower(gram))


def benchmark_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct windows: len, first (its first word, lower-cased), key, gram (its words), item_ids; and the end mark's row."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    runs = w.select("item", n.alias("len"), F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.slice(F.col("w"), i + 1, n))).alias("run"))
    grams = runs.groupBy("len", "run").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    grams = grams.select("len", F.lower(F.col("run")[0]).alias("first"), F.array_join("run", " ").alias("gram"), "item_ids")
    end = items.sparkSession.range(1).select(F.lit(0).alias("len"), F.lit(_END).alias("first"), F.lit("").alias("gram"), F.array().cast("array<string>").alias("item_ids"))
    return grams.unionByName(end).withColumn("key", _key(F.col("gram")))


def scan(docs: DataFrame, items: DataFrame, size: int = SIZE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per distinct row of docs (doc_id, text): doc_id, mark (a hash of text), copies, n_words, hits (array of len, pos), item_ids."""
    table = materialize(benchmark_windows(items, size), "benchmark")
    raw = docs.select("doc_id", F.xxhash64("text").alias("mark"), raw_words(F.col("text")).alias("w"))
    return _scan_beside(raw, table) if table.count() <= broadcast_windows else _scan_shuffled(raw, table)


def _verified(seen: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, mark, pos, len, seen) that are in the set, with item_ids."""
    keyed = seen.withColumn("key", _key(F.col("seen")))
    # equality both ways round, so that it stays a test of what the hash has found and does not become a join key
    exact = ascii_lower(F.col("seen"))
    return keyed.join(table, ["len", "key"]).filter(exact.startswith(F.col("gram")) & F.startswith(F.col("gram"), exact))


_GRAM = lambda: F.concat_ws(" ", F.slice("w", F.col("pos") + 1, F.col("len")))


def _scan_beside(raw: DataFrame, table: DataFrame) -> DataFrame:
    firsts = table.groupBy("first").agg(F.collect_set("len").alias("lens"))
    each = raw.select("doc_id", "mark", "w", F.posexplode(F.concat("w", F.array(F.lit(_END)))).alias("pos", "x"))
    begun = each.join(F.broadcast(firsts), F.lower("x") == F.col("first")).select("doc_id", "mark", "w", "pos", F.explode("lens").alias("len"))
    seen = begun.filter(F.col("pos") + F.col("len") <= F.size("w")).select("doc_id", "mark", "pos", "len", _GRAM().alias("seen"))
    found = _verified(seen, F.broadcast(table.select("len", "key", "gram", "item_ids")))
    hit = F.col("len") > 0
    return found.groupBy("doc_id", "mark").agg(
        F.count(F.when(~hit, 1)).alias("copies"),
        F.max(F.when(~hit, F.col("pos"))).cast("long").alias("n_words"),
        F.collect_set(F.when(hit, F.struct("len", "pos"))).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )


def _window(n: int):
    return lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), _key(F.array_join(F.slice("w", i + 1, F.lit(n)), " ")).alias("key"))


def _scan_shuffled(raw: DataFrame, table: DataFrame) -> DataFrame:
    real = table.filter("len > 0")
    lens = [r["len"] for r in real.select("len").distinct().collect()]  # at most `size` of them
    keys = F.flatten(
        F.array(
            *(
                F.when(
                    F.size("w") >= n,
                    F.transform(F.sequence(F.lit(0), F.size("w") - n), _window(n)),
                ).otherwise(F.array().cast("array<struct<pos:int,len:int,key:bigint>>"))
                for n in lens
            )
        )
    )
    each = raw.select("doc_id", "mark", F.explode(keys).alias("x")).select("doc_id", "mark", "x.*").withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)))
    known = real.select("len", "key").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    place = each.join(known, ["len", "key", "salt"], "left_semi").groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_set(F.struct("len", "pos")).alias("places"))
    total = raw.groupBy("doc_id", "mark").agg(F.count("*").alias("copies"), F.max(F.size("w")).cast("long").alias("n_words"))
    beside = (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("mark") == F.col("_mark"))
    seen = raw.join(place, beside).select("doc_id", "mark", "w", F.explode("places").alias("x")).select("doc_id", "mark", "w", "x.*")
    found = _verified(seen.select("doc_id", "mark", "pos", "len", _GRAM().alias("seen")), real.select("len", "key", "gram", "item_ids"))
    hits = found.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(
        F.collect_set(F.struct("len", "pos")).alias("hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids")
    )
    out = total.join(hits, beside, "left")
    none = F.array().cast("array<struct<len:int,pos:int>>")
    return out.select("doc_id", "mark", "copies", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def covered(hits: Column) -> Column:
    """Places of the words inside any hit."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1))))


def judge(docs: DataFrame, items: DataFrame, size: int = SIZE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, item_ids, items_sha256, contaminated, mark."""
    found = scan(docs, items, size, broadcast_windows)
    each = found.select("doc_id", "mark", "n_words", F.size(covered(F.col("hits"))).cast("long").alias("n_hit"), "item_ids", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return each.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        "item_ids",
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "mark",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """docs without the rows in which a benchmark window occurs; all else stays as it is. The few rows that go are broadcast, if few they are."""
    i, m = fresh(docs, "id", "mark")
    found = scan(docs, items, size, broadcast_windows).filter(F.size("hits") > 0)
    bad = materialize(found.select(F.col("doc_id").alias(i), F.col("mark").alias(m)), "contaminated")
    held = F.broadcast(bad) if bad.count() <= broadcast_ids else bad
    return docs.join(held, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64(docs["text"]) == F.col(m)), "left_anti")


def mask_spans(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id and kept, the words outside every hit (lower-cased, joined by a space)."""
    hits = scan(docs, items, size).filter(F.size("hits") > 0).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), covered(F.col("hits")).alias("gone"))
    base = docs.select("doc_id", F.xxhash64("text").alias("mark"), words(F.col("text")).alias("w"))
    joined = base.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    left = F.when(F.col("gone").isNull(), F.col("w")).otherwise(F.filter("w", lambda x, i: ~F.array_contains(F.col("gone"), i)))
    return joined.select("doc_id", F.array_join(left, " ").alias("kept"))
