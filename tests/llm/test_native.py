"""Preference formatting and benchmark decontamination, with their edge cases."""

from __future__ import annotations

import hashlib
import re

from draftlens.llm import chat, decontam

TURNS = "conv_id long, turn long, role string, text string, pair_id string"


def formatted(spark, rows):
    got = chat.format_preferences(chat.neighbour_pairs(spark.createDataFrame([(*r, "x") for r in rows], TURNS))).collect()
    return {r["pair_id"]: r for r in got}


def test_common_prefix_and_masks(spark):
    got = formatted(spark, [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "why")])[0]
    assert got["n_prompt_turns"] == 1 and got["prompt"] == "<|user|>\nhi<|end|>\n"
    assert got["chosen"] == "<|assistant|>\nyes<|end|>\n" and got["chosen_mask"] == "14:0,11:1"
    assert got["rejected"] == "<|assistant|>\nno<|end|>\n<|user|>\nwhy<|end|>\n" and got["rejected_mask"] == "14:0,10:1,20:0"


def test_one_begins_the_other_and_equal_ones(spark):
    rows = [(2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", "q"), (5, 0, "user", "q")]
    got = formatted(spark, rows)
    assert (got[1]["n_prompt_turns"], got[1]["chosen"], got[1]["rejected_mask"]) == (1, "", "14:0,9:1")
    assert (got[2]["n_prompt_turns"], got[2]["chosen"], got[2]["rejected"]) == (1, "", "")


def test_nulls_alone_and_repeated_turns(spark):
    got = formatted(spark, [(6, 0, None, None), (6, 0, None, None), (None, 0, "user", "lost"), (9, None, "user", ""), (8, 1, "assistant", "x" * 50_000)])
    assert set(got) == {3, 4} and got[3]["rejected_id"] is None
    assert got[3]["chosen"] == "<||>\n<|end|>\n" * 2 and got[3]["n_prompt_turns"] == 0
    assert len(got[4]["chosen"]) == 50_000 + 14 + 8


def test_empty_conversations(spark):
    assert formatted(spark, []) == {}


def test_ids_beyond_doubles_and_below_zero(spark):
    big = 2**60
    rows = [(i, 0, "user", str(i)) for i in (big, big + 1, big + 2, big + 3, -1, -2, -3, 2**63 - 1)]
    got = formatted(spark, rows)
    assert {k: (r["chosen_id"], r["rejected_id"]) for k, r in got.items()} == {
        big // 2: (big, big + 1),
        big // 2 + 1: (big + 2, big + 3),
        -1: (-2, -1),
        -2: (None, -3),
        2**62 - 1: (None, 2**63 - 1),
    }


# decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    grams = {}
    for item, text in items:
        w = words_of(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if w else ():
            grams.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def judged(spark, docs, items, **params):
    d = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, doc_id string")
    got = decontam.judge(d, b, **params).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got), key=str)


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, LONG), (10, LONG), (2, "Short ONE"), (3, ""), (4, None), (None, "é É straße ß"), (5, "a b c d e f g h i j k")]
DOCS = [
    (1, "x " + LONG.upper() + " y"),
    (2, "nothing here"),
    (2, "nothing here"),
    (3, None),
    (4, ""),
    (None, "short, one! short-one"),
    (5, "é É STRASSE ß; é É straße ß."),
    (6, "A b C d E f g H i j; K a b c d e f g h i"),
    (7, "\x01 \x00 short\x01one"),
    (8, ("filler " * 3000) + LONG),
    (9, "short ones"),
    (10, "Kelvin K short one"),
]


def test_decontamination_against_brute_force(spark):
    assert judged(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_decontamination_without_broadcast(spark):
    assert judged(spark, DOCS, ITEMS, broadcast_windows=0) == brute(DOCS, ITEMS)


def written(spark):
    """Bytes that all stages have written to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm = spark.sparkContext._jvm
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_shuffled_rows_are_narrow(spark):
    """Without broadcast, what is shuffled of a long document grows with its words, not with their square."""
    from draftlens.llm.decontam import scan

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = " ".join(f"t{k}" for k in range(20_000))
        d = spark.createDataFrame([(1, text), (2, LONG)], "doc_id long, text string")
        b = spark.createDataFrame([(1, LONG)], "item_id long, text string")
        before = written(spark)
        assert {r["doc_id"]: len(r["hits"]) for r in scan(d, b, broadcast_windows=0).collect()} == {1: 0, 2: 31}
        assert 10_000 < written(spark) - before < 100 * 20_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dropping_without_broadcast(spark):
    d = spark.createDataFrame([(*x, "e") for x in DOCS], "doc_id long, text string, _id string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = lambda **p: sorted((tuple(r) for r in decontam.drop_contaminated(d, b, **p).collect()), key=str)
    assert rows() == rows(broadcast_ids=0) == rows(broadcast_windows=0, broadcast_ids=0)


def test_decontamination_of_empty_tables(spark):
    assert judged(spark, [], ITEMS) == []
    assert judged(spark, DOCS, []) == brute(DOCS, [])


def test_dropping_and_masking(spark):
    d = spark.createDataFrame([(*x, "e") for x in DOCS], "doc_id long, text string, _id string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = sorted((r["doc_id"], r["text"]) for r in decontam.drop_contaminated(d, b).collect())
    bad = {x[0] for x in brute(DOCS, ITEMS) if x[5]}
    assert decontam.drop_contaminated(d, b).columns == d.columns
    assert len(kept) == sum(i not in bad for i, _ in DOCS) and not bad & {i for i, _ in kept}
    masked = {r["doc_id"]: r["kept"] for r in decontam.mask_spans(d, b).collect()}
    assert masked[1] == "x y" and masked[9] == "short ones"


def test_extra_columns_of_pairs_stay(spark):
    """Columns named like those that the work makes come back as they were."""
    from draftlens.llm import chat

    turn = "array<struct<role:string,text:string>>"
    rows = [(1, [("user", "a"), ("assistant", "b")], [("user", "a")], "mine", 7, "p", None)]
    (got,) = chat.format_preferences(spark.createDataFrame(rows, f"pair_id long, chosen {turn}, rejected {turn}, _n string, _c int, _P string, _r string")).collect()
    assert (got["_n"], got["_c"], got["_P"], got["_r"], got["n_prompt_turns"]) == ("mine", 7, "p", None, 1)
