"""Extraction, token counts, packing and near-duplicates against plain versions."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from draftlens.llm import htmltext, packing, simhash, substrings, tokencount
from draftlens.llm.tokenizer_files import default_path, library

TEXTS = [
    "",
    None,
    "   \n\t ",
    "Hello, world! It's 2024; I'll pay €5.50.",
    "<|endoftext|> and <|STARTOFTEXT|> inside <|startoftext|>",
    "trailing spaces   \n\n  ",
    "a  b   c\td\r\ne",
    "ΑΣΟΣ Σ ς İstanbul ŉ ǅ ß É é Ａ",
    "日本語のテキスト 한국어 🙂🙂 ‍﻿",
    "nbsp here wide\x85next\x1cfile",
    "ª º ² ³ ¼ µ ×÷ « » ·",
    "word" * 3000,
    "one two three " * 3000,
    "don't we're they've I'm he'd 's'S 'T",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "a", "b") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "a", "b"), (None, "null id", "a", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start string")


def test_token_counts(docs):
    tokenizer = library(default_path("word_bpe_49k.json"))
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.count_tokens(docs).collect()), key=str)
    want = []
    for i, t in [*enumerate(TEXTS), (3, TEXTS[3]), (None, "null id")]:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want, key=str)


def test_pieces_keep_the_shortcut(monkeypatch):
    """A curly quote sends its own piece to the library, not the text; all counts stay the library's."""
    counter = tokencount.Counter(default_path("word_bpe_49k.json"))
    rng = np.random.default_rng(11)
    odd = ["“quoted”", "dash—dash", "ΣΑΣ", "ς", "e\u0301", "\u0301", "<|endoftext|>", "a<|startoftext|>b", "日本", "x\u00a0y", "\u200d", "İ", "\x1c", "\x85", "ﬁ", "ǅ", "🙂"]
    plain = ["the", "cat's", "It'S", "naïve", "3.14", "don't", "WORD", "...", "a-b", "ß", "²"]
    blanks = [" ", "  ", "\n", "\t", "\r\n"]
    for _ in range(400):
        text = "".join(str(rng.choice(odd if rng.random() < 0.3 else plain)) + str(rng.choice(blanks)) for _ in range(int(rng.integers(1, 12))))
        assert counter.count(text) == len(counter.library.encode(text, add_special_tokens=False).ids), repr(text)
    whole = "“the” " + "common words of a long text " * 50
    asked = []
    real = counter.library
    counter.library = type("L", (), {"encode": lambda self, t, **k: asked.append(t) or real.encode(t, **k)})()
    counter.count(whole)
    assert all(" " not in t for t in asked)


def test_capitals_that_leave_the_range():
    """Letters below U+0250 whose small forms lie beyond, or are two characters, beside all others of the range."""
    counter = tokencount.Counter(default_path("word_bpe_49k.json"))
    rng = np.random.default_rng(12)
    low = [chr(c) for c in range(1, 0x250)]
    capitals = "ƁƆƉƊƏƐƓƔƖƗƜƝƟƦƩƮƱƲƷȺȾɄɅ"
    texts = ["KÜÇƏ", "MÜƏLLİM", "AĞƏ", "ÑƐ", "İSTANBUL"] + [a + b for a in capitals for b in low]
    texts += ["".join(rng.choice(low, int(rng.integers(1, 9)))) for _ in range(40_000)]
    want = [len(e.ids) for e in counter.library.encode_batch(texts, add_special_tokens=False)]
    assert [(t, n) for t, n in zip(texts, want, strict=True) if counter.count(t) != n] == []


def test_whole_tokens_are_whole():
    whole = tokencount.whole_tokens(default_path("word_bpe_49k.json"))
    assert len(whole) > 20_000 and "the" in whole


def test_packing_round_trip(docs):
    tokenizer = library(default_path("byte_bpe_50k.json"))
    got = packing.pack(docs).collect()
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in at.values():
        place = 0
        for o, n in sorted(parts):
            assert o == place and n > 0
            place += n
        assert place <= 2048
    for i, t in [*enumerate(TEXTS), (None, "null id")]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = sorted({(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got if r["doc_id"] == i})
        place = 0
        for s, n, crc, total in own:
            assert s == place and total == len(ids) and crc == zlib.crc32(ids[s : s + n].tobytes())
            place += n
        assert place == len(ids)
    assert sum(r["doc_id"] == 3 for r in got) == 2


@pytest.mark.parametrize("text", ["\n" * 10**6, " " * (2 * 10**6), " " * 10**6 + "x", "a" + "\t \n" * 400 + "b", "x" * 10**6, "1" * 10**5])
def test_ids_of_long_runs(text):
    import public_tokenizers

    vocabulary = default_path("byte_bpe_50k.json")
    got = packing.token_ids(text, vocabulary, default_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert got.tolist() == library(vocabulary).encode(text, add_special_tokens=False).ids


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(1)
    lengths = -np.sort(-rng.integers(1, 101, 500))
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room, want = [], []
    for n in lengths.tolist():
        k = next((k for k, r in enumerate(room) if r >= n), len(room))
        room += [100] * (k == len(room))
        want.append(k)
        room[k] -= n
    assert bins.tolist() == want and (offsets >= 0).all()


def test_packing_nothing(spark, docs):
    assert packing.pack(docs.limit(0)).collect() == []
    assert tokencount.count_tokens(docs.limit(0)).collect() == []


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy &amp; buy</div><div id="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1>
<p><b>Bold   start.<br><p>Second
paragraph&nbsp;here &lt;x&gt;.</p><p>Be.</p><aside>Side</aside><form><input value="q"><p>Form text</p></form><p>Caf&eacute; &#233;</p></article>
<div class="comments"><p>Reader comment that goes on and on and on for a long while to look like text.</p></div><footer>&copy; 2024 Foot</footer></body></html>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == "Head & line\n\nBold start.\n\nSecond paragraph here <x>.\n\nBe.\n\nCafé é"


def test_pages_without_article_and_odd_pages():
    body = "<html><body><nav>Menu</nav><div><h1>Title</h1><p>" + "Long text. " * 30 + "</p><p>End.</p></div><div class='sidebar'>No</div><footer>Foot</footer></body></html>"
    assert htmltext.main_text(body) == "Title\n\n" + ("Long text. " * 30).strip() + "\n\nEnd."
    for empty in (None, "", "<html><body></body></html>", "<script>x</script>"):
        assert htmltext.main_text(empty) == ""
    assert htmltext.main_text("just text &amp; more") == "just text & more"
    assert htmltext.main_text("<article><p>cut off <b>here &am") == "cut off here &am"
    assert htmltext.main_text("<article>" + "<p>x</p>" * 20_000 + "</article>").count("x") == 20_000


def test_comments_that_are_articles():
    page = "<main><article><h1>A</h1><p>" + "text " * 40 + "</p></article><section id='comments'><article><p>no</p></article></section><article class='comment'><p>" + "no " * 90 + "</p></article></main>"
    assert htmltext.main_text(page) == "A\n\n" + ("text " * 40).strip()


def test_pages_query(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None)]
    got = htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 65, 65] and len(got[0]) == 4


# near-duplicates


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps):
    up = {i: i for i in range(len(fps))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_fingerprints_and_groups(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"t{rng.integers(0, 500)}" for _ in range(n)) for n in (1, 2, 3, 80, 300, 900)]
    texts = [None, "", " \n", *base, *base[3:], base[5] + " more", base[5].replace("t1", "q1", 1), base[4] + " x", "AB c", "ab C", "é É"]
    df = spark.createDataFrame([(10 + i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r["doc_id"] - 10: r for r in simhash.near_duplicates(df).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    roots = plain_components(fps)
    assert [got[i]["fp"] & (2**64 - 1) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] - 10 for i in range(len(texts))] == roots
    kept = sorted(r["doc_id"] - 10 for r in simhash.keep_one(df).collect())
    assert kept == sorted(set(roots))
    assert simhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("chunk", [1024, 8])
def test_links_lose_no_component(spark, chunk):
    """Families of codes around centres, some far larger than a chunk, and chains."""
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2**63, 300)]
    for centre in fps[:4]:
        fps += [centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False)) for _ in range(60)]
    chain = fps[10]
    for b in range(0, 60, 3):
        chain ^= 7 << b
        fps.append(chain)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    links = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in simhash.near_links(df, chunk=chunk).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
    roots = {r["node"] & (2**64 - 1): r["root"] for r in simhash.components(simhash.near_links(df, chunk=chunk)).collect()}
    plain = plain_components(fps)
    groups = defaultdict(set)
    for f, r in zip(fps, plain, strict=True):
        groups[r].add(roots.get(f, f - 2**64 if f >> 63 else f))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_every_near_pair_meets(spark, radius):
    """For each pair within the radius, one is at home in a cell in which the other is too."""
    rng = np.random.default_rng(radius)
    fps = [int(x) for x in rng.integers(0, 2**63, 40)]
    pairs = [(f, f ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))) for f in fps for n in range(1, radius + 1)]
    every = sorted({x for p in pairs for x in p} | set(fps))
    df = spark.createDataFrame([(_long(x),) for x in every], "fp long")
    for chunk in (1024, 2):
        links = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in simhash.near_links(df, radius, chunk).collect()]
        assert all(bin(a ^ b).count("1") <= radius for a, b in links)
        up = {x: x for x in every}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            up[root(a)] = root(b)
        assert all(root(a) == root(b) for a, b in pairs)


def _long(x):
    return x - 2**64 if x >> 63 else x


def test_one_stays_whatever_the_order(spark):
    a, b = "some words of one text " * 9, "other words of another " * 9
    for rows in ([(3, b), (5, b), (5, a)], [(5, a), (5, b), (3, b)], [(5, b), (3, b), (5, a)]):
        got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == [(3, b), (5, a)]


# substrings


def plain_repeats(docs, size):
    first = {}
    for i, t in docs:
        w = (t or "").encode().split()
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in docs:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [40, 2])
def test_substrings(spark, bits):
    import hashlib

    rng = np.random.default_rng(9)
    passage = [f"p{rng.integers(0, 99)}" for _ in range(30)]
    docs = [(i, " ".join([*(f"u{rng.integers(0, 9999)}" for _ in range(20)), *passage[: 8 + i], *(f"v{rng.integers(0, 9999)}" for _ in range(9))])) for i in range(12)]
    docs += [(20, docs[3][1]), (21, docs[3][1]), (21, docs[3][1]), (22, "same " * 400), (23, "same " * 300 + "end"), (24, None), (25, ""), (26, "\n"), (27, "few words"), (None, docs[3][1]), (28, "É é\x0bÉ " * 40), (5, " ".join(passage))]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, pos string, least string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.find_repeats(df, size=10, stem=5, sketch_bits=bits).collect()), key=str)
    want = sorted(((i, n, g, hashlib.sha256(k).hexdigest()) for i, n, g, k in plain_repeats(docs, 10)), key=str)
    assert got == want


def test_substrings_by_joins_with_cells(spark):
    docs = [(i, " ".join(f"w{(i * 7 + k) % 60}" for k in range(80)) + f" end{i}") for i in range(30)] + [(40, None), (41, "a b")]
    docs += [(50 + i, docs[i % 3][1]) for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    run = lambda **p: sorted(tuple(r) for r in substrings.find_repeats(df, size=10, stem=5, **p).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert run(broadcast_bytes=0) == run() == run(sketch_bits=3, broadcast_bytes=0, broadcast_copies=0)
    assert {(i, n, g) for i, n, g, _ in run()} == {(i, n, g) for i, n, g, _ in plain_repeats(docs, 10)}


def test_words_that_polynomials_confuse(spark):
    """Thue-Morse words and their complements collide in any polynomial hash modulo a power of two."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    head = " ".join(f"h{k}" for k in range(49))
    docs = [(1, f"{head} {one}"), (2, f"{head} {two}"), (3, f"{head} {one}"), (4, " ".join("ab"[b] for b in bits)), (5, " ".join("ba"[b] for b in bits))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.find_repeats(df).collect()}
    assert got == {i: n for i, _, n, _ in plain_repeats(docs, 50)} and got[2] == 0 and got[3] == 50


def test_sketch_never_undercounts(spark):
    rng = np.random.default_rng(8)
    lists = [sorted(set(rng.integers(0, 3000, rng.integers(0, 60)).tolist())) for _ in range(200)]
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(lists)], "doc_id long, mark int, keys array<long>").repartition(7)
    count = defaultdict(int)
    for x in lists:
        for k in x:
            count[k] += 1
    every = np.array(sorted(count), dtype=np.uint64)
    for bits in (6, 14, 30):
        made = substrings.sketch(df, bits).cache()
        full = set(every[substrings._estimated(every, substrings._tables(made, bits), bits)].tolist())
        assert {k for k in count if count[k] > 1} <= full
        assert bits < 30 or all(count[k] > 1 for k in full)
        joined = {(r["doc_id"], k) for r in substrings.repeated_keys(df, made, bits).collect() for k in r["keys"]}
        assert joined == {(i, k) for i, x in enumerate(lists) for k in x if k in full}


def test_word_hashes_tell_words_apart():
    from draftlens.llm.wordhash import Words

    words = sorted({b"a" * n for n in range(1, 200)} | {b"a" * n + b"b" + b"a" * (9 - n) for n in range(9)} | {str(k).encode() for k in range(20_000)} | {b"x" * 63 + str(k).encode() for k in range(50)})
    buf = np.frombuffer(b" ".join(words) + b" AbC", dtype=np.uint8)
    assert len(set(Words(buf, np.array([0, len(buf)])).hash.tolist())) == len(words) + 1
    low = np.frombuffer(b"abc ABC abC", dtype=np.uint8)
    assert len(set(Words(low, np.array([0, len(low)]), lower=True).hash.tolist())) == 1


def test_substring_texts(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(1, text, 9), (2, "before\nit " + text + "\n after", 9), (3, "clean\ntext", 9), (4, text, 9), (5, None, None)]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {1: (text, 9), 2: ("before\nit\n after", 16), 3: ("clean\ntext", 9), 4: ("", 0), 5: (None, None)}
    assert out.columns == ["doc_id", "text", "n_chars"]
    rest = substrings.remove_repeats(spark.createDataFrame([*rows, (6, " ", 1)], "doc_id long, text string, n_chars long"), keep_emptied=False)
    assert sorted(r["doc_id"] for r in rest.collect()) == [1, 2, 3, 5, 6]
