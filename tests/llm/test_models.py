"""Neighbours, classifiers and the pipeline: recall, held-out accuracy, and edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlens.llm import ann, quality, registry, toxicity
from draftlens.llm.labelled import remainder

SF = "/root/testdata/sf0.01"


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out


@pytest.mark.parametrize("block", [16_384, 64])
def test_recall(spark, block):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = e.toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float)
    got = {}
    for r in ann.search(e, F.col("vec_id") % 10 == 0, block=block).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = exact(ids, x, [i for i in ids if i % 10 == 0], 10)
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 11)) for g in got.values())
    hits = [v in {i for i, _ in want[q]} for q, g in got.items() for v, _ in g.values()]
    assert np.mean(hits) >= 0.9
    scores = {q: dict(want[q]) for q in want}
    assert all(abs(scores[q].get(v, s) - s) < 1e-12 for q, g in got.items() for v, s in g.values())


def test_pigeonhole_probes_every_code():
    """A code within tables * (FLIPS + 1) - 1 bits shares a probed value."""
    rng = np.random.default_rng(2)
    coder = ann.Coder(rng.standard_normal((200, 32)), 8, 8)
    signs = coder.signs(rng.standard_normal((40, 32)))
    most = 8 * (ann.FLIPS + 1) - 1
    for own in signs:
        probed = {int(k) ^ m for k in coder.keys(own[None])[0] for m in ann.masks(8)}
        for n in (0, 1, most - 3, most):
            other = own.copy()
            other[rng.choice(64, n, replace=False)] ^= True
            assert probed & set(coder.keys(other[None])[0].tolist())
            assert np.bitwise_count((ann.Coder.words(own[None]) ^ ann.Coder.words(other[None])).view(np.uint64)).sum() == n


def test_index_prunes(spark):
    """At a recall of nine in ten, under a tenth of the rows is ranked; vectors about centres, as those of texts are."""
    rng = np.random.default_rng(21)
    x = rng.standard_normal((40, 64))[rng.integers(0, 40, 4000)] + 0.6 * rng.standard_normal((4000, 64))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    items = e.select(F.xxhash64("embedding").alias("h"), F.col("embedding").alias("v"), F.array("vec_id").alias("ids")).cache()
    queries = items.filter(F.col("ids")[0] % 100 == 0).cache()
    n, q = items.count(), queries.count()
    coder, reach, measured = ann.fit(items)
    ranked = ann.retrieved(items, queries, coder, reach).count()
    want = exact(np.arange(4000), x, range(0, 4000, 100), 10)
    got = {}
    for r in ann.search(e, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = np.mean([v in got[k] for k, near in want.items() for v, _ in near])
    print(f"{n} rows: {coder.tables} tables of {coder.bits} bits, reach {reach}; ranked {ranked / n / q:.4f} of the rows; recall {recall:.3f}, measured {measured:.3f}")
    assert recall >= 0.9 and measured >= 0.9 and ranked < 0.1 * n * q


def test_low_recall_is_answered_exactly(spark, monkeypatch):
    """Where the tables allowed don't reach the recall, answers are those of brute force."""
    monkeypatch.setattr(ann, "MOST_TABLES", 1)
    monkeypatch.setattr(ann, "FLIPS", 0)
    x = np.random.default_rng(22).standard_normal((300, 32))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(e, F.col("vec_id") % 100 == 0).collect())
    want = exact(np.arange(300), x, range(0, 300, 100), 10)
    assert got == sorted((k, n + 1, v) for k, near in want.items() for n, (v, _) in enumerate(near))


def test_index_rows_are_bounded(spark):
    """Nearly independent components: the recall is reached by shorter substrings, not by more tables."""
    x = np.random.default_rng(31).standard_normal((4000, 128))
    items = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").select(F.xxhash64("v").alias("h"), "v")
    coder, reach, measured = ann.fit(items)
    print(f"{coder.tables} tables of {coder.bits} bits, reach {reach}, measured {measured:.3f}")
    assert coder.tables <= 40 and measured >= 0.9


def test_near_copies_meet_as_groups(spark):
    """Near copies are compared in blocks: their queries meet few groups, not each copy, and find the nearest all the same."""
    rng = np.random.default_rng(32)
    x = rng.standard_normal((2000, 48))
    x[:1000] = x[0] + 0.1 * rng.standard_normal((1000, 48))
    ids = rng.permutation(2000)
    e = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    items = e.select(F.xxhash64("embedding").alias("h"), F.col("embedding").alias("v"), F.array("vec_id").alias("ids")).cache()
    family = spark.createDataFrame([(int(i),) for i in ids[:1000] if i % 100 == 0], "id long")
    queries = items.join(family, F.col("ids")[0] == F.col("id"), "left_semi").cache()
    n = queries.count()
    coder, reach, _ = ann.fit(items)
    met = ann.retrieved(items, queries, coder, reach).count()
    got = {}
    for r in ann.search(e, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(ids, x, [i for i in range(0, 2000, 100)], 10)
    hits = {k: np.mean([v in got[k] for v, _ in near]) for k, near in want.items()}
    print(f"{n} queries met {met}; recall {np.mean(list(hits.values())):.3f}")
    assert n > 5 and met < 250 * n
    assert all(hits[r["id"]] == 1 for r in family.collect()) and np.mean(list(hits.values())) >= 0.9


def test_repeated_query_rows_and_copies(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 8)).round(3)
    rows = [(i, x[i].tolist()) for i in range(60)] + [(0, x[0].tolist()), (100, x[5].tolist()), (100, x[5].tolist()), (100, x[7].tolist())] + [(1000 + i, x[9].tolist()) for i in range(40)]
    rows = [(i, v) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, F.col("vec_id") % 100 == 0).collect())
    all_ids, all_x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    want = []
    for k, (i, v) in enumerate(rows):
        if i % 100 == 0:
            d = np.sqrt(((all_x - v) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((all_ids, d)) if j != k][:10]
            want += [(i, n + 1, int(all_ids[j]), float(d[j])) for n, j in enumerate(order)]
    want.sort()
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.mean([a[2] == b[2] and abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want, strict=True)]) >= 0.9


def test_too_few_found_are_searched_exactly(spark, monkeypatch):
    monkeypatch.setattr(ann, "fit", lambda items, k, sample: (ann.Coder(np.eye(4), 4, 1), -1))
    rows = [(i, [float(i == j) + i / 7 for j in range(4)]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.search(df, F.col("vec_id") % 5 == 0, k=3, block=5).collect()}
    want = exact(np.arange(12), np.array([v for _, v in rows]), [0, 5, 10], 3)
    assert got == {(q, n + 1): i for q, near in want.items() for n, (i, _) in enumerate(near)}


def test_neighbours_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (100, [1.0, 0.0]), (200, None), (300, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, F.col("vec_id") % 100 == 0).collect())
    assert [x for x in got if x[0] == 100] == [(100, 1, 0, 0.0), (100, 2, 0, 0.0), (100, 3, 1, 0.0), (100, 4, 2, pytest.approx(2**0.5))]
    assert {x[0] for x in got} == {0, 100}
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def held_out(spark, name, label):
    scored = registry.queries()[name](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = scored[scored["held_out"]].merge(labels, on="doc_id")
    return scored, both["predicted"].to_numpy(), both[label].to_numpy()


def test_toxicity(spark):
    scored, p, y = held_out(spark, "op8_toxicity", "toxic")
    assert scored["score"].between(0, 1).all() and len(scored) == 1000
    assert (p == y).mean() >= 0.95


def test_quality(spark):
    scored, p, y = held_out(spark, "op9_quality_classifier", "quality")
    assert scored["score"].between(0, 1).all() and len(scored) == 1000
    assert (p == y).mean() >= 0.95


ODD = [(1, None), (2, ""), (3, "   "), (4, "x" * 300_000), (5, "one"), (5, "one"), (None, "no id"), (6, "!!! ### \x00"), (7, "日本語 " * 5000)]


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifier_edge_cases(spark, module, label):
    docs = spark.createDataFrame([(*r, "e", None) for r in ODD], "doc_id long, text string, score string, lang string")
    schema = f"doc_id long, {label} int, text string"
    for labels in ([], [(1, None, "a")], [(1, 1, "a"), (2, 1, "a")], [(i, i % 2, "a") for i in range(1, 8)] + [(None, 1, "a"), (5, 0, "a")]):
        got = module.score(docs, spark.createDataFrame(labels, schema)).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert module.score(docs.limit(0), spark.createDataFrame([], schema)).collect() == []
    again = [sorted((str(r["doc_id"]), r["score"]) for r in module.score(docs, spark.createDataFrame([(i, i % 2, "a") for i in range(1, 8)], schema)).collect()) for _ in range(2)]
    assert again[0] == again[1]


def words_and_edges(texts):
    from draftlens.llm.wordhash import NOT_ALNUM, Words

    raw = [t.encode() for t in texts]
    words = Words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), NOT_ALNUM, lower=True)
    return toxicity.buckets(words), words.first


def small_network(seed=1):
    rng = np.random.default_rng(seed)
    f = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    return toxicity.Network(f(toxicity.PARTS * toxicity.BUCKETS, toxicity.WIDTH), [f(w, toxicity.WIDTH, toxicity.FILTERS) for w in toxicity.WIDTHS], [f(toxicity.FILTERS) for _ in toxicity.WIDTHS], f(len(toxicity.WIDTHS) * toxicity.FILTERS), 0.3)


def test_convolution_against_plain_loops():
    texts = ["one two three four", "", "a", "x y", "last one of all these words, and more"]
    net, (ids, edges) = small_network(), words_and_edges(texts)
    got = net.maxima(ids, edges)[0]
    for d in range(len(texts)):
        e = [sum(net.table[r] for r in row) for row in ids[edges[d] : edges[d + 1]]]
        want = []
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                at = [net.biases[k][f] + sum(float(e[i + j] @ net.kernels[k][j][:, f]) for j in range(width) if i + j < len(e)) for i in range(len(e))]
                want.append(max([0.0, *at]))
        assert np.allclose(got[d], want, atol=1e-4)


def test_training_follows_the_gradient(monkeypatch):
    """One recorded step: what Adam is given equals the loss's differences."""
    texts = ["bad words here", "good words there now", "bad thing", "fine thing it is"] * 3
    y = np.array([1, 0, 1, 0] * 3)
    ids, edges = words_and_edges(texts)
    seen = {}

    class Recorder(toxicity.Adam):
        def step(self, name, value, grad, rows=None):
            seen.setdefault(name, (value, value.copy(), np.array(grad), rows))

    monkeypatch.setattr(toxicity, "Adam", Recorder)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 1)
    net = toxicity._fitted(ids, edges, y, np.arange(len(y)), 1, 3)

    def loss():
        z = (net.maxima(ids, edges)[0] @ net.out + net.out_bias).astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    for name, k in (("out", None), ("k0", 0), ("k1", 1), ("b1", None)):
        value, _, grad, _ = seen[name]
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept = value[at]
        value[at] = kept + 1e-2
        up = loss()
        value[at] = kept - 1e-2
        down = loss()
        value[at] = kept
        assert abs((up - down) / 2e-2 - grad[at]) < 0.02 + 0.1 * abs(grad[at])


def test_words_bound_what_the_driver_gets(spark):
    docs = spark.createDataFrame([(i, ("bad " if i % 2 else "fine ") * (5 + i)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    kept = []
    real = toxicity.train
    try:
        toxicity.train = lambda ids, edges, *a: kept.append((len(ids), len(edges) - 1)) or real(ids, edges, *a)
        toxicity.learn(docs, labels, train_words=300)
        toxicity.learn(docs.repartition(7), labels, train_words=300)
    finally:
        toxicity.train = real
    assert kept[0] == kept[1] and 0 < kept[0][0] <= 300 and kept[0][1] > 3


def test_statistics_against_plain_counts():
    texts = ["A few words, 12 of them.\nNew line and and more", "", "x", "ÄÖ ü # % 1234567890123 same same same", "  blanks  only "]
    raw = [t.encode() for t in texts]
    got = quality.statistics(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    usual, more, bytes_ = quality.USUAL, quality.MORE_WORDS, quality.MORE_BYTES
    root = lambda x: np.arcsin(np.sqrt(min(1, max(0, x))))
    for row, x in zip(got, raw, strict=True):
        w, n = x.split(), len(x.split())
        kind = {k: sum(b in set(v) for b in x) for k, v in quality._KINDS.items()}
        share = lambda k, of: root((kind[k] + bytes_ * usual[k]) / (of + bytes_))  # noqa: B023, E731
        by_word = lambda k, c: root((c + more * usual[k]) / (n + more))  # noqa: B023, E731
        want = [
            np.log1p(n),
            np.log1p((sum(map(len, w)) + more * usual["length"]) / (n + more)),
            share("upper", kind["upper"] + kind["lower"]),
            *(share(k, len(x)) for k in ("digit", "symbol", "mark", "high")),
            by_word("same", sum(a == b for a, b in zip(w, w[1:]))),
            np.log((len(set(w)) + more) / (n + more) ** 0.9),
            by_word("lone", sum(len(a) == 1 and a[0] in set(quality._KINDS["symbol"]) for a in w)),
            np.log1p(n / (1 + kind["line"])),
            by_word("long", sum(len(a) >= 12 for a in w)),
        ]
        assert np.allclose(row, want)


def test_log_densities_against_plain_ones():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((80, 3)), 2 + rng.standard_normal((50, 3)) * [1, 2, 3]])
    y = np.repeat([0, 1], [80, 50])
    model = quality.discriminant(x, y, 0.2, 0.1)
    pooled = sum(((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in (0, 1)), np.zeros((3, 3))) / 130
    logs = []
    for c in (0, 1):
        own = x[y == c]
        cov = 0.9 * np.cov(own.T, bias=True) + 0.1 * pooled
        cov = 0.8 * cov + 0.2 * np.diag(np.diag(cov)) + np.eye(3) * max(1e-4, 1e-3 * np.trace(pooled) / 3)
        dev = x - own.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", dev, np.linalg.inv(cov), dev) - 0.5 * np.log(np.linalg.det(cov)) + np.log(len(own) / 130))
    assert np.allclose(model.odds(x), logs[1] - logs[0])


def test_quality_model_does_not_depend_on_how_rows_are_dealt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a, b = (quality.learn(d, labels) for d in (docs, docs.repartition(7)))
    assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("means", "whiten", "log_det", "log_prior", "scale", "shift"))


def test_held_out_rule(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in range(200)], "doc_id long").select("doc_id", remainder(F.col("doc_id"), 3).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["doc_id"]).encode()) % 3 for r in rows)


def test_scores_ignore_lang_and_source(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(100)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for module in (toxicity, quality):
        a = {r["doc_id"]: r["score"] for r in module.score(docs, labels).collect()}
        b = {r["doc_id"]: r["score"] for r in module.score(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s")}), labels).collect()}
        assert a == b


def test_pipeline_against_brute_force(spark):
    """Each stage by plain loops over the rows that the stage before kept."""
    import zlib

    import corpus_pipeline
    from test_native import words_of
    from test_text import plain_components, plain_fingerprint, plain_repeats

    from draftlens.llm.tokenizer_files import default_path, library

    sf = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: sorted((r["doc_id"], r["text"], r["n_chars"]) for r in df.collect())

    good = quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("score >= 0.7")
    kept = {r["doc_id"] for r in good.collect()}
    one = stages["quality_classifier"](spark, docs, sf)
    assert rows(one) == [r for r in rows(docs) if r[0] in kept]

    plain = rows(one)
    roots = plain_components([plain_fingerprint(t) for _, t, _ in plain])
    two = stages["simhash_near_dedup"](spark, one, sf)
    assert rows(two) == [r for k, r in enumerate(plain) if roots[k] == k]

    plain = rows(two)
    left = {i: k for i, _, _, k in plain_repeats([(i, t) for i, t, _ in plain], 50)}
    three = stages["substring_dedup"](spark, two, sf)
    had = [r for r in plain if left[r[0]] or not r[1].split()]  # documents that lose every word go
    for (i, t, n), (_, before, _) in zip(rows(three), had, strict=True):
        assert b" ".join(t.encode().split()) == left[i] and n == len(t)
        assert t == before or len(before.encode().split()) > len(t.encode().split())

    grams = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words_of(r["text"])
        n = min(10, len(w))
        grams |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    sizes = {len(g) for g in grams}
    clean = [r for r in rows(three) if not any(tuple(w[k : k + n]) in grams for w in [words_of(r[1])] for n in sizes for k in range(len(w) - n + 1))]
    four = stages["benchmark_decontamination"](spark, three, sf)
    assert rows(four) == clean and len(clean) < len(plain)

    tokenizer, want = library(default_path("byte_bpe_50k.json")), set()
    for i, t, _ in clean:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        want |= {(i, s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)}
    got = stages["packing"](spark, four, sf).collect()
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in got)
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got} == want and len(got) == len(want)


def test_pipeline_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    sf, calls = "/root/testdata/sf0.001", []
    few = lambda spark, docs, sf_dir: docs.limit(20)

    def fails(spark, docs, sf_dir):
        calls.append(docs.count())
        if len(calls) == 1:
            raise RuntimeError("lost")
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("few", few), ("fails", fails)])
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark: f"file://{tmp_path}")
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, sf, "again")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("few", None), ("fails", fails)])
    assert corpus_pipeline.run(spark, sf, "again").count() == 20 and calls == [20, 20]


def test_a_name_used_over_other_tables(spark, tmp_path, monkeypatch):
    """A second run of a name over another input gives that input's rows."""
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("all", lambda spark, docs, sf_dir: docs)])
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark: f"file://{tmp_path}")
    counts = [corpus_pipeline.run(spark, f"/root/testdata/{d}", "one").count() for d in ("sf0.001", "sf0.01", "sf0.001")]
    assert counts == [spark.read.parquet(f"/root/testdata/{d}/documents.parquet").count() for d in ("sf0.001", "sf0.01", "sf0.001")]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf, at, sizes = "/root/testdata/sf0.001", docs, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in at.select("doc_id").collect()}
        at = stage(spark, at, sf)
        if name != "packing":
            assert at.columns == docs.columns and at.schema.simpleString() == docs.schema.simpleString()
        after = {r["doc_id"] for r in at.select("doc_id").collect()}
        assert after <= before
        sizes.append(len(after))
    assert sizes[0] < docs.count() and sizes[-1] == sizes[-2] > 50
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == sizes[-1]
