"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of three rows of a table: two picked by hashes of the word, so that two words hardly ever
share both, and one by a hash of its first `STEM` bytes, so that forms of a known word count before they are seen. Filters of several widths run over the embeddings, are rectified and reduced by their maximum over the text,
and a logistic layer gives the logit. The first coordinate of the table starts as a shrunk log odds of the word in the
training rows; everything is then trained together by Adam. A logistic calibration on rows set aside maps logits to
scores, and thresholds by language are chosen there too; the language never enters a score.

The model is fitted on at most `TRAIN_ROWS` labelled rows and `TRAIN_WORDS` words in all, whole texts in the order of a
hash of their ids, so what reaches the driver is bounded however long the texts are; it is of fixed size (PARTS * BUCKETS * WIDTH floats and a little), so
it is broadcast. Texts are scored whole.

Edge cases: null and empty texts have no words: their maxima are zero; a text shorter than a filter is padded with zero
embeddings; with one class or no labelled row every score is that class's, or 0.5; repeated rows stay rows; extra columns
are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlens.llm.labelled import first_rows, remainder, training_rows
from draftlens.llm.wordhash import NOT_ALNUM, Words, mix, slices
from draftlens.session import materialize, ship_package

TRAIN_ROWS, TRAIN_WORDS = 12_000, 4_000_000
MODULUS, HELD_OUT = 3, 1
BUCKETS, WIDTH = 1 << 18, 4
PARTS, STEM = 3, 6
FILTERS, WIDTHS = 6, (1, 2, 3)
#: Passes over the rows, and steps at least: small samples are passed over more often.
EPOCHS, LEAST_STEPS, BATCH, RATE = 4, 400, 64, 0.02
PRIOR, LEAST_DOCS = 5.0, 3
#: Parts of the sample, and the rows below which each is set aside in turn.
FOLDS, CROSS_ROWS = 5, 2000
THRESHOLD = 0.7


def buckets(words: Words) -> np.ndarray:
    """PARTS table rows for each word."""
    h, stem = mix(words.hash), words.stems(STEM)
    row = lambda x, part: (x % np.uint64(BUCKETS)).astype(np.int32) + part * BUCKETS
    return np.stack([row(h, 0), row(h >> np.uint64(32), 1), row(stem, 2)], axis=1)


@dataclass
class Network:
    table: np.ndarray
    kernels: list[np.ndarray]  # for each width: (width, WIDTH, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def maxima(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pooled features of each document, the words at which they arise (-1: nowhere), and the embeddings.

        ids: PARTS rows for each word; edges: first word of each document, then the end.
        """
        n_docs, n = len(edges) - 1, len(ids)
        e = sum(self.table[ids[:, p]] for p in range(PARTS)) if n else np.zeros((0, WIDTH), dtype=np.float32)
        pooled = np.zeros((n_docs, len(WIDTHS) * FILTERS), dtype=np.float32)
        where = np.full(pooled.shape, -1, dtype=np.int64)
        filled = np.flatnonzero(np.diff(edges) > 0)
        if not len(filled):
            return pooled, where, e
        doc_end = np.repeat(edges[1:], np.diff(edges))
        for k, width in enumerate(WIDTHS):
            act = e @ self.kernels[k][0] + self.biases[k]
            for j in range(1, width):
                inside = np.flatnonzero(np.arange(n - j) + j < doc_end[: n - j]) if n > j else np.zeros(0, dtype=np.int64)
                act[inside] += (e @ self.kernels[k][j])[inside + j]
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            pooled[filled, part] = np.maximum(np.maximum.reduceat(act, edges[filled], axis=0), 0)
            for d in filled.tolist() if self.training else ():
                a, b = edges[d], edges[d + 1]
                best = act[a:b].argmax(axis=0)
                where[d, part] = np.where(pooled[d, part] > 0, a + best, -1)
        return pooled, where, e

    training: bool = False

    def logits(self, ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return self.maxima(ids, edges)[0] @ self.out + self.out_bias

    def scores(self, ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return _logistic(self.scale * self.logits(ids, edges) + self.shift)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


class Adam:
    def __init__(self, rate: float):
        self.rate, self.state, self.t = rate, {}, 0

    def step(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.999 * v[at] + 0.001 * grad * grad
        t = max(1, self.t)
        value[at] -= self.rate * (m[at] / (1 - 0.9**t)) / (np.sqrt(v[at] / (1 - 0.999**t)) + 1e-6)


def _subset(ids: np.ndarray, edges: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(edges)[docs]
    at = np.concatenate([np.arange(edges[d], edges[d + 1]) for d in docs.tolist()]) if len(docs) else np.zeros(0, dtype=np.int64)
    return ids[at], np.concatenate([[0], np.cumsum(sizes)])


def train(ids: np.ndarray, edges: np.ndarray, y: np.ndarray, lang: list[str], epochs: int = EPOCHS, seed: int = 5) -> Network | float:
    """Fit on documents given as words' table rows, and calibrate on logits of rows that the network was not fitted on.

    A fifth is set aside for that; of a small sample, each fifth in turn, and the network itself is fitted on all of it.
    """
    if len(np.unique(y)) < 2:
        return float(y[0]) if len(y) else 0.5
    order = np.random.default_rng(seed).permutation(len(y))
    folds = [order[k::FOLDS] for k in range(FOLDS)]
    rest = [np.concatenate([f for j, f in enumerate(folds) if j != k]) for k in range(FOLDS)]
    if any(len(np.unique(y[r])) < 2 for r in rest):  # a handful of rows
        net = _fitted(ids, edges, y, order, epochs, seed)
        aside, z = order, net.logits(*_subset(ids, edges, order))
    elif len(y) < CROSS_ROWS:
        net = _fitted(ids, edges, y, order, epochs, seed)
        aside = np.concatenate(folds)
        z = np.concatenate([_fitted(ids, edges, y, r, epochs, seed).logits(*_subset(ids, edges, f)) for f, r in zip(folds, rest, strict=True)])
    else:
        net, aside = _fitted(ids, edges, y, rest[0], epochs, seed), folds[0]
        z = net.logits(*_subset(ids, edges, aside))
    _calibrate(net, z, y[aside], [lang[d] for d in aside.tolist()])
    return net


def _fitted(ids: np.ndarray, edges: np.ndarray, y: np.ndarray, use: np.ndarray, epochs: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    # document frequencies of table rows by class, of the rows to train on
    df = np.zeros((2, PARTS * BUCKETS))
    for d in use.tolist():
        df[y[d], np.unique(ids[edges[d] : edges[d + 1]])] += 1
    base = y[use].mean()
    share = (df[1] + PRIOR * base) / (df.sum(axis=0) + PRIOR)
    known = df.sum(axis=0) >= LEAST_DOCS
    table = np.zeros((PARTS * BUCKETS, WIDTH), dtype=np.float32)
    table[:, 0] = np.where(known, 0.5 * (np.log(share / (1 - share)) - np.log(base / (1 - base))), 0)
    kernels = [(rng.standard_normal((w, WIDTH, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
    for k in kernels:
        k[:, 0, : FILTERS // 2] = np.abs(k[:, 0, : FILTERS // 2]) + 0.3
    net = Network(table, kernels, [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS], (np.abs(rng.standard_normal(len(WIDTHS) * FILTERS)) * 0.1).astype(np.float32), float(np.log(base / (1 - base))))
    bias = np.array([net.out_bias], dtype=np.float32)
    adam, weight = Adam(RATE), np.where(y == 1, 0.5 / base, 0.5 / (1 - base)).astype(np.float32)
    net.training = True
    for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // len(use)))):
        turn = rng.permutation(use)
        for at in range(0, len(turn), BATCH):
            docs = turn[at : at + BATCH]
            own, own_edges = _subset(ids, edges, docs)
            net.out_bias = float(bias[0])
            pooled, where, e = net.maxima(own, own_edges)
            g = ((_logistic(pooled @ net.out + net.out_bias) - y[docs]) * weight[docs] / len(docs)).astype(np.float32)
            adam.t += 1
            g_pooled = g[:, None] * net.out * (pooled > 0)
            adam.step("out", net.out, pooled.T @ g + 1e-4 * net.out)
            adam.step("out_bias", bias, np.array([g.sum()]))
            doc_end = np.repeat(own_edges[1:], np.diff(own_edges))
            touched, pushes = [], []
            for k, width in enumerate(WIDTHS):
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                d, f = np.nonzero(where[:, part] >= 0)
                word, grad = where[:, part][d, f], g_pooled[:, part][d, f]
                gk = np.zeros_like(net.kernels[k])
                gb = np.zeros(FILTERS, dtype=np.float32)
                np.add.at(gb, f, grad)
                for j in range(width):
                    ok = word + j < doc_end[word]
                    w, ff, gg = word[ok] + j, f[ok], grad[ok]
                    np.add.at(gk[j].T, ff, e[w] * gg[:, None])
                    touched.append(own[w])
                    pushes.append(net.kernels[k][j][:, ff].T * gg[:, None])
                adam.step(f"b{k}", net.biases[k], gb)
                adam.step(f"k{k}", net.kernels[k], gk)
            rows = np.concatenate(touched).ravel()
            push = np.repeat(np.concatenate(pushes), PARTS, axis=0)
            ok = known[rows]
            rows, inverse = np.unique(rows[ok], return_inverse=True)
            if len(rows):
                total = np.zeros((len(rows), WIDTH), dtype=np.float32)
                np.add.at(total, inverse, push[ok])
                adam.step("table", net.table, total, rows)
    net.training, net.out_bias = False, float(bias[0])
    return net


def _calibrate(net: Network, z: np.ndarray, y: np.ndarray, lang: list[str]) -> None:
    """Logistic scale and shift by Newton steps, ridged; then the threshold of best F1 for each language."""
    z = z.astype(np.float64)
    spread = max(z.std(), 1e-6)
    x = np.stack([z / spread, np.ones(len(z))], axis=1)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    beta = np.array([1.0, 0.0])
    for _ in range(25):
        p = _logistic(x @ beta)
        beta -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (beta - [1.0, 0.0]))
    net.scale, net.shift = float(max(beta[0], 1e-3) / spread), float(beta[1])
    p = _logistic(net.scale * z + net.shift)
    for name in sorted({x for x in lang if x}):
        own = np.array([x == name for x in lang])
        if y[own].sum() < 5:
            continue
        cuts = np.unique(p[own])
        f1 = [2 * ((p[own] >= c) & (y[own] == 1)).sum() / max(1, (p[own] >= c).sum() + y[own].sum()) for c in cuts]
        best = int(np.argmax(f1))
        below = cuts[best - 1] if best else 0.0
        net.thresholds[name] = float((cuts[best] + below) / 2)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offsets in slices(batch.column(0)):
            words = Words(buf, offsets, NOT_ALNUM, lower=True)
            rows = buckets(words)
            sizes = pa.array(words.count, pa.int64())
            lists = pa.LargeListArray.from_arrays(pa.array(PARTS * words.first, pa.int64()), pa.array(rows.ravel(), pa.int32())).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, *(batch.column(c).slice(a, b - a) for c in (1, 2, 3)), sizes], names=["ids", "y", "lang", "doc_id", "n"])


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_words: int = TRAIN_WORDS) -> Network | float:
    ship_package(docs.sparkSession)
    sample = training_rows(docs, labels, "toxic", train_rows, MODULUS, HELD_OUT).select("text", "y", "lang", "doc_id")
    encoded = sample.mapInArrow(_encode, "ids array<int>, y int, lang string, doc_id long, n long").withColumn("h", F.xxhash64("ids"))
    encoded = materialize(encoded, "encoded")
    # the first rows by a hash of doc_id whose words fit; sizes alone are looked at first
    encoded = encoded.withColumn("o", F.xxhash64("doc_id")).filter(F.col("n") <= train_words)
    sizes = first_rows(encoded.select("o", "doc_id", "h", "n"), train_rows, "o", "doc_id", "h").toArrow()
    fits = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), train_words, side="right"))
    if not fits:
        return 0.5
    last = sizes["o"][fits - 1].as_py()
    got = first_rows(encoded.filter(F.col("o") <= last), fits, "o", "doc_id", "h").toArrow()
    # in the order of doc_id, so that the model does not depend on how rows are dealt
    got = got.sort_by([("doc_id", "ascending"), ("h", "ascending")])
    lists = got["ids"].combine_chunks()
    edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)]) // PARTS
    return train(lists.flatten().to_numpy().reshape(-1, PARTS), edges, got["y"].to_numpy(), got["lang"].to_pylist())


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            for a, b, buf, offsets in slices(batch.column(1), 1_000_000):
                if isinstance(net, float):
                    s = np.full(b - a, net)
                else:
                    words = Words(buf, offsets, NOT_ALNUM, lower=True)
                    s = net.scores(buckets(words), words.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(s)], names=["doc_id", "lang", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs (doc_id, text, lang if there): doc_id, held_out, score, predicted (at threshold), flagged (at its language's)."""
    spark = docs.sparkSession
    net = learn(docs, labels, train_rows)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    scored = base.mapInArrow(_score(spark.sparkContext.broadcast(net)), "doc_id long, lang string, score double")
    own = F.lit(threshold)
    for name, cut in sorted({}.items() if isinstance(net, float) else net.thresholds.items()):
        own = F.when(F.col("lang") == name, F.lit(cut)).otherwise(own)
    held = F.coalesce(remainder(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), (F.col("score") >= own).cast("int").alias("flagged"))
