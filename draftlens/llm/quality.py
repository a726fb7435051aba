"""Quality classifier: a regularised quadratic discriminant over statistics of the text.

Each text gives a vector of transformed statistics (counts as logarithms, shares as arcsine roots). Each class has a mean and
a covariance, shrunk towards its diagonal and towards the pooled covariance; the Cholesky factors are computed once and
shipped with the model. The score is the logistic of the difference of the log densities (from Mahalanobis distances and
log determinants) and the log prior odds. The model is fitted on four fifths of the training rows; on the fifth set
aside a logistic scale and shift are fitted that turn its odds into probabilities (the fifth is chosen by the rows' order).

The model is fitted on at most `TRAIN_ROWS` labelled rows, sorted by doc_id and statistics, so it does not depend on how
rows are dealt. Statistics are of whole texts.

Edge cases: null and empty texts have the statistics of no words and are scored like any other; with one class or no
labelled row, every score is that class's, or 0.5; repeated rows stay rows; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlens.llm.labelled import first_rows, remainder, training_rows
from draftlens.llm.wordhash import Words, slices
from draftlens.session import ship_package

TRAIN_ROWS = 12_000
MODULUS, HELD_OUT = 4, 2
SHRINK_DIAGONAL, SHRINK_POOLED = 0.1, 0.05
THRESHOLD = 0.7
#: One row of so many is set aside for calibration, and how strongly the calibration keeps to a scale of one.
ASIDE, RIDGE = 5, 1e-3
#: Short texts say little: their shares are mixed with usual ones, as if so many words or bytes more had been read.
MORE_WORDS, MORE_BYTES = 8.0, 50.0
#: Usual shares of prose.
USUAL = {"upper": 0.04, "digit": 0.0, "symbol": 0.0, "mark": 0.03, "high": 0.02, "same": 0.0, "lone": 0.0, "long": 0.1, "length": 5.5}
FEATURES = ("words", "bytes_per_word", "upper", "digit", "symbol", "mark", "high", "same_as_last", "distinct", "lone", "line_words", "long_words")

_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#$%&*+/<=>@[\\]^_`{|}~!", "mark": b".,;:?'\"()-", "high": range(128, 256), "line": b"\n"}


def _table(kind: str) -> np.ndarray:
    t = np.zeros(256, dtype=np.uint8)
    t[list(_KINDS[kind])] = 1
    return t


_TABLES = {k: _table(k) for k in _KINDS}


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document."""
    words = Words(buf, offsets)
    n_docs = len(offsets) - 1
    size = np.diff(offsets)

    def total(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return (sums[edges[1:]] - sums[edges[:-1]]).astype(float)

    kinds = {k: total(t[buf], offsets) for k, t in _TABLES.items()}
    n = words.count.astype(float)
    length = words.end - words.start
    same = np.zeros(len(words.hash), dtype=bool)
    if len(same):
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    order = np.lexsort((words.hash, words.doc))
    h, d = words.hash[order], words.doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=n_docs).astype(float)
    first = buf[words.start] if len(words.start) else np.zeros(0, dtype=np.uint8)
    lone = (length == 1) & (_TABLES["symbol"][first] == 1)
    root = lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    by_bytes = lambda k, of: root((kinds[k] + MORE_BYTES * USUAL[k]) / (of + MORE_BYTES))
    by_words = lambda k, x: root((x + MORE_WORDS * USUAL[k]) / (n + MORE_WORDS))
    letters = kinds["upper"] + kinds["lower"]
    columns = [
        np.log1p(n),
        np.log1p((total(length, words.first) + MORE_WORDS * USUAL["length"]) / (n + MORE_WORDS)),
        by_bytes("upper", letters),
        *(by_bytes(k, size) for k in ("digit", "symbol", "mark", "high")),
        by_words("same", total(same, words.first)),
        # few distinct words for the length: compared with a power of it, as vocabularies grow
        np.log((distinct + MORE_WORDS) / (n + MORE_WORDS) ** 0.9),
        by_words("lone", total(lone, words.first)),
        np.log1p(n / (1 + kinds["line"])),
        by_words("long", total(length >= 12, words.first)),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Discriminant:
    """Class means, the inverses of the Cholesky factors of their covariances, log determinants and log priors."""

    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for c in range(2):
            z = (x - self.means[c]) @ self.whiten[c].T
            logs.append(-0.5 * (z * z).sum(axis=1) - 0.5 * self.log_det[c] + self.log_prior[c])
        return logs[1] - logs[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.odds(x) + self.shift, -30, 30)))


def discriminant(x: np.ndarray, y: np.ndarray, shrink_diagonal: float = SHRINK_DIAGONAL, shrink_pooled: float = SHRINK_POOLED) -> Discriminant:
    """Means and regularised covariances of two classes."""
    centred = np.concatenate([x[y == c] - x[y == c].mean(axis=0) for c in (0, 1)])
    pooled = centred.T @ centred / len(x)
    means, whiten, log_det, prior = [], [], [], []
    for c in (0, 1):
        own = x[y == c]
        dev = own - own.mean(axis=0)
        cov = dev.T @ dev / len(own)
        cov = (1 - shrink_pooled) * cov + shrink_pooled * pooled
        cov = (1 - shrink_diagonal) * cov + shrink_diagonal * np.diag(np.diag(cov))
        cov += np.eye(len(cov)) * max(1e-4, 1e-3 * float(np.trace(pooled)) / len(cov))
        factor = np.linalg.cholesky(cov)
        means.append(own.mean(axis=0))
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
        prior.append(np.log(len(own) / len(x)))
    return Discriminant(np.array(means), np.array(whiten), np.array(log_det), np.array(prior))


def calibrate(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic scale and shift of the odds, by damped Newton steps on smoothed targets, ridged; the scale stays above zero."""
    spread = max(float(np.abs(odds).mean()), 1e-6)
    x = np.stack([odds / spread, np.ones(len(odds))], axis=1)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((np.logaddexp(0, z) - target * z).sum() + RIDGE / 2 * ((b - [1.0, 0.0]) ** 2).sum())

    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = logistic(x @ beta)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + RIDGE * np.eye(2), x.T @ (p - target) + RIDGE * (beta - [1.0, 0.0]))
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
    return float(max(beta[0], 1e-3) / spread), float(beta[1])


def fit(x: np.ndarray, y: np.ndarray, shrink_diagonal: float = SHRINK_DIAGONAL, shrink_pooled: float = SHRINK_POOLED) -> Discriminant | float:
    """The calibrated model, or a constant score where there are not two classes."""
    if len(np.unique(y)) < 2:
        return float(y[0]) if len(y) else 0.5
    aside = np.arange(len(y)) % ASIDE == 0
    if len(np.unique(y[aside])) < 2 or len(np.unique(y[~aside])) < 2:
        model = discriminant(x, y, shrink_diagonal, shrink_pooled)
        model.scale, model.shift = calibrate(model.odds(x), y)
    else:
        model = discriminant(x[~aside], y[~aside], shrink_diagonal, shrink_pooled)
        model.scale, model.shift = calibrate(model.odds(x[aside]), y[aside])
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offsets in slices(batch.column(0)):
            x = statistics(buf, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([lists, *(batch.column(c).slice(a, b - a) for c in (1, 2))], names=["x", "y", "doc_id"])


def _score(model: Discriminant | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in slices(batch.column(1)):
                s = np.full(b - a, model) if isinstance(model, float) else model.scores(statistics(buf, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s)], names=["doc_id", "score"])

    return run


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Discriminant | float:
    ship_package(docs.sparkSession)
    sample = training_rows(docs, labels, "quality", train_rows, MODULUS, HELD_OUT).select("text", "y", "doc_id")
    got = first_rows(sample.mapInArrow(_features, "x array<double>, y int, doc_id long"), train_rows, "doc_id", "y", "x").toArrow()
    if not got.num_rows:
        return 0.5
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    return fit(x, got["y"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score, predicted."""
    model = learn(docs, labels, train_rows)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = base.mapInArrow(_score(model), "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id"), MODULUS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _passing(model: Discriminant, threshold: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in slices(batch.column(at)):
                kept = batch.slice(a, b - a).filter(pa.array(model.scores(statistics(buf, offsets)) >= threshold))
                if kept.num_rows:
                    yield kept

    return run


def keep_good(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the classifier rejects, in the scan itself: no join brings the scores back.

    Where the labels have not two classes there is nothing to reject by, and all rows stay.
    """
    model = learn(docs, labels, train_rows)
    if isinstance(model, float):
        return docs
    return docs.mapInArrow(_passing(model, threshold, docs.columns.index("text")), docs.schema)
