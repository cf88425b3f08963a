"""Quality by ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= k | x) = sigma(theta_k - w . x), theta ascending: one weight vector for all thresholds. x is
the mean over a text's hashed features: lower-cased words, word shapes (runs of upper case, lower
case, digits and each sign), pairs of neighbouring shapes, and words that repeat the word before.
Scores are the expected grade and tail probabilities P(grade >= k), by which documents are selected.

Fitting uses a bounded sample of rated rows: the ``max_rows`` smallest by a hash of the id. Only their
feature counts come to the driver. Scoring is one pass without a shuffle; weights are broadcast (2^bits
floats).

Defined cases: null or empty text has no features and gets the scores of the thresholds alone; null
grades or ids are not learned from; repeated rows count as often as they occur; grades absent from the
sample are merged into the next lower one present; with fewer than two grades rated, every text gets
the one grade there is (0 if none); other columns pass through (see ``columns`` for names that clash); an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loquat.llm.columns import Carried
from loquat.llm.text import Words, encode, give_back, lean, mix

BITS = 16
_SHAPES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_REPEAT = np.uint64(0xABCDEF)


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of all texts, features of each text)"""
    raws = [encode(x) for x in texts]
    words = Words.of(raws, lower=True)
    shapes = []
    for raw in raws:
        x = np.frombuffer(raw.translate(_SHAPES), np.uint8)
        shapes.append(x[np.r_[True, x[1:] != x[:-1]]].tobytes() if len(x) else b"")
    shape = Words.of(shapes).hashes
    n = words.counts
    text = np.repeat(np.arange(len(n)), n)
    later = np.r_[False, text[1:] == text[:-1]] if len(text) else np.empty(0, bool)
    before = np.r_[np.uint64(0), shape[:-1]] if len(text) else shape
    pair = np.where(later, mix(before * np.uint64(3) + shape), shape)
    again = np.where(later & (words.hashes == np.r_[np.uint64(0), words.hashes[:-1]] if len(text) else later), _REPEAT, words.hashes)
    salted = [mix(h + np.uint64(k)) >> np.uint64(64 - bits) for k, h in enumerate((words.hashes, shape, pair, again))]
    every = np.stack(salted, 1).ravel().astype(np.int64) if len(text) else np.empty(0, np.int64)
    return every, 4 * n


@dataclass
class Ordinal:
    """Weights, ascending thresholds and the grades they separate."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def tails(self, eta: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1.., a column each."""
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.thresholds[None, :], -500, 500)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades).astype(np.float64)

    def tail(self, tails: np.ndarray, grade: int) -> np.ndarray:
        """P(grade >= ``grade``)."""
        k = int(np.searchsorted(self.grades, grade))
        if k == 0:
            return np.ones(len(tails))
        return tails[:, k - 1] if k < len(self.grades) else np.zeros(len(tails))

    def eta(self, texts: list[str | None]) -> np.ndarray:
        every, n = features(texts, int(np.log2(len(self.weights))))
        below = np.r_[0.0, np.cumsum(self.weights[every])]
        ends = np.cumsum(n)
        return (below[ends] - below[ends - n]) / np.maximum(n, 1)


def gradient(rows: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, weights: np.ndarray, free: np.ndarray, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log-likelihood and ``decay`` / 2 |weights|^2, by the weights and by ``free``: the first
    threshold and the logarithms of the gaps between thresholds."""
    n, k = len(rows), len(free)
    index = np.concatenate(rows)
    value = np.concatenate([c / max(1, c.sum()) for c in counts])
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    eta = np.bincount(owner, weights=weights[index] * value, minlength=n)
    theta = np.cumsum(np.r_[free[0], np.exp(free[1:])])
    cdf = 1 / (1 + np.exp(-np.clip(theta[None, :] - eta[:, None], -500, 500)))
    full = np.hstack([np.zeros((n, 1)), cdf, np.ones((n, 1))])
    slope, at = full * (1 - full), np.arange(n)
    p = np.maximum(full[at, y + 1] - full[at, y], 1e-12)
    d_upper, d_lower = -slope[at, y + 1] / p, slope[at, y] / p
    d_eta = -(d_upper + d_lower) / n
    d_theta = np.zeros(k + 2)
    np.add.at(d_theta, y + 1, d_upper / n)
    np.add.at(d_theta, y, d_lower / n)
    d_theta = np.cumsum(d_theta[1:-1][::-1])[::-1]
    g = np.bincount(index, weights=d_eta[owner] * value, minlength=len(weights)) + decay * weights
    return g, np.r_[d_theta[0], d_theta[1:] * np.exp(free[1:])]


def fit(rows: list[np.ndarray], counts: list[np.ndarray], grades: np.ndarray, bits: int = BITS, epochs: int = 30, rate: float = 0.3, decay: float = 1e-6, seed: int = 0) -> Ordinal:
    """Adam on the negative log-likelihood, in mini-batches. Rows: feature numbers and their counts."""
    levels, y = np.unique(grades, return_inverse=True)
    weights = np.zeros(1 << bits)
    if len(levels) < 2:
        return Ordinal(weights, np.empty(0), levels if len(levels) else np.zeros(1, np.int64))
    k = len(levels) - 1
    share = np.clip(np.cumsum(np.bincount(y))[:-1] / len(y), 1e-6, 1 - 1e-6)
    start = np.log(share / (1 - share))
    free = np.r_[start[0], np.log(np.maximum(np.diff(start), 1e-3))]  # thresholds: first, then log gaps
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros(k), np.zeros(k)]
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            batch = order[at : at + 256]
            g, g_free = gradient([rows[i] for i in batch], [counts[i] for i in batch], y[batch], weights, free, decay)
            step += 1
            for x, grad, m, v in ((weights, g, *moments[:2]), (free, g_free, *moments[2:])):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                x -= (rate if x is weights else 0.02) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Ordinal(weights, np.cumsum(np.r_[free[0], np.exp(free[1:])]), levels)


def train(df: DataFrame, ratings: DataFrame, text: str = "text", doc_id: str = "doc_id", grade: str = "grade", max_rows: int = 8000, bits: int = BITS, **kw) -> Ordinal:
    """Fit on at most ``max_rows`` rated rows of ``ratings`` (id, grade) and their texts in ``df``."""
    rated = ratings.select(F.col(doc_id).alias("_id"), F.col(grade).cast("long").alias("_grade")).dropna()
    sample = rated.orderBy(F.xxhash64("_id"), "_id", "_grade").limit(max_rows)  # so many short rows may be broadcast
    joined = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                every, n = features(batch.column("_text").to_pylist(), bits)
                found = [np.unique(x, return_counts=True) for x in np.split(every, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.string()), batch.column("_grade"), pa.array([a.astype("<u4").tobytes() for a, _ in found], pa.binary()), pa.array([b.astype("<u4").tobytes() for _, b in found], pa.binary())], names=["id", "grade", "index", "count"])

    rows = joined.select("_id", "_grade", "_text").mapInArrow(lean(run), "id string, grade long, index binary, count binary")
    rows = rows.orderBy(F.xxhash64("id"), "id", "grade", "index", "count").limit(max_rows).toArrow()  # an id may be repeated
    rows = sorted(zip(*(rows[c].to_pylist() for c in ("id", "grade", "index", "count")), strict=True))
    try:
        return fit([np.frombuffer(x[2], "<u4").astype(np.int64) for x in rows], [np.frombuffer(x[3], "<u4").astype(np.float64) for x in rows], np.array([x[1] for x in rows], np.int64), bits, **kw)
    finally:
        rows = None
        give_back()  # the sample is large beside what the driver holds otherwise


def score(df: DataFrame, model: Ordinal, text: str = "text", grade: int = 1, least: float = 0.5) -> DataFrame:
    """``df``'s columns and ``_expected_grade``, ``_tail`` (P(grade >= ``grade``)) and ``_kept`` (tail at least ``least``)."""
    carried = Carried(df)
    df, text = carried.df, carried(text)
    shared = df.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds, model.grades))
    added = [("_expected_grade", T.DoubleType()), ("_tail", T.DoubleType()), ("_kept", T.BooleanType())]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Ordinal(*shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                tails = fitted.tails(fitted.eta(batch.column(text).to_pylist()))
                tail = fitted.tail(tails, grade)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fitted.expected(tails)), pa.array(tail), pa.array(tail >= least)], names=[*batch.schema.names, "_expected_grade", "_tail", "_kept"])

    return carried.back(df.mapInArrow(lean(run), schema), *(n for n, _ in added))
