"""Toxicity by two class-conditional Kneser-Ney bigram models with shared back-off counts.

Words are runs of ASCII letters and digits and of all other characters beyond ASCII, lower-cased; what stands between them is not scored.
Three models are counted: one a class, and one of both classes' counts together. Each is interpolated
Kneser-Ney: P(w | v) = (c(v w) - D(c)) / c(v) + left(v) Q(w), with left(v) exactly what discounting took, and Q(w)
likewise from the distinct words before w, over one further type for all unseen words. Discounts of counts one, two, and
three or more come from counts of counts (Chen and Goodman) and lie between nothing and the count; where the counts give none such, 0.75.
No bigram is left out. A class's probability is the shared one in part, with weights
(``OWN``) of the class's own model P and of its own back-off counts Q: an expression that is rare in both classes counts by
the shared counts for both, and what the own counts say of it only shows where they say it much more often. That
matters where one class is small: its own model alone is surprised by most words of any text. Bigrams are mostly
met once, which says less than a word met often: hence the smaller weight.

A text is toxic by a few of its words, and the rest of it says nothing: over a long text, what chance makes of some thousand ordinary words
outweighs them. So a word counts by how much likelier the toxic class makes it, less a ``MARGIN``, and not at all below that: what is
usual in a text takes nothing back from an insult. A text's score is the sum of this, divided by its length, through a logistic curve. The curve is fitted on scores
of the sample's texts by models that were counted without them (``folds`` parts), each class weighing
the root of its share of all labelled rows.

The sample is bounded: of each class, the ``max_rows`` ids that are smallest by a hash, all of them up to that
number, and one row an id. Its words are hashed on the executors, and written once; their counts
reach the driver packed, by task. A model is broadcast, its size bounded by the sample. Scoring is one pass without a shuffle.

Defined cases: null or empty text is scored at length zero; null labels or ids are not learned from; of rows that
repeat an id one is learned from, and of labels the largest; where a class has no labelled rows the score is the
label's overall rate; a class of too few rows for ``folds`` has its curve fitted on the model's own texts; other columns pass through (see
``columns`` for names that clash); an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loquat.llm import storage
from loquat.llm.columns import Carried
from loquat.llm.exchange import join_parts, pack, pack_sorted, split_parts, unpack, unpack_sorted
from loquat.llm.licenses import INSIDE
from loquat.llm.text import Words, encode, give_back, lean, mix

#: Where counts of counts give no discount below the count.
DISCOUNT = 0.75
#: Weights of a class's own bigram model, and of its own back-off counts, beside the shared model.
OWN = (0.1, 0.5)
#: Of a word's log-likelihood ratio, what chance may make of it.
MARGIN = 0.5
#: Added to lengths, so that a few words are little evidence.
PRIOR_TOKENS = 20
FOLDS = 4
_START = np.uint64(7)


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing=0.0) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing, np.float64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def words_before(words: Words) -> np.ndarray:
    """The word before each word of some texts."""
    before = np.full(len(words.hashes), _START, np.uint64)
    before[1:] = words.hashes[:-1]
    before[words.first[words.counts > 0]] = _START
    return before


def hashed(texts: list[str | None]) -> Words:
    return Words.of([encode(x) for x in texts], INSIDE, lower=True)


@dataclass
class Counts:
    """Distinct bigrams, sorted by their keys, and how often each occurs."""

    before: np.ndarray
    word: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, words: Words) -> Counts:
        return cls.merged([(words_before(words), words.hashes, np.ones(len(words.hashes), np.int64))])

    @classmethod
    def merged(cls, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Counts:
        empty = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))
        before, word, n = (np.concatenate(x) for x in zip(empty, *parts, strict=True))
        _, first, number = np.unique(pair_key(before, word), return_index=True, return_inverse=True)
        return cls(before[first], word[first], np.bincount(number, n, len(first)).astype(np.int64))

    def __add__(self, other: Counts) -> Counts:
        return Counts.merged([(c.before, c.word, c.n) for c in (self, other)])

    def packed(self) -> bytes:
        names, number = np.unique(np.concatenate([self.before, self.word]), return_inverse=True)
        number = number.astype(np.uint32)
        return join_parts(pack_sorted(names), pack(number[: len(self.n)]), pack(number[len(self.n) :]), pack(self.n.astype(np.uint32)))

    @classmethod
    def unpacked(cls, raw: bytes) -> Counts:
        names, before, word, n = split_parts(raw)
        names = unpack_sorted(names)
        return cls(names[unpack(before)], names[unpack(word)], unpack(n).astype(np.int64))


def discounts(n: np.ndarray) -> np.ndarray:
    """What is taken from each count: by counts of counts for one, two, and three or more."""
    of = np.bincount(np.minimum(n, 5), minlength=6)[:5].astype(float)
    taken = np.full(4, DISCOUNT)
    if of[1] and of[2]:
        y = of[1] / (of[1] + 2 * of[2])
        for k in (1, 2, 3):
            d = k - (k + 1) * y * of[k + 1] / of[k] if of[k] else 0
            taken[k] = d if 0 < d < k else DISCOUNT
    return taken[np.minimum(n, 3)]


class Kneser:
    """Interpolated Kneser-Ney of some counts over the word types ``every`` (sorted) and one unseen type."""

    def __init__(self, counts: Counts, every: np.ndarray):
        self.pair = pair_key(counts.before, counts.word)
        self.before, number = np.unique(counts.before, return_inverse=True)
        total, taken = np.bincount(number, counts.n), discounts(counts.n)
        self.p_pair = (counts.n - taken) / total[number] if len(counts.n) else np.empty(0)
        self.left = np.bincount(number, taken) / total if len(counts.n) else np.empty(0)
        word, contexts = np.unique(counts.word, return_counts=True)
        held = np.zeros(len(every))
        held[np.searchsorted(every, word)] = (contexts - discounts(contexts)) / max(1, contexts.sum())
        rest = (1 - held.sum()) / (len(every) + 1)
        self.q, self.q_unseen = held + rest, rest


@dataclass
class Model:
    """Sorted keys with, for class 0 and 1 and both together (rows), masses of words and of what is left to them; of bigrams,
    for class 0 and 1, own and shared parts mixed; and the logistic curve."""

    word: np.ndarray
    q: np.ndarray
    q_unseen: np.ndarray
    before: np.ndarray
    left: np.ndarray
    pair: np.ndarray
    p_pair: np.ndarray
    own: tuple[float, float] = OWN
    slope: float = 0.0
    offset: float = 0.0
    unit: float = 1.0
    #: Area under the curve of the scores that the curve was fitted on, for reports.
    ranked: float = field(default=float("nan"), compare=False)

    def likelihoods(self, words: Words) -> np.ndarray:
        """Log-likelihood of each text by class, a row each."""
        return self.told(words)[:2]

    def told(self, words: Words) -> np.ndarray:
        """Likelihoods, and as a third row what a text's words say beyond ``MARGIN`` for class 1."""
        out = np.zeros((3, len(words.counts)))
        if not len(words.hashes) or not len(self.word):
            return out
        before = words_before(words)
        text = np.repeat(np.arange(len(words.counts)), words.counts)
        at, found = _places(self.word, words.hashes)
        q = np.where(found, self.q[:, at], self.q_unseen[:, None])
        at, found = _places(self.before, before)
        backed = q * np.where(found, self.left[:, at], 1.0)
        pairs, singles, rest = *self.own, 1 - sum(self.own)
        more = np.full(len(words.hashes), -MARGIN)
        at, found = _places(self.pair, pair_key(before, words.hashes))
        for c in (0, 1):
            p = np.where(found, self.p_pair[c, at], 0) + pairs * backed[c] + singles * q[c] + rest * backed[2]
            p = np.log(p)
            more += p if c else -p
            out[c] = np.bincount(text, weights=p, minlength=len(words.counts))
        out[2] = np.bincount(text, weights=np.maximum(more, 0), minlength=len(words.counts))
        return out

    def ratios(self, words: Words) -> np.ndarray:
        return self.told(words)[2] / (words.counts + PRIOR_TOKENS)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, log-likelihoods by class, words)"""
        words = hashed(texts)
        like = self.told(words)
        x = self.slope * np.arcsinh(like[2] / (words.counts + PRIOR_TOKENS) / self.unit) + self.offset
        return 1 / (1 + np.exp(-np.clip(x, -500, 500))), like[:2], words.counts


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def estimate(classes: list[Counts], own: tuple[float, float] = OWN) -> Model:
    """The model of the counts of class 0 and 1, without a curve."""
    both = classes[0] + classes[1]
    every = np.unique(both.word)
    models = [Kneser(c, every) for c in (*classes, both)]
    shared = models[2]
    left = np.stack([look_up(m.before, m.left, shared.before, 1.0) for m in models])
    parts = np.stack([look_up(m.pair, m.p_pair, shared.pair) for m in models])
    mixed = (own[0] * parts[:2] + (1 - sum(own)) * parts[2]).astype(np.float32)
    return Model(every, np.stack([m.q for m in models]), np.array([m.q_unseen for m in models]), shared.before, left, shared.pair, mixed, own)


def constant(rate: float) -> Model:
    """The score of every text is a rate."""
    rate, empty = float(np.clip(rate, 1e-6, 1 - 1e-6)), np.empty(0, np.uint64)
    return Model(empty, np.empty((3, 0)), np.ones(3), empty, np.empty((3, 0)), empty, np.empty((2, 0)), OWN, 0.0, float(np.log(rate / (1 - rate))))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of a weighted, lightly regularised logistic curve (Newton)."""
    scale = x.std() or 1.0
    z, beta = np.stack([x / scale, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        g = z.T @ (weight * (p - y)) + 1e-2 * np.r_[beta[0], 0]
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def _ranked(x: np.ndarray, y: np.ndarray) -> float:
    """Share of pairs of a toxic and an ordinary document that the score orders rightly."""
    order = np.argsort(np.argsort(x, kind="stable"), kind="stable")
    ones = int(y.sum())
    return (order[y == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(y) - ones))


def curve(x: np.ndarray, y: np.ndarray, rates: tuple[int, int], prior_power: float) -> tuple[float, float, float]:
    """Slope, offset and unit for ratios of both classes; a class weighs its labelled rows to a power, however many were scored.

    Ratios go in as inverse hyperbolic sines: large ones, of very short texts, do not bend the curve."""
    n = np.bincount(y, minlength=2)
    weight = np.array([rates[k] ** prior_power / n[k] for k in (0, 1)])[y]
    unit = float(np.median(np.abs(x[x != 0]))) if x.any() else 1.0
    return *calibrate(np.arcsinh(x / unit), y.astype(float), weight * len(y) / weight.sum()), unit


def _sampled(df: DataFrame, known: DataFrame, max_rows: int, folds: int) -> DataFrame:
    """(y, fold, words): hashed words of the sample's texts, a row an id, written to the shared folder."""
    parts = [known.where(F.col("_y") == c).orderBy(F.xxhash64("_id"), "_id").limit(max_rows) for c in (0, 1)]  # narrow and few

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                rows = batch.slice(i, 200)
                words = hashed(rows.column("_t").to_pylist())
                cuts = [words.hashes[a : a + n].tobytes() for a, n in zip(words.first.tolist(), words.counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("_id"), rows.column("_y"), pa.array(cuts, pa.binary())], names=["_id", "_y", "_w"])

    schema = T.StructType([T.StructField("_id", known.schema["_id"].dataType), T.StructField("_y", T.IntegerType()), T.StructField("_w", T.BinaryType())])
    rows = df.join(F.broadcast(parts[0].unionByName(parts[1])), "_id").select("_id", "_y", "_t").mapInArrow(lean(run), schema)
    one = rows.groupBy("_id", "_y").agg(F.min("_w").alias("_w"))
    return storage.materialise(one.select("_y", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(folds)).cast("int").alias("_fold"), "_w"), "labelled")


def _words(column: pa.Array) -> Words:
    parts = [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
    return Words(np.concatenate([*parts, np.empty(0, np.uint64)]), np.array([len(x) for x in parts], np.int64))


def _counted(sample: DataFrame) -> dict[tuple[int, int], Counts]:
    """Counts by class and fold, made by task and merged here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            keys = list(zip(batch.column("_y").to_pylist(), batch.column("_fold").to_pylist(), strict=True))
            for key in set(keys):
                words = _words(batch.column("_w").filter(pa.array([k == key for k in keys])))
                held.setdefault(key, []).append(Counts.of(words))
        for (y, fold), counts in held.items():
            one = Counts.merged([(c.before, c.word, c.n) for c in counts])
            yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([fold], pa.int32()), pa.array([one.packed()], pa.binary())], names=["_y", "_fold", "_counts"])

    out: dict[tuple[int, int], list[Counts]] = {}
    sums: dict[tuple[int, int], Counts] = {}
    table = sample.mapInArrow(lean(run), "_y int, _fold int, _counts binary").toArrow()
    for y, fold, raw in zip(*(table.column(c) for c in ("_y", "_fold", "_counts")), strict=True):
        out.setdefault((y.as_py(), fold.as_py()), []).append(Counts.unpacked(raw.as_py()))
    del table
    for k, v in out.items():  # one by one, so that parts and sums are not held twice
        sums[k] = Counts.merged([(c.before, c.word, c.n) for c in v])
        v.clear()
    give_back()
    return sums


def _scored(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(length-normalised evidence, class) of sampled texts."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.ratios(_words(batch.column("_w")))), batch.column("_y")], names=["x", "y"])

    rows = sample.mapInArrow(lean(run), "x double, y int").toArrow()
    shared.destroy()
    return rows["x"].to_numpy(), rows["y"].to_numpy().astype(np.int64)


def train(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_rows: int = 4000, folds: int = FOLDS, own: tuple[float, float] = OWN, prior_power: float = 0.5) -> Model:
    """Fit on at most ``max_rows`` labelled ids of each class. In the curve a class weighs its rate to the power ``prior_power``."""
    known = labels.select(F.col(doc_id).alias("_id"), (F.col(label) > 0).cast("int").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    counted = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    rates = counted.get(0, 0), counted.get(1, 0)
    sample = _sampled(df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")), known, max_rows, folds)
    counts = _counted(sample)
    both = lambda out=None: [Counts.merged([(c.before, c.word, c.n) for (y, f), c in counts.items() if y == k and f != out]) for k in (0, 1)]
    if {y for y, _ in counts} != {0, 1}:
        return constant(rates[1] / max(1, sum(rates)))
    held = []
    for fold in sorted({f for _, f in counts}):
        rest = both(fold)
        if all(len(c.n) for c in rest):
            held.append(_scored(sample.where(F.col("_fold") == fold), estimate(rest, own)))
        del rest
        give_back()
    # Last, so that it isn't held beside the others.
    model = estimate(both(), own)
    x, y = (np.concatenate(v) for v in zip(*held, strict=True)) if held else (np.empty(0), np.empty(0, np.int64))
    if len(set(y.tolist())) < 2:
        x, y = _scored(sample, model)
    model.slope, model.offset, model.unit = curve(x, y, rates, prior_power)
    model.ranked = _ranked(x, y)
    counts.clear()
    give_back()  # the counts are large beside what the driver holds otherwise
    return model


def score(df: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """``df``'s columns and ``_score``, ``_predicted``, ``_ll_toxic``, ``_ll_ordinary`` (natural logarithms)."""
    carried = Carried(df)
    df, text = carried.df, carried(text)
    shared = df.sparkSession.sparkContext.broadcast(model)
    added = [("_score", T.DoubleType()), ("_predicted", T.IntegerType()), ("_ll_toxic", T.DoubleType()), ("_ll_ordinary", T.DoubleType())]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                p, like, _ = fitted.score(batch.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= least).astype(np.int32)), pa.array(like[1]), pa.array(like[0])], names=[*batch.schema.names, "_score", "_predicted", "_ll_toxic", "_ll_ordinary"])

    return carried.back(df.mapInArrow(lean(run), schema), *(n for n, _ in added))


def in_fold(doc_id, folds: int, part: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == part
