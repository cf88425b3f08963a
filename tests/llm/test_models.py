"""The fitted models against plain versions of their definitions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from loquat.llm import ordinal, toxicity


class Plain:
    """Interpolated Kneser-Ney of some texts by dictionaries, over given word types and one unseen type."""

    def __init__(self, texts, types):
        self.types = types
        self.pairs = Counter(p for t in texts for p in zip(["<s>", *t.split()], t.split()))
        self.after, self.contexts = Counter(), Counter()
        for (v, w), c in self.pairs.items():
            self.after[v] += c
            self.contexts[w] += 1
        self.of_pairs, self.of_words = self.discounts(self.pairs), self.discounts(self.contexts)

    @staticmethod
    def discounts(counts):
        n = Counter(counts.values())
        out = [0, 0.75, 0.75, 0.75]
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            for k in (1, 2, 3):
                if n[k] and 0 < k - (k + 1) * y * n[k + 1] / n[k] < k:
                    out[k] = k - (k + 1) * y * n[k + 1] / n[k]
        return lambda c: out[min(c, 3)]

    def word(self, w):
        total, c = sum(self.contexts.values()), self.contexts[w]
        taken = sum(self.of_words(x) for x in self.contexts.values()) / total
        return (c - self.of_words(c)) / total + taken / (len(self.types) + 1)

    def pair(self, v, w):
        total = self.after[v]
        if not total:
            return self.word(w)
        taken = sum(self.of_pairs(c) for (x, _), c in self.pairs.items() if x == v) / total
        c = self.pairs[v, w]
        return (c - self.of_pairs(c)) / total + taken * self.word(w)


def test_likelihoods_equal_dictionary_kneser_ney():
    rng = random.Random(1)
    for own, sizes in ((toxicity.OWN, (25, 25)), ((0.3, 0.2), (40, 5)), ((1.0, 0.0), (20, 3))):
        texts = [[" ".join(rng.choices([f"w{k}" for k in range(30 + 10 * c)], k=rng.randrange(1, 40))) for _ in range(sizes[c])] for c in (0, 1)]
        asked = [*texts[0][:5], *texts[1][:3], "never seen w1 w1 w39", "", "w0"]
        types = {w for t in texts[0] + texts[1] for w in t.split()}
        plain = [Plain(t, types) for t in (*texts, texts[0] + texts[1])]
        model = toxicity.estimate([toxicity.Counts.of(toxicity.hashed(t)) for t in texts], own)
        like = model.likelihoods(toxicity.hashed(asked))
        for k in (0, 1):
            p = lambda v, w: own[0] * plain[k].pair(v, w) + own[1] * plain[k].word(w) + (1 - sum(own)) * plain[2].pair(v, w)  # noqa: B023, E731
            want = [sum(math.log(p(v, w)) for v, w in zip(["<s>", *t.split()], t.split())) for t in asked]
            assert np.allclose(like[k], want, rtol=1e-6, atol=1e-6)
            for v in ("<s>", "w0", "w39", "nowhere"):
                assert math.isclose(sum(p(v, w) for w in types) + p(v, "never"), 1, rel_tol=1e-9)


def test_discounts_lie_between_nothing_and_the_count():
    rng = np.random.default_rng(1)
    for n in ([1] * 50 + [2] * 20 + [3] * 10 + [4] * 5, [1, 1, 2], [1], [5, 6, 7], [1] * 9 + [2], rng.geometric(0.5, 1000).tolist(), rng.integers(1, 9, 1000).tolist()):
        n = np.array(n)
        taken = toxicity.discounts(n)
        assert ((taken > 0) & (taken < n)).all() and len(set(taken[n >= 3].tolist())) <= 1
    # n1 = 50, n2 = 20, n3 = 10: y = 50 / 90, 1 - 2 y 20 / 50
    assert math.isclose(toxicity.discounts(np.array([1] * 50 + [2] * 20 + [3] * 10 + [4] * 5))[0], 1 - 2 * 50 / 90 * 20 / 50)


def test_no_bigram_is_left_out_and_counts_travel_packed():
    rng = random.Random(2)
    texts = [[" ".join(rng.choices([f"w{k}" for k in range(300)], k=50)) for _ in range(n)] for n in (60, 9)]
    counts = [toxicity.Counts.of(toxicity.hashed(t)) for t in texts]
    model = toxicity.estimate(counts)
    for c, t in zip(counts, texts):
        assert len(c.n) == len({p for x in t for p in zip(["<s>", *x.split()], x.split())})
        assert np.isin(toxicity.pair_key(c.before, c.word), model.pair).all()
        again = toxicity.Counts.unpacked(c.packed())
        assert all(np.array_equal(getattr(c, x), getattr(again, x)) for x in ("before", "word", "n"))
        half = toxicity.Counts.of(toxicity.hashed(t[:4])) + toxicity.Counts.of(toxicity.hashed(t[4:]))
        assert all(np.array_equal(getattr(c, x), getattr(half, x)) for x in ("before", "word", "n"))
    assert (model.p_pair > 0).all()


def plain_loss(rows, counts, y, weights, thresholds, decay):
    """Mean negative log-likelihood of a cumulative-link model, a document at a time."""
    sigma = lambda z: 1 / (1 + math.exp(-z))
    total = 0.0
    for index, count, grade in zip(rows, counts, y):
        eta = sum(weights[i] * c for i, c in zip(index, count)) / max(1, sum(count))
        upper = 1.0 if grade == len(thresholds) else sigma(thresholds[grade] - eta)
        lower = 0.0 if grade == 0 else sigma(thresholds[grade - 1] - eta)
        total -= math.log(upper - lower)
    return total / len(rows) + decay / 2 * sum(w * w for w in weights)


def problem(seed=0, n=40, bits=4):
    rng = np.random.default_rng(seed)
    rows = [np.unique(rng.integers(0, 1 << bits, 6)) for _ in range(n)]
    counts = [rng.integers(1, 4, len(r)).astype(float) for r in rows]
    y = np.array([int(np.clip((r < 5).sum() + rng.integers(0, 2), 0, 3)) for r in rows])
    return rows, counts, y


def test_ordinal_gradient_equals_numeric_differences():
    rows, counts, y = problem()
    levels, y = np.unique(y, return_inverse=True)
    rng = np.random.default_rng(1)
    weights, free = rng.normal(size=16), np.array([-0.7, 0.2, -0.4])[: len(levels) - 1]
    decay, step = 1e-2, 1e-6
    thresholds = lambda f: np.cumsum(np.r_[f[0], np.exp(f[1:])])
    g, g_free = ordinal.gradient(rows, counts, y, weights, free, decay)
    for k in range(16):
        up, down = weights.copy(), weights.copy()
        up[k] += step
        down[k] -= step
        assert math.isclose(g[k], (plain_loss(rows, counts, y, up, thresholds(free), decay) - plain_loss(rows, counts, y, down, thresholds(free), decay)) / (2 * step), rel_tol=1e-4, abs_tol=1e-7)
    for k in range(len(free)):
        up, down = free.copy(), free.copy()
        up[k] += step
        down[k] -= step
        assert math.isclose(g_free[k], (plain_loss(rows, counts, y, weights, thresholds(up), decay) - plain_loss(rows, counts, y, weights, thresholds(down), decay)) / (2 * step), rel_tol=1e-4, abs_tol=1e-7)


def test_ordinal_fit_approaches_the_least_loss():
    """The loss is convex in weights and thresholds: plain gradient descent finds its least value."""
    rows, counts, y = problem(2)
    levels, y = np.unique(y, return_inverse=True)
    decay = 1e-2
    weights, free = np.zeros(16), np.r_[-1.0, np.zeros(len(levels) - 2)]
    for _ in range(6000):
        g, g_free = ordinal.gradient(rows, counts, y, weights, free, decay)
        weights, free = weights - 2.0 * g, free - 0.2 * g_free
    least = plain_loss(rows, counts, y, weights, np.cumsum(np.r_[free[0], np.exp(free[1:])]), decay)
    model = ordinal.fit(rows, counts, levels[y], bits=4, epochs=600, rate=0.02, decay=decay)
    assert np.array_equal(model.grades, levels)
    assert plain_loss(rows, counts, y, model.weights, model.thresholds, decay) < least + 2e-3


def test_ordinal_scores_equal_the_definition():
    texts = ["Plain words here here", "LOUD!! 12 words, here", "", None, "ünïcode — x"]
    rng = np.random.default_rng(3)
    model = ordinal.Ordinal(rng.normal(size=1 << 8), np.array([-0.5, 0.8]), np.array([0, 2, 3]))
    every, n = ordinal.features(texts, 8)
    ends = np.cumsum(n)
    tails = model.tails(model.eta(texts))
    for k in range(len(texts)):
        own = Counter(every[ends[k] - n[k] : ends[k]].tolist())
        eta = sum(model.weights[i] * c for i, c in own.items()) / max(1, sum(own.values()))
        p = [1 / (1 + math.exp(-(eta - t))) for t in model.thresholds]
        assert np.allclose(tails[k], p)
        assert math.isclose(model.expected(tails)[k], 0 * (1 - p[0]) + 2 * (p[0] - p[1]) + 3 * p[1], rel_tol=1e-9, abs_tol=1e-12)
    assert np.allclose(model.tail(tails, 1), tails[:, 0]) and np.allclose(model.tail(tails, 3), tails[:, 1]) and set(model.tail(tails, 4)) == {0.0}


def test_words_and_shapes_are_features():
    """Of each word: itself, its shape, the pair of its and the last shape, and itself or the mark of a repeat."""
    counted = defaultdict(set)
    for k, text in enumerate(["a b", "a a", "A B", "a1 b2"]):
        every, n = ordinal.features([text], 16)
        assert n.tolist() == [8] and len(every) == 8
        counted[k] = set(every.tolist())
    assert len(counted[0] & counted[2]) >= 4  # words and repeats are told without case
    assert counted[0] != counted[1]


def test_many_ordinary_words_do_not_outweigh_a_toxic_one():
    rng = np.random.default_rng(5)
    usual = lambda n: " ".join(f"w{i}" for i in rng.zipf(1.3, n) % 3000)
    texts = [[usual(60) for _ in range(200)], [f"{usual(30)} idiot {usual(30)}" for _ in range(20)]]
    model = toxicity.estimate([toxicity.Counts.of(toxicity.hashed(t)) for t in texts])
    clean, toxic = [usual(3000) for _ in range(40)], [" ".join(f"{usual(1500)} idiot" for _ in range(2)) for _ in range(40)]
    x = model.ratios(toxicity.hashed(clean + toxic))
    assert toxicity._ranked(x, np.repeat([0, 1], 40)) > 0.9
