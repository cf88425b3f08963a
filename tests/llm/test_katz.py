import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from loquat.llm import katz
from tests.llm import brute


def corpus(seed=0, n=200):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    docs = []
    for i in range(n):
        w = ["w0"]
        for _ in range(rng.randrange(0, 40)):
            w.append(vocabulary[min(39, int(rng.expovariate(0.2)))] if rng.random() < 0.6 else f"W{int(w[-1][1:]) // 2}" if w[-1][1:].isdigit() else "w1")
        docs.append((i, " ".join(w) + (f" rare{i}" if i % 3 == 0 else "")))
    return docs + [(900, None), (901, ""), (902, "unseen words only here")]


class Plain:
    """Katz by dictionaries."""

    def __init__(self, docs, order):
        self.order, self.counts = order, [None, Counter()]
        train = [[*brute.words(brute.lower(t)), "</>"] for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
        for n in range(1, order + 1):
            grams = Counter(tuple(w[k : k + n]) for w in train for k in range(len(w) - n + 1))
            self.counts[n:] = [grams]
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.after = [None, None] + [defaultdict(dict) for _ in range(2, order + 1)]
        self.d = [None, None]
        for n in range(2, order + 1):
            for g, c in self.counts[n].items():
                self.after[n][g[:-1]][g[-1]] = c
            of = Counter(self.counts[n].values())
            self.d.append(katz.good_turing(np.array([0] + [of[r] for r in range(1, katz.K + 2)])))

    def p(self, history, w):
        n = len(history) + 1
        if n == 1:
            return (self.counts[1][(w,)] + 1) / (self.n + self.v + 1)
        seen = self.after[n].get(history)
        if not seen:
            return self.p(history[1:], w)
        total, d = sum(seen.values()), self.d[n]
        kept = sum(d[min(c, katz.K + 1)] * c for c in seen.values())
        cut = 0.5 / total if kept >= total else 0.0
        if w in seen:
            return d[min(seen[w], katz.K + 1)] * seen[w] / total * (1 - cut)
        return (1 - kept / total + cut) / (1 - sum(self.p(history[1:], x) for x in seen)) * self.p(history[1:], w)

    def score(self, text):
        w = [*brute.words(brute.lower(text)), "</>"]
        return sum(math.log10(self.p(tuple(w[max(0, k - self.order + 1) : k]), x)) for k, x in enumerate(w))


@pytest.mark.parametrize("order,block_bytes", [(1, 1 << 20), (2, 2000), (3, 900)])
def test_matches_brute_force(spark, order, block_bytes):
    docs = corpus()
    plain = Plain(docs, order)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = katz.score_documents(df, order=order, block_bytes=block_bytes).collect()
    assert len(rows) == len(docs)
    texts = dict(docs)
    for r in rows:
        w = [*brute.words(brute.lower(texts[r.doc_id])), "</>"]
        c = plain.counts[1]
        assert r._held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r._n_tokens, r._n_known, r._train_tokens) == (len(w), sum(c[(x,)] > 0 for x in w), plain.n)
        assert math.isclose(r._base_score, sum(math.log10((c[(x,)] + 1) / (plain.n + plain.v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r._score, plain.score(texts[r.doc_id]), rel_tol=1e-9)


def test_probabilities_sum_to_one():
    plain = Plain(corpus(3), 3)
    types = [g[0] for g in plain.counts[1]]
    for history in [(), ("w0",), ("w1",), ("nowhere",), ("w0", "w0"), ("w2", "w1"), *list(plain.after[3])[:10]]:
        total = sum(plain.p(history, w) for w in types) + plain.p(history, "never seen")
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_history_with_frequent_words_only_keeps_mass():
    p, alpha = katz.katz_terms(np.array([10, 12]), np.array([0, 0]), np.array([22]), np.array([[0] * katz.K + [22]]), np.array([0.5]), katz.good_turing(np.array([0, 100, 40, 20, 12, 8, 5])))
    assert math.isclose(p.sum() + alpha[0] * 0.5, 1) and alpha[0] > 0


def test_empty_table_nulls_and_no_training_rows(spark):
    assert katz.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(i for i in range(100) if katz.fold(i, 7, 2))
    row = katz.score_documents(spark.createDataFrame([(held, "a b", 1.5)], "doc_id long, text string, score double")).first()
    assert (row._train_tokens, row._base_score, row._score, row.score) == (0, 0.0, 0.0, 1.5)
    rows = katz.score_documents(spark.createDataFrame([(None, None), (None, "a")], "doc_id long, text string")).collect()
    assert sorted(r._n_tokens for r in rows) == [1, 2]


def test_tables_hold_the_training_counts(spark, tmp_path):
    docs = corpus(4, 40)
    katz.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), order=2, tables=f"file://{tmp_path}/t")
    plain = Plain(docs, 2)
    grams = spark.read.parquet(f"file://{tmp_path}/t/order=2")
    assert grams.count() == len(plain.counts[2]) and grams.agg({"count": "sum"}).first()[0] == sum(plain.counts[2].values())


def turing_by_fractions(n, k):
    """Katz (1987), equation by equation: {r: d(r)}, n[r] n-grams were seen r times."""
    star = {r: Fraction((r + 1) * n[r + 1], n[r]) for r in range(1, k + 1)}
    common = Fraction((k + 1) * n[k + 1], n[1])
    return {r: float((star[r] / r - common) / (1 - common)) for r in star}


@pytest.mark.parametrize(
    "n,top",
    [
        ([0, 45218, 4863, 1533, 328, 336, 86], 3),  # bigrams of sf0.001, sf0.01 and sf0.1, trigrams of sf0.1
        ([0, 193292, 25034, 6471, 2174, 2492, 616], 3),
        ([0, 1576946, 246201, 51516, 21650, 18912, 7557], 3),
        ([0, 2278202, 259021, 29174, 8769, 11511, 2734], 3),
        ([0, 100, 40, 20, 12, 8, 5], 5),
        ([0, 100, 20, 5, 0, 0, 0], 2),
    ],
)
def test_uneven_counts_keep_good_turing(n, top):
    d, expected = katz.good_turing(np.array(n)), turing_by_fractions(n, top)
    assert len(d) == katz.K + 2 and np.all(d[top + 1 :] == 1)
    for r, x in expected.items():
        assert math.isclose(d[r], x) and 0 < x < 1
    # What seen n-grams give up is what Good-Turing gives to unseen ones: n1 of all tokens.
    assert math.isclose(sum(n[r] * r * (1 - d[r]) for r in range(1, katz.K + 1)), n[1])


def test_counts_without_a_valid_cutoff_are_smoothed_or_absolute():
    n = [0, 100, 60, 10, 12, 3, 4]  # d(1) above 1 at every cut-off
    xs, ys = [math.log(r) for r in range(1, 7)], [math.log(x) for x in n[1:]]
    mx, my = sum(xs) / 6, sum(ys) / 6
    slope = sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / sum((x - mx) ** 2 for x in xs)
    common = 6 ** (slope + 1)
    d = katz.good_turing(np.array(n))
    for r in range(1, 6):
        assert math.isclose(d[r], (((r + 1) / r) ** (slope + 1) - common) / (1 - common))
    for degenerate in ([0] * 7, [0, 9, 0, 0, 0, 0, 0], [0, 5, 5, 5, 5, 5, 5]):
        assert list(katz.good_turing(np.array(degenerate))) == [1.0, 0.5, 0.75, 1 - 0.5 / 3, 0.875, 0.9, 1.0]


def test_registered_query_scores_trigrams(spark, tmp_path):
    from loquat.llm.queries import op6_katz_scores

    docs = corpus(5, 60)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    plain = Plain(docs, 3)
    for r in op6_katz_scores(spark, f"file://{tmp_path}").collect():
        assert math.isclose(r.score, plain.score(dict(docs)[r.doc_id]), rel_tol=1e-9)


def test_split_histories_change_nothing(spark):
    """Frequent histories over many shards, and with them the sums of their parts."""
    docs = corpus(6, 120)
    plain = Plain(docs, 3)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    for r in katz.score_documents(df, order=3, block_bytes=1500, split=7).collect():
        assert math.isclose(r._score, plain.score(dict(docs)[r.doc_id]), rel_tol=1e-9)


def test_tables_alone_reproduce_scores(spark, tmp_path, monkeypatch):
    from loquat.llm import exchange

    monkeypatch.setattr(exchange, "SHARD_KEYS", 300)
    docs = corpus(7, 120)
    plain = Plain(docs, 3)
    tables = f"file://{tmp_path}/model"
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    katz.score_documents(df, order=3, tables=tables, split=20).count()
    asked = [*docs[:60], *docs[-3:], (5000, "w0 w1 never w2 w3 W1 w0"), (5001, None), (5001, "w0 w0 w0")]
    rows = katz.score_by_tables(spark.createDataFrame(asked, "doc_id long, text string"), tables, order=3).collect()
    want = sorted((i, len(brute.words(brute.lower(t))) + 1, plain.score(t)) for i, t in asked)
    got = sorted((r.doc_id, r._n_tokens, r._score) for r in rows)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(math.isclose(a[2], b[2], rel_tol=1e-9) for a, b in zip(got, want))
    weights = spark.read.parquet(f"{tables}/histories/order=3")
    assert weights.count() == weights.select("history").distinct().count() == len(plain.after[3])
    n_row = {(r.history, r.word): r.n for r in spark.read.parquet(f"{tables}/order=2").groupBy("history", "word").count().withColumnRenamed("count", "n").collect()}
    assert set(n_row.values()) == {1}


def test_order_three_sends_few_bytes_and_answers_are_dealt_to_blocks_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from loquat.llm import exchange

    sizes, plans, ask = [], [], exchange.Blocks.ask

    def spied(self, *given):
        out = ask(self, *given)
        sizes.append(out.agg(F.sum(F.octet_length("payload"))).first()[0])
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(exchange.Blocks, "ask", spied)
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(f"w{k}" for k in np.minimum(rng.zipf(1.2, 2000), 50_000).tolist())) for i in range(100)]
    katz.score_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), order=3, block_bytes=1 << 18)
    assert sizes[2] < 380_000
    assert "Exchange hashpartitioning(block" not in plans[2]


def test_histories_by_runs_of_numbers_change_nothing(spark, tmp_path, monkeypatch):
    from loquat.llm import exchange

    monkeypatch.setattr(exchange, "SHARD_KEYS", 300)
    monkeypatch.setattr(katz, "RUNS", 2)
    docs = corpus(8, 120)
    plain = Plain(docs, 3)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    for r in katz.score_documents(df, order=3, block_bytes=1500, split=7, tables=f"file://{tmp_path}/model").collect():
        assert math.isclose(r._score, plain.score(dict(docs)[r.doc_id]), rel_tol=1e-9)
    words = spark.read.parquet(f"file://{tmp_path}/model/order=1").orderBy("shard", "rank").collect()
    assert all(a["count"] >= b["count"] for a, b in zip(words, words[1:]) if a["shard"] == b["shard"])
    assert katz.score_by_tables(df, f"file://{tmp_path}/model", order=3).count() == len(docs)
