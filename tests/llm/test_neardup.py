import random

from loquat.llm import neardup
from loquat.llm.components import components
from tests.llm import brute


def run(spark, docs, size=4, percent=80):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: (r._n_shingles, r._component, r._kept) for r in neardup.near_duplicates(df.repartition(3), size=size, percent=percent).collect()}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)]
    docs = []
    for _ in range(n):
        docs.append(rng.choices(vocabulary, k=rng.randrange(1, 120)))
    for base in docs[:12]:
        copy = base
        for _ in range(12):  # a chain: neighbours are near, ends may not be
            copy = list(copy)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(copy)
    docs += docs[:20]
    rng.shuffle(docs)
    return [(i, " ".join(w)) for i, w in enumerate(docs)] + [(1000, None), (1001, ""), (1002, " \n "), (1003, "a b"), (1004, "A  B")]


def test_matches_brute_force(spark):
    docs = corpus(1)
    assert run(spark, docs) == brute.near_duplicates(docs, 4, 80)


def test_tiles_find_what_stars_miss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 3)
    docs = corpus(2, 40)
    assert run(spark, docs) == brute.near_duplicates(docs, 4, 80)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e", 1), (None, "a b c d e", 2), (5, "a b c d e", 3), (5, "q r s t u", 4), (None, "z z z z z z", 5), (None, None, 6)], "doc_id long, text string, sig int")
    rows = {r.sig: (r._component, r._kept) for r in neardup.near_duplicates(df).collect()}
    assert rows[1] == rows[2] == (5, False) and rows[3] == (5, True) and rows[4] == (5, True)
    assert rows[5] == (None, True) and rows[6] == (None, True)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_estimate_is_corrected_for_chance():
    import numpy as np

    rng = np.random.default_rng(0)
    ks = neardup.multipliers(960, 31).astype(np.uint32) | np.uint32(1)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = pool[:1000], pool[500:]
    x, y = (neardup.signature(neardup.minima(s, ks)) for s in (a, b))
    assert abs(neardup.estimate(x, y, 960) - 1 / 3) < 0.06


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 200), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).distinct().collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100}
