import random

import pytest

from loquat.llm import substrings
from loquat.llm.substrings import dedup_substrings
from tests.llm import brute


def run(spark, docs, size=4, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(((r.doc_id, r._n_words, r._n_removed, r._kept) for r in dedup_substrings(df.repartition(3), size=size, **kw).collect()), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["naïve", "日本語"]
    passages = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(5)]
    docs = []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.5:
            text.insert(rng.randrange(len(text) + 1), rng.choice(passages))
        docs.append((i, rng.choice([" ", "\n", "  "]).join(text)))
    return docs + [(500, docs[3][1]), (501, None), (502, ""), (503, " \t\n"), (None, docs[5][1]), (None, docs[5][1]), (7, docs[7][1])]


@pytest.mark.parametrize("block_bytes", [1, 4000, 8 << 20])
def test_matches_brute_force(spark, block_bytes):
    docs = corpus(block_bytes)
    assert run(spark, docs, block_bytes=block_bytes) == sorted(brute.substring_dedup(docs, 4), key=repr)


def test_windows_are_judged_on_the_input(spark):
    docs = [(1, "a b c d e f"), (2, "c d e f g h"), (3, "e f g h i j")]
    assert run(spark, docs) == brute.substring_dedup(docs, 4)


def test_cleaned_text_keeps_other_white_space_and_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", "x"), (2, "one\n\ntwo  a b c d\nthree", "y"), (3, None, "z")], "doc_id long, text string, shard string")
    rows = {r.doc_id: r for r in dedup_substrings(df, size=4, cleaned=True).collect()}
    assert rows[2]._kept == "one\n\ntwo\nthree" and rows[2].shard == "y"
    assert rows[1]._kept == "a b c d" and rows[3]._kept is None


def test_empty_table(spark):
    assert run(spark, []) == []


def test_very_long_text(spark):
    long = " ".join(f"t{k}" for k in range(120_000))
    got = run(spark, [(1, long), (2, "x " + long)], size=13)
    assert got[1][1:3] == (120_001, 120_000) and got[1][3] == "x"


def test_a_block_takes_little_more_than_its_windows():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(50_000)]
    texts = [" ".join(vocabulary[k] for k in rng.integers(0, len(vocabulary), 500)) for _ in range(1_200)]
    rows, words = pa.table({"doc_id": range(len(texts)), "text": texts}), 500 * len(texts)
    total = 20 * words
    ask = substrings._count("text", 25, 1, total)
    list(ask(rows.slice(0, 10)))  # tables that stay
    tracemalloc.start()
    try:
        asked = dict(ask(rows))
        assert tracemalloc.get_traced_memory()[1] < 90 * words
        answers = {s: substrings._merge(total)(s, [x])[0] for s, x in asked.items()}
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        list(substrings._candidates("text", "doc_id", 25, 1, total)(rows, answers))
        assert tracemalloc.get_traced_memory()[1] - before < 60 * words
    finally:
        tracemalloc.stop()


def test_runs_hash_alike_wherever_they_are(monkeypatch):
    import numpy as np

    from loquat.llm import text

    words = text.Words.of([b"a b c d e f g", b"", b"c d e", b"b"] * 9)
    first = np.sort(np.r_[np.arange(len(words.hashes) - 3), 4, 4])
    length = first % 4
    whole = words.runs(first, length, 3)
    monkeypatch.setattr(text, "_RUNS", 5)
    assert np.array_equal(words.runs(first, length, 3), whole)
    mixed = np.random.default_rng(1).permutation(len(first))
    assert np.array_equal(words.runs(first[mixed], length[mixed], 3), whole[mixed])
    monkeypatch.setattr(text, "_HASHED", 4)
    again = text.Words.of([b"a b c d e f g", b"", b"c d e", b"b"] * 9)
    assert np.array_equal(again.hashes, words.hashes) and np.array_equal(again.counts, words.counts)
