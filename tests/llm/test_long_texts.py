"""A text of some megabytes in every operator: whole results, no prefix of it."""

import math
import random

import numpy as np
import pytest

from loquat.llm import decontaminate, katz, licenses, line_rules, neardup, ordinal, packing, records, toxicity

WORDS = 300_000


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(4)
    vocabulary = [f"word{k}" for k in range(5000)] + ["naïve", "日本", "x,y", "Ünder"]
    lines = [" ".join(rng.choices(vocabulary, k=20)) for _ in range(WORDS // 20)]
    return "\n".join(lines)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)


def test_rules_on_a_long_text(spark, long_text):
    notice = licenses.TEMPLATES["rights-reserved"]
    rows = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, [(1, f"{long_text} {notice}", "s"), (2, "short", "s")])).collect()}
    assert rows[1]._licenses == ["rights-reserved"] and rows[1]._n_words > WORDS and rows[2]._licenses == []
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.find_contamination(frame(spark, [(1, f"{long_text} {item}", "s"), (2, long_text, "s")]), items).collect()}
    assert (rows[1]._n_hit, list(rows[1]._items), rows[2]._n_hit) == (11, [7], 0) and rows[1]._n_words == rows[2]._n_words + 11
    row = line_rules.apply_line_rules(frame(spark, [(1, f"{long_text}\n{long_text}", "s")])).first()
    words = long_text.split()
    assert (row._n_words, row._word_chars) == (2 * WORDS, 2 * sum(map(len, words)))
    assert row._n_repeat_words == 2 * WORDS and row._base_failed and row._n_dup_lines >= WORDS // 20


def test_near_copies_of_a_long_text(spark, long_text):
    words = long_text.split()
    changed = list(words)
    for k in range(0, WORDS, 1000):
        changed[k] = "changed"
    other = random.Random(9).sample(words, WORDS)
    rows = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, [(5, long_text, "s"), (6, " ".join(changed), "s"), (7, " ".join(other), "s")]), size=5).collect()}
    assert [rows[i]._component for i in (5, 6, 7)] == [5, 5, 7]


def test_tokens_of_a_long_text(spark, long_text, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = f"file://{tmp_path}/r"
    records.write_records(frame(spark, [(1, long_text, "s"), (2, None, "s")]), path, tokenizers.path("word_bpe_49k.json"))
    ids = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json")).encode(long_text, add_special_tokens=False).ids
    rows = {r.doc_id: r for r in records.read_records(spark, path).collect()}
    assert np.array_equal(np.frombuffer(rows[1].ids, "<u4"), [*ids, 1]) and rows[2].start == len(ids) + 1
    pieces = packing.pack(frame(spark, [(1, long_text, "s"), (2, "few words", "s")]), tokenizers.path("byte_bpe_50k.json")).collect()
    own = sorted((p.start, p.length) for p in pieces if p.doc_id == 1)
    assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) == next(p.doc_tokens for p in pieces if p.doc_id == 1)


def test_models_on_a_long_text(spark, long_text):
    docs = [(1, long_text, "s"), (2, "word1 word2", "s"), (3, "word3 awful word4 awful", "s"), (4, "", "s")]
    rows = {r.doc_id: r for r in katz.score_documents(frame(spark, docs), order=3).collect()}
    assert rows[1]._n_tokens == WORDS + 1 and math.isfinite(rows[1]._score) and rows[1]._score < 0
    df = frame(spark, docs)
    model = toxicity.train(df, spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 0)], "doc_id long, toxic int"))
    assert all(0 <= r._score <= 1 for r in toxicity.score(df, model).collect())
    graded = ordinal.train(df, spark.createDataFrame([(1, 2), (2, 2), (3, 1), (4, 0)], "doc_id long, grade int"))
    assert all(0 <= r._tail <= 1 for r in ordinal.score(df, graded).collect())
