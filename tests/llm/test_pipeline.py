import random

import pytest

import corpus_pipeline
from tests.llm import brute

pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    """Each stage against brute force on what its predecessor kept."""
    rng = random.Random(3)
    vocabulary = [f"word{k}" for k in range(400)]
    passage, item = rng.choices(vocabulary, k=60), rng.choices(vocabulary, k=14)
    docs, labels = [], []
    for i in range(160):
        words = rng.choices(vocabulary, k=rng.randrange(60, 120))
        if i % 8 == 0:
            words = [w.upper() + "!!" for w in words]
        elif i % 8 == 1:
            words[20:20] = passage
        elif i % 16 == 2:
            words[10:10] = item
        elif i % 8 == 3 and i > 8:
            words = docs[i - 1][1].split()
            words[5] = "changed"
        docs.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, int(i % 8 != 0), 0))
    docs += [docs[5], (700, None, None, None, None), (None, "a few words", "en", None, 11), (701, "", "en", "s", 0)]
    sf = f"file://{tmp_path}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    read, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, read, sf)
        out.write.parquet(f"{sf}/{name}")
        before, read = read, spark.read.parquet(f"{sf}/{name}")
        if name != "packing":
            assert read.columns == before.columns
        seen.append(read.collect())
    quality, near, cut, clean, pieces = seen
    assert {r.doc_id for r in quality} >= {i for i in range(160) if i % 8} - {None} and not {r.doc_id for r in quality} & {i for i in range(160) if i % 8 == 0}
    distinct = {r.doc_id: r.text for r in quality if r.doc_id is not None}
    kept = {i for i, (_, _, k) in brute.near_duplicates(list(distinct.items()), 5, 80).items() if k}
    assert sorted(r.doc_id for r in near if r.doc_id is not None) == sorted(kept)
    want = {i: k for i, _, _, k in brute.substring_dedup([(r.doc_id, r.text) for r in near], corpus_pipeline.PASSAGE_WORDS)}
    assert {r.doc_id: " ".join((r.text or "").split()) for r in cut} == want
    assert all(r.n_chars == len(r.text) for r in cut if r.doc_id is not None and r.doc_id % 8 == 1 and r.doc_id > 8 and r.doc_id < 160)
    assert {r.doc_id for r in cut} - {r.doc_id for r in clean} == {r.doc_id for r in cut if r.text and " ".join(item)[:60] in r.text}
    assert {p.doc_id for p in pieces} == {r.doc_id for r in clean}
    assert corpus_pipeline.run(spark, sf).count() == len(pieces)


def test_empty_documents(spark, tmp_path):
    sf = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).collect() == []
