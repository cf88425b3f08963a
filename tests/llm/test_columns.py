"""Columns of the caller with any names, also those that operators use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loquat.llm import decontaminate, katz, licenses, line_rules, neardup, ordinal, packing, records, substrings, toxicity
from loquat.llm.columns import Carried

DOCS = [(1, "a b c d e f g h", "s"), (2, "a b c d e f g h i", "s"), (3, None, None), (4, "", "s"), (1, "a b c d e f g h", "s")]
#: Names of added columns, of internal ones, and of those inside other tables.
CLASHES = """_kept _KEPT _n_words _n_removed _n_shingles _component _group _node _sig _bands _text _id _score _predicted _ll_toxic _ll_ordinary
_held_out _n_tokens _n_known _train_tokens _base_score _licenses _matches _items _spans _n_hit _hits _expected_grade _tail _row at p w g
block shard payload answers n_rows node root set a b c0 c1 c2 c9 label toxic grade quality start length ids sequence_id item_id item first words
_n_symbols _word_chars _n_dup_lines _n_repeat_words _n_removed_words _base_failed text_in _kept_in with.dot""".split()


def clashing(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    lower = set()
    for k, name in enumerate(CLASHES):
        if name.lower() not in lower:
            lower.add(name.lower())
            df = df.withColumn(name, F.lit(k))
    return df


def operators(spark):
    items = spark.createDataFrame([(1, "c d e f")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    grades = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, grade int")
    return {
        "licenses": licenses.scan_licenses,
        "substrings": lambda df: substrings.dedup_substrings(df, size=4),
        "neardup": neardup.near_duplicates,
        "katz": katz.score_documents,
        "line_rules": lambda df: line_rules.apply_line_rules(df, cleaned=True),
        "decontaminate": lambda df: decontaminate.find_contamination(df, items),
        "ordinal": lambda df: ordinal.score(df, ordinal.train(df, grades)),
        "toxicity": lambda df: toxicity.score(df, toxicity.train(df, labels)),
    }


@pytest.mark.parametrize("name", ["licenses", "substrings", "neardup", "katz", "line_rules", "decontaminate", "ordinal", "toxicity"])
def test_operators_keep_clashing_columns(spark, name):
    run = operators(spark)[name]
    plain = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    added = run(plain).columns[3:]
    for docs in (DOCS, []):
        df = clashing(spark, docs)
        out = run(df)
        theirs = out.columns[: len(df.columns)]
        assert len({c.lower() for c in out.columns}) == len(out.columns) and out.columns[len(df.columns) :] == added
        assert [c for c, was in zip(theirs, df.columns) if c != was] == [c for c, was in zip(theirs, df.columns) if was.lower() in {a.lower() for a in added}]
        rows = out.collect()
        assert len(rows) == len(docs)
        assert {tuple(r)[3 : len(df.columns)] for r in rows} == {tuple(r)[3:] for r in df.collect()}
        key = lambda r: repr((r["doc_id"], r["text"], *(r[c] for c in added if c != "_group")))
        if docs:
            assert sorted(map(key, rows)) == sorted(map(key, run(plain).collect()))


def test_records_and_packing_ignore_other_columns(spark, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    df = clashing(spark, DOCS)
    records.write_records(df, f"file://{tmp_path}/r", tokenizers.path("word_bpe_49k.json"))
    assert records.read_records(spark, f"file://{tmp_path}/r").count() == len(DOCS)
    assert packing.pack(df, tokenizers.path("byte_bpe_50k.json")).select("doc_id").distinct().count() == 4


def test_pipeline_stages_keep_clashing_columns(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read = clashing(spark, DOCS)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, read, str(tmp_path))
        assert out.columns == read.columns
        out.write.parquet(f"{tmp_path}/{k}")
        read = spark.read.parquet(f"{tmp_path}/{k}")
    assert corpus_pipeline.STAGES[-1][1](spark, read, str(tmp_path)).count() > 0


def test_names_are_found_and_renamed(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Text int, _x int, _x_in int")
    t = Carried(df)
    assert (t("text"), t("_x")) == ("c0", "c1")
    assert t.back(t.df.withColumn("_x", F.lit(9)), "_x").columns == ["Text", "_x_in_in", "_x_in", "_x"]
    with pytest.raises(ValueError):
        t("nothing")
    twice = df.select("_x", F.col("_x_in").alias("_x"), "Text")
    assert Carried(twice)("text") == "c2"
    with pytest.raises(ValueError):
        Carried(twice)("_x")
