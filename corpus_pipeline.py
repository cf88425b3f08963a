"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``docs``, whatever they are
besides ``doc_id`` and ``text`` (``n_chars``, where present, follows the text). Stages handle nulls,
repeated rows and empty tables as their operators define.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquat.llm import decontaminate, neardup, ordinal, packing, storage, substrings
from loquat.llm.columns import Carried
from loquat.llm.queries import grades, table

#: Words of a repeated passage. Shorter repeats (notices, stock phrases) are ordinary text.
PASSAGE_WORDS = 25


_intermediate: list[str] = []


def stage(function):
    """A stage's own intermediate tables go when the next stage begins: by then its result is written."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _intermediate:
            storage.delete(spark, _intermediate.pop())
        before = set(storage.paths())
        # Columns that no stage uses have other names meanwhile, so that theirs clash with nothing.
        carried = Carried(docs, *(c for c in ("doc_id", "text", "n_chars") if c in docs.columns))
        out = function(spark, carried.df, sf_dir)
        if out.columns == carried.own:
            out = carried.back(out)
        _intermediate.extend(x for x in storage.paths() if x not in before)
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents whose probability of a grade of one or more is under one half."""
    model = ordinal.train(docs, grades(table(spark, sf_dir, "labels")))
    return ordinal.score(docs, model).where("_kept").select(docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one with the least id, once."""
    kept = neardup.near_duplicates(docs, size=5, percent=80).where("_kept")
    # Repeated rows of the least id are copies too; texts without words have no group.
    grouped = kept.where("_group IS NOT NULL").dropDuplicates(["_group"])
    return grouped.unionByName(kept.where("_group IS NULL")).select(docs.columns)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document with a smaller id has too."""
    cut = substrings.dedup_substrings(docs, size=PASSAGE_WORDS, cleaned=True)
    changed = F.col("_n_removed") > 0
    new = {"text": F.col("_kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumns(new).select(docs.columns)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that hold ten consecutive words of a benchmark item."""
    return decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")).where("_n_hit = 0").select(docs.columns)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cost-balanced sequences of at most 2048 tokens, a row a piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Two stages fit or tokenize outside SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = storage.materialise(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
