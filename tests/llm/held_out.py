"""Held-out figures of the toxicity query: ``python -m tests.llm.held_out SF_DIR [SHUFFLES]``.

First on the query's own fold (crc32 of the id mod 5), then on other folds of a fifth."""

import sys

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loquat.llm import toxicity


def figures(spark, sf_dir, salt=""):
    """(area under the curve, precision and recall at 0.5, toxic rows, rows) on the fold that ``salt`` picks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    held = F.crc32(F.concat(F.lit(salt), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0
    model = toxicity.train(docs, labels.where(~held))
    rows = toxicity.score(docs.join(labels.where(held).select("doc_id", "toxic"), "doc_id"), model).select("toxic", "_score").toArrow()
    y, x = rows["toxic"].to_numpy().astype(int), rows["_score"].to_numpy()
    found = x >= 0.5
    return toxicity._ranked(x, y), y[found].mean() if found.any() else 0.0, found[y == 1].mean(), int(y.sum()), len(y)


if __name__ == "__main__":
    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    print("query's fold: AUC %.3f precision %.3f recall %.3f of %d toxic in %d" % figures(session, sys.argv[1]), flush=True)
    other = [figures(session, sys.argv[1], f"fold {k} ") for k in range(int(sys.argv[2]) if len(sys.argv) > 2 else 0)]
    for x in other:
        print("another fold: AUC %.3f precision %.3f recall %.3f of %d toxic in %d" % x, flush=True)
    if other:
        auc, _, recall, _, _ = np.array(other).T
        print(f"AUC {auc.mean():.3f}, deviation {auc.std():.3f}; recall {recall.mean():.3f}, deviation {recall.std():.3f}")
