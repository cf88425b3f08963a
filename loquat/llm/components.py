"""Connected components of an edge table by alternating large-star and small-star steps.

Each step hangs neighbours on the smallest node around; O(log^2) steps, no driver-side graph. A hub's
edges are joined to one pre-aggregated row a node, which adaptive execution splits when skewed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquat.llm import storage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over directed edges (u, v), v < u. Large: both directions; small: downwards only."""
    around = edges.unionByName(edges.selectExpr("v AS u", "u AS v")) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").selectExpr("v AS u", "m AS v")
    else:
        out = joined.where("v <> m").selectExpr("v AS u", "m AS v").unionByName(least.selectExpr("u", "m AS v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge: root is the smallest node of its component.

    ``edges``: two columns of one orderable type; direction, loops and repeats do not matter."""
    a, b = edges.columns
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = storage.materialise(now, "edges")
    mark = _mark(now)
    while True:
        now = storage.materialise(_star(_star(now, large=True), large=False), "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.selectExpr("u AS node", "v AS root").unionByName(now.selectExpr("v AS node", "v AS root").distinct())


def _mark(edges: DataFrame):
    """Equal for equal edge sets: a fixed point leaves it as it was."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
