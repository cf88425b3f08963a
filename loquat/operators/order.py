"""Places and ranks in a total order, without a window over all rows and without evaluating a sort twice.

Rows are sorted by range and written once, each with its partition and its place in it; both are read back from
then on, so a place cannot depend on how the sort is split when it is evaluated again. What goes before a partition
is a number a partition. Equal rows under the order have their places in one written order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loquat.plans import stage

_LOW = (1 << 33) - 1


def _sorted(rows: DataFrame, by: list, label: str) -> DataFrame:
    """``rows`` in order, with ``_part`` and ``_at`` (from 0) of each, written."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return stage.written(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW))}), label)


def placed(rows: DataFrame, *by, name: str = "place") -> DataFrame:
    """Column ``name``: the place of each row, from 1, in the order of ``by``."""
    ordered = _sorted(rows, list(by), "ordered")
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a short row a partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ordered.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).select(*rows.columns, name)


def ranked(rows: DataFrame, keys: list[str], by: list, name: str = "rank") -> DataFrame:
    """Column ``name``: the rank of each row, from 1, among rows of its (non-null) keys in the order of ``by``.

    A group of any size lies in as many partitions as its rows fill; a partition tells how many of a group's rows it
    has, and these few numbers are summed in order."""
    ordered = _sorted(rows, [*keys, *by], "ranked")
    runs = ordered.groupBy("_part", *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition that the group reaches
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = ordered.join(runs, ["_part", *keys])
    return out.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).select(*rows.columns, name)
