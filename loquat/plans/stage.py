"""Tables written between the steps of a plan, so that what is costly (parsing) is done once.

They go to the folder the cluster names in ``spark.checkpoint.dir``: every executor can read them again,
whatever is lost. Without that setting a local folder is chosen, which only a local session may do.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def folder(spark: SparkSession) -> str:
    """Root of the tables. An error on a cluster that names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named or current.isDefined():
        return (named or str(current.get())).rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="loquat-stage-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


_paths: list[str] = []


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Tables written within a ``with`` go at its end: for results that have been used up by then."""
    before = len(_paths)
    try:
        yield
    finally:
        while len(_paths) > before:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_paths.pop())
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, written as Parquet and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/loquat/{label}-{uuid.uuid4().hex}"
    _paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
