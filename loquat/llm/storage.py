"""Shared intermediate storage and file access that works on every node.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``.
Only where that setting is absent (tests, notebooks) is a local folder chosen.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_open: list[str] = []
_tables: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Root of shared intermediate files; a private temp folder only if a local session names none."""
    global _local_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no shared folder: executors would each write to their own")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="loquat-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return f"file://{_local_dir}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique path below the shared folder, remembered for ``paths``."""
    path = f"{shared_dir(spark)}/loquat/{label}-{uuid.uuid4().hex}"
    _open.append(path)
    return path


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the length of a ``with``."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts lineage, survives lost executors.

    Shuffle files of the write are not needed afterwards, and go at its end."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def name_table(path: str, name: str) -> None:
    """The catalog's name of the table at a path, dropped with it."""
    _tables[path] = name


def delete(spark: SparkSession, path: str) -> None:
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _open:
        _open.remove(path)


def paths() -> list[str]:
    """Intermediate paths made by this process and not deleted yet."""
    return list(_open)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI, usable inside executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
