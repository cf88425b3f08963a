"""Continuous scans: files analysed as they arrive.

``watch`` judges each file by itself; sinks get exactly-once micro-batches. ``follow`` keeps what it knows by path, in
the store that scans keep: a file that comes again unchanged is not parsed, one that is removed goes with all
that was found in it, and after any number of batches the store is that of a scan of the files there are. A batch that is
run again after a failure finds its files known and changes nothing. Tables between the steps go when a batch is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loquat.plans import stage
from loquat.plans.config import Config
from loquat.plans.scan import Scan, analyse, analyse_with_store, open_store

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, directory: str, checkpoint: str, sink: Callable[[Scan, int], None], config: Config = Config(), suffix: str = ".swift", available_now: bool = False) -> StreamingQuery:
    """Call ``sink`` with the analysis of every micro-batch of files."""
    raw = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(directory)
    files = raw.select("path", F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8")).alias("content"), F.sha2("content", 256).alias("hash"))

    def one(batch: DataFrame, number: int) -> None:
        with stage.passing(spark):
            sink(analyse(batch, config), number)

    writer = files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def follow(changes: DataFrame, store_path: str, checkpoint: str, config: Config = Config(), sink: Callable[[Scan, int], None] | None = None, available_now: bool = False) -> StreamingQuery:
    """Keep a store up with a stream of changes (path, content, at, deleted); ``sink`` gets the whole state after each batch.

    Of several changes of a path in a batch the one of the largest ``at`` counts; over batches, their order does."""
    spark = changes.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        with stage.passing(spark):
            last = batch.groupBy("path").agg(F.max_by(F.struct("content", "deleted"), "at").alias("c")).select("path", "c.*")
            last = stage.written(last.withColumn("hash", F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit(b"")), 256)), "changes")
            store = open_store(spark, store_path).open()
            files = last.where("NOT coalesce(deleted, false)").select("path", "content", "hash")
            scan, problem = analyse_with_store(files, config, store, (config.output.enum_name,), removed=last.where("deleted").select("path"))
            if problem:  # the batch fails and is run again: nothing is lost
                raise RuntimeError(problem)
            if sink is not None:
                sink(scan, number)

    writer = changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
