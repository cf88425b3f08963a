"""Block exchange: per-key questions over a corpus, asked and answered in packed arrays.

Many corpus operators ask, for every key occurrence of every document (a window, an n-gram),
something about all occurrences of that key. Shuffling a row per occurrence costs far more than the
text itself. Here documents are grouped once into *blocks* of bounded bytes, written as a bucketed
table in the shared folder. A pass over the blocks emits, per key range (*shard*), one row of
sorted, delta-coded keys; a shard's task answers each block in its own key order, often with a bit a
key; answers return to the block by a join that leaves the blocks where they are.

A hot key costs one entry a block, never one an occurrence. No task gathers more than a shard.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquat.llm import storage
from loquat.llm.text import give_back, lean

BLOCK_BYTES = 6 << 20
SHARD_KEYS = 1_500_000
ASK = "block long, shard int, payload binary"


def pack(a: np.ndarray) -> bytes:
    """Integers or floats: byte planes, then zstd. ``unpack`` needs no more than the bytes."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") + zstandard.compress(planes, 1)


def unpack(raw: bytes) -> np.ndarray:
    dtype, n = np.dtype(raw[:4].decode().strip()), int.from_bytes(raw[4:12], "little")
    if not n:
        return np.empty(0, dtype)
    planes = np.frombuffer(zstandard.decompress(raw[12:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def narrow(a: np.ndarray) -> np.ndarray:
    """Numbers from zero up, in as few bytes each as all need."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def pack_steps(a: np.ndarray) -> bytes:
    """Numbers from zero up, in order; for ``unpack_steps``."""
    return pack(narrow(np.diff(a, prepend=a.dtype.type(0))))


def unpack_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.int64)


def pack_repeated(a: np.ndarray) -> bytes:
    """Numbers of which many are equal: each value once, if that is shorter; for ``unpack_repeated``."""
    values, code = np.unique(a, return_inverse=True)
    return join_parts(pack(values), pack(narrow(code))) if 2 * len(values) < len(a) else join_parts(pack(a))


def unpack_repeated(raw: bytes) -> np.ndarray:
    values, *code = map(unpack, split_parts(raw))
    return values[code[0]] if code else values


def join_parts(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def split_parts(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def shard_bounds(shards: int) -> np.ndarray:
    """First key of every shard but the first: equal ranges of the 64-bit key space."""
    return np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)


def slices(sorted_keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """(shard, slice) of each shard that has keys."""
    cuts = [0, *np.searchsorted(sorted_keys, shard_bounds(shards)).tolist(), len(sorted_keys)]
    for s in range(shards):
        if cuts[s + 1] > cuts[s]:
            yield s, slice(cuts[s], cuts[s + 1])


class Blocks:
    """A corpus staged as blocks. ``rows``: block id and packed rows; ``bytes``: text bytes in all, ``total`` where given.

    ``prepare`` makes of batches of ``df`` those that are staged, in the same worker."""

    def __init__(self, spark: SparkSession, df: DataFrame, text: str, block_bytes: int = BLOCK_BYTES, total: int | None = None, prepare: Callable | None = None):
        self.spark, self.schema, self.text = spark, df.schema, text
        self.bytes = int(df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0) if total is None else total
        shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = max(shuffles, min(100_000, math.ceil(self.bytes / (2 * block_bytes))))
        to_blocks = _to_blocks(text, block_bytes)
        run = to_blocks if prepare is None else lambda batches: to_blocks(prepare(batches))
        staged = df.mapInArrow(lean(run), "block long, n_rows long, payload binary")
        self.rows = self._bucketed(staged, "blocks")

    def _bucketed(self, df: DataFrame, label: str) -> DataFrame:
        path, name = storage.new_path(self.spark, label), f"loquat_{label}_{uuid.uuid4().hex}"
        with storage.setting(self.spark, "spark.sql.parquet.compression.codec", "uncompressed"), storage.setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.option("path", path).bucketBy(self.buckets, "block").sortBy("block").saveAsTable(name)
        storage.name_table(path, name)
        return self.spark.table(name)

    def keep(self, answers: DataFrame) -> DataFrame:
        """Answers that are read more than once, as a table beside the blocks: dealt to them once, and no shuffle holds them again."""
        return self._bucketed(self._by_block(answers), "answers")

    def shards(self, bytes_per_key: float = 6.0, keys: int = SHARD_KEYS) -> int:
        """Shards for one key a word."""
        return max(1, math.ceil(self.bytes / bytes_per_key / keys))

    def ask(self, ask: Callable[[pa.RecordBatch], Iterator[tuple[int, bytes]]], answers: DataFrame | list[DataFrame] | None = None) -> DataFrame:
        """Questions of every block: ``ask(rows[, answers])`` yields (shard, payload). ``answers``: rows, or a list of kept ones."""
        return self._over(answers).mapInArrow(lean(_asking(ask, answers is not None)), ASK)

    def answer(self, asks: DataFrame, answer: Callable[[int, list[bytes]], list[bytes]]) -> DataFrame:
        """``answer(shard, payloads)`` gives a payload for each, in order; one row a block and shard."""

        def per_shard(table: pa.Table) -> pa.Table:
            shard = table["shard"][0].as_py()
            out = answer(shard, table["payload"].to_pylist())
            give_back()
            return pa.table({"block": table["block"], "shard": table["shard"], "payload": pa.array(out, pa.binary())})

        return asks.groupBy("shard").applyInArrow(per_shard, ASK)

    def map(self, answers: DataFrame | list[DataFrame], use: Callable[[pa.RecordBatch, dict[int, bytes]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
        """``use(rows, answers by shard)`` for every block."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _each(batches):
                yield from use(from_payload(block["payload"]), _answers(block))

        return self._over(answers).mapInArrow(lean(run), schema)

    def _over(self, answers: DataFrame | list[DataFrame] | None) -> DataFrame:
        if answers is None:
            return self.rows
        kept = answers if isinstance(answers, list) else [self._by_block(answers)]
        out = self.rows
        for i, one in enumerate(kept):
            out = out.join(one.withColumnRenamed("answers", f"answers{i}"), "block", "left")
        return out

    def _by_block(self, answers: DataFrame) -> DataFrame:
        return answers.repartition(self.buckets, "block").groupBy("block").agg(F.collect_list(F.struct("shard", "payload")).alias("answers"))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _answers(block: dict) -> dict[int, bytes]:
    return {x["shard"]: x["payload"] for name, given in block.items() if name.startswith("answers") for x in given or ()}


def _asking(ask, with_answers: bool):
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _each(batches):
            rows = from_payload(block["payload"])
            asked = ask(rows, _answers(block)) if with_answers else ask(rows)
            for shard, payload in asked:
                yield pa.RecordBatch.from_arrays([pa.array([block["block"]], pa.int64()), pa.array([shard], pa.int32()), pa.array([payload], pa.binary())], schema=schema)

    return run


def _to_payload(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue()


def from_payload(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def _to_blocks(text: str, block_bytes: int):
    """Consecutive rows to blocks of at least ``block_bytes`` of text (the last of a task may be less)."""
    schema = pa.schema([("block", pa.int64()), ("n_rows", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), pa.array([table.num_rows], pa.int64()), pa.array([_to_payload(table)], pa.binary())], schema=schema)

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            start = 0
            while start < batch.num_rows:
                reach = np.cumsum(lengths[start:].astype(np.int64))
                stop = start + min(int(np.searchsorted(reach, block_bytes - size)) + 1, batch.num_rows - start)
                held.append(batch.slice(start, stop - start))
                size += int(reach[stop - start - 1])
                start = stop
                if size >= block_bytes:
                    yield out()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield out()

    return run
