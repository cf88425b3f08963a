"""Length-delimited binary records of token ids, with a separate offset index.

A record is framed as: length (8 bytes), masked CRC-32 of those 8 bytes (4), data, masked CRC-32 of
the data (4), all little-endian. Data is: document id (8 bytes, signed), flags (1: bit 0 the id is
null, bit 1 ids are 32-bit), ids. Ids take 16 bits if the vocabulary allows. The mask is the usual
rotation by 15 plus 0xA282EAD8, so that a checksum stored in checksummed data stays harmless.

``shard.idx`` holds, for record k, its byte offset and the ids before it in the shard (two 8-byte
integers), after a count: any record is read alone, in any order. A manifest table names the shards
that count, so files of lost or repeated task attempts are never read.

Defined cases: ids are integers (others are an error); null or empty text is the end id alone; null document ids come first; equal ids are
ordered by text; an empty table gives no shards and an empty result; other columns are not stored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquat.llm import storage
from loquat.llm.text import lean
from loquat.llm.tokens import encoded, shared_encoder

MANIFEST = "shard int, file string, records long, tokens long, bytes long"
RECORDS = "doc_id long, start long, n_tokens long, ids binary"


class CorruptRecord(ValueError):
    """A length or checksum does not hold."""


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return head + struct.pack("<I", masked_crc(head)) + data + struct.pack("<I", masked_crc(data))


def read_frame(stream) -> bytes | None:
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
        raise CorruptRecord("length")
    size = struct.unpack("<Q", head[:8])[0]
    data = stream.read(size)
    tail = stream.read(4)
    if len(data) < size or len(tail) < 4 or struct.unpack("<I", tail)[0] != masked_crc(data):
        raise CorruptRecord("data")
    return data


def serialize(doc_id: int | None, ids: bytes, narrow: bool) -> bytes:
    """``ids``: little-endian 32-bit."""
    body = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if narrow else ids
    return struct.pack("<qB", doc_id or 0, (doc_id is None) + 2 * (not narrow)) + body


def deserialize(data: bytes) -> tuple[int | None, bytes]:
    doc_id, flags = struct.unpack("<qB", data[:9])
    ids = data[9:] if flags & 2 else np.frombuffer(data[9:], "<u2").astype("<u4").tobytes()
    return None if flags & 1 else doc_id, ids


def write_records(df: DataFrame, path: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 1, specials: bool = False) -> DataFrame:
    """Encode every text and write records in ascending id order below ``path``; returns the manifest.

    ``specials``: strings of special tokens become their ids (see ``tokens.Encoder``)."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lean(_shard_writer(path, tokenizer, end_id, specials)), MANIFEST).write.parquet(f"{path}/manifest")
    return df.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records: id, ids before its start in the whole file set, and its ids (32-bit little-endian).

    The manifest has a row a shard; only those few numbers pass the driver, to place shard starts."""
    shards = sorted(spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect(), key=lambda x: x["shard"])
    starts = np.cumsum([0, *(x["tokens"] for x in shards)]).tolist()
    if not shards:
        return spark.createDataFrame([], RECORDS)
    listed = spark.createDataFrame([(x["file"], s) for x, s in zip(shards, starts, strict=False)], "file string, start long")
    return listed.repartition(len(shards)).mapInArrow(lean(_read_shards(path)), RECORDS)


def read_at(path: str, file: str, k: int) -> tuple[int | None, int, bytes]:
    """(id, ids before it in the shard, ids) of record ``k`` of a shard, by its index alone."""
    fs, root = storage.filesystem(path)
    with fs.open_input_file(f"{root}/{file}.idx") as index:
        n = struct.unpack("<Q", index.read(8))[0]
        if not 0 <= k < n:
            raise IndexError(k)
        index.seek(8 + 16 * k)
        offset, start = struct.unpack("<QQ", index.read(16))
    with fs.open_input_file(f"{root}/{file}.rec") as records:
        records.seek(offset)
        doc_id, ids = deserialize(read_frame(records))
    return doc_id, start, ids


def _shard_writer(path: str, tokenizer: str, end_id: int, specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        file = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        encoder, out, index, size, tokens = None, None, [], 0, 0
        for batch in batches:
            if batch.num_rows and out is None:
                encoder = shared_encoder(tokenizer, end_id, specials)
                narrow = max(encoder.vocabulary(), end_id + 1) <= 1 << 16
                fs, root = storage.filesystem(path)
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{file}.rec")
            ids_of = batch.column("doc_id")
            for k, ids in encoded(batch, "text", encoder) if batch.num_rows else ():
                record = frame(serialize(ids_of[k].as_py(), ids, narrow))
                out.write(record)
                index.append((size, tokens))
                size, tokens = size + len(record), tokens + len(ids) // 4
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{file}.idx") as at:
                at.write(struct.pack("<Q", len(index)) + np.array(index, "<u8").tobytes())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [file], "records": pa.array([len(index)], pa.int64()), "tokens": pa.array([tokens], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return run


def _read_shards(path: str, step: int = 500):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = storage.filesystem(path)
        for batch in batches:
            for shard in batch.to_pylist():
                start, rows = shard["start"], []
                with fs.open_input_stream(f"{root}/{shard['file']}.rec", buffer_size=1 << 20) as stream:
                    while (data := read_frame(stream)) is not None:
                        doc_id, ids = deserialize(data)
                        rows.append((doc_id, start, len(ids) // 4, ids))
                        start += len(ids) // 4
                        if len(rows) >= step:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, starts, lengths, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
