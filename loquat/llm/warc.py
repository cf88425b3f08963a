"""WARC archives written and read as tables of chunks: no record is ever whole in a task's memory.

A payload travels as rows (record, chunk number, bytes). The writer compresses chunks as they come, a gzip
member a record, and rolls to a new file at ``file_bytes``; the reader decompresses a file in small steps and
gives rows of at most ``chunk_bytes``, each with the SHA-1 and the length of the payload as far as it has
come. The digest of a record is that of its last chunk, so nothing has to be put together to know it; it
is held against the one the record states.

Of records with equal payloads of at least ``least`` bytes, the one with the largest id is written whole
(``response``); the others are written as ``revisit``: they refer to it, keep their HTTP head, which states the
payload's length, and have no payload. Equal payloads are found by SHA-1, a second hash and length, on narrow
rows: a group sends one row a task, and its one answer is joined back to the ids, where adaptive execution
splits a hot group. Payloads are shuffled once, by id, and not sorted.

Each attempt of a task writes files of its own name; the manifest, a Parquet table, names those of the
attempts that counted, and only these are read.

Defined cases: a null payload is empty; ids may be null (they are less than all others) or repeated (rows with
an id that is the largest of their payload are all responses, and have equal record ids); a null URI is left
out, white space and control characters in one are percent-encoded; an empty table gives no archive and an empty table; further columns of the caller are not stored. A record
that ends early, or whose payload is not the one its digest states, is an error that names file and place.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquat.llm import storage
from loquat.llm.text import lean

LEAST_BYTES = 1000
CHUNK_BYTES = 1 << 20
FILE_BYTES = 1 << 28
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "file string, records long, bytes long"
#: A row a chunk. ``sha1`` and ``payload_bytes``: of the payload up to and with this chunk, for a revisit
#: what it states of the whole; ``offset``: where the record begins in its file.
CHUNKS = """file string, offset long, record_type string, record_id string, id string, uri string, refers_to string,
chunk_no long, chunk binary, payload_bytes long, sha1 string, last boolean"""
#: What cannot stand in a header line, nor in a URI.
_UNFIT = re.compile(r"[\x00-\x20\x7F-\x9F]")
_NULL = "<urn:record-without-id>"
_READ = 1 << 16


class CorruptArchive(ValueError):
    pass


def record_id(value: str | None) -> str:
    return _NULL if value is None else f"<urn:record:{quote(value, safe='')}>"


def id_of(record: str | None) -> str | None:
    return unquote(record[12:-1]) if record and record.startswith("<urn:record:") else None


def base32(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


# --- writing ---------------------------------------------------------------------------------------------


def revisits(digests: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(id, sha1, second, bytes, refers_to) of records whose payload a record with a larger id has too."""
    key = ["sha1", "second", "bytes"]
    long = digests.where(F.col("bytes") >= least)
    top = long.groupBy(*key).agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return long.join(top, key).where("refers_to > id OR (id IS NULL AND refers_to IS NOT NULL)").distinct()


def to_chunks(df: DataFrame, payload: str = "html", id: str = "page_id", uri: str = "url", least: int = LEAST_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A table of records as a table of chunks, revisits told: the writer's input. Chunks of a record follow one another."""
    binary = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id).alias("id"), F.col(uri).alias("uri"), binary.alias("payload"))
    known = {"sha1": F.sha1("payload"), "second": F.xxhash64("payload"), "bytes": F.octet_length("payload").cast("long")}
    rows = rows.withColumns(known)
    found = revisits(storage.materialise(rows.select("id", *known), "digests"), least)
    found = found.select(*(F.col(c).alias(f"r_{c}") for c in found.columns)).hint("shuffle_hash")
    same = F.col("id").eqNullSafe(F.col("r_id"))
    for c in known:
        same &= F.col(c) == F.col(f"r_{c}")
    told = rows.join(found, same, "left")
    whole = F.when(F.col("r_sha1").isNull(), F.col("bytes")).otherwise(0)
    told = told.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(whole / chunk_bytes).cast("int") - 1))))
    chunk = F.when(F.col("r_sha1").isNull(), F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    kind = F.when(F.col("r_sha1").isNull(), "response").otherwise("revisit")
    return told.select(F.col("id").cast("string").alias("id"), "uri", kind.alias("record_type"), F.col("r_refers_to").cast("string").alias("refers_to"), "sha1", "bytes", "chunk_no", chunk.alias("chunk"))


def write_chunks(chunks: DataFrame, path: str, date: str = DATE, file_bytes: int = FILE_BYTES, level: int = 4) -> DataFrame:
    """Write a table of chunks, as ``to_chunks`` makes it, as archives below ``path``; returns the manifest.

    Chunks of a record are consecutive and in order in their partition. ``sha1`` and ``bytes`` are those of the whole payload."""
    run = _writer(path, date, file_bytes, level)
    chunks.mapInArrow(lean(run), MANIFEST).write.parquet(f"{path}/manifest")
    return chunks.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


def write_archives(df: DataFrame, path: str, payload: str = "html", id: str = "page_id", uri: str = "url", least: int = LEAST_BYTES, chunk_bytes: int = CHUNK_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """A WARC record of every row of ``df``; returns the manifest (a row a file)."""
    return write_chunks(to_chunks(df, payload, id, uri, least, chunk_bytes), path, file_bytes=file_bytes)


class _Archive:
    """One file being written, a gzip member a record."""

    def __init__(self, fs, root: str, name: str, date: str, level: int):
        self.name, self.date, self.level = name, date, level
        self.out = fs.open_output_stream(f"{root}/{name}", compression=None)
        self.records = self.bytes = 0
        self.begin([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], 0)
        self.end()
        self.records = 0

    def write(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.bytes += len(data)

    def begin(self, fields: list[tuple[str, str]], length: int) -> None:
        self.member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in [*fields, ("WARC-Date", self.date), ("Content-Length", str(length))]), "", ""]
        self.add("\r\n".join(lines).encode())
        self.records += 1

    def add(self, data: bytes) -> None:
        self.write(self.member.compress(data))

    def end(self) -> None:
        self.add(b"\r\n\r\n")
        self.write(self.member.flush())

    def row(self) -> pa.RecordBatch:
        self.out.close()
        return pa.RecordBatch.from_arrays([pa.array([self.name]), pa.array([self.records]), pa.array([self.bytes])], names=["file", "records", "bytes"])


def _head(row: dict) -> tuple[list[tuple[str, str]], bytes, int]:
    """(WARC fields, HTTP head, bytes of payload to come) of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_id(row["id"]))]
    if row["uri"] is not None:
        fields.append(("WARC-Target-URI", _UNFIT.sub(lambda x: f"%{ord(x[0]):02X}", row["uri"])))
    fields.append(("WARC-Payload-Digest", f"sha1:{base32(row['sha1'])}"))
    if row["record_type"] == "revisit":
        fields += [("WARC-Refers-To", record_id(row["refers_to"])), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return [*fields, ("Content-Type", "application/http;msgtype=response")], http, row["bytes"] if row["record_type"] == "response" else 0


def _writer(path: str, date: str, file_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, due, told, sha = None, 0, "", None
        attempt, files = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0

        def finish() -> None:
            if due or sha is not None and sha.hexdigest() != told:
                raise CorruptArchive(f"chunks of a record in {archive.name} are not the payload of its digest")
            archive.end()

        for batch in batches:
            heads = batch.select(["id", "uri", "record_type", "refers_to", "sha1", "bytes", "chunk_no"]).to_pylist()
            for k, row in enumerate(heads):
                chunk = batch.column("chunk")[k].as_buffer()
                if row["chunk_no"] == 0:
                    if archive is not None:
                        finish()
                        if archive.bytes >= file_bytes:
                            yield archive.row()
                            archive = None
                    if archive is None:
                        fs, root = storage.filesystem(path)
                        fs.create_dir(root, recursive=True)
                        archive, files = _Archive(fs, root, f"{attempt}-{files:04d}.warc.gz", date, level), files + 1
                    fields, http, due = _head(row)
                    archive.begin(fields, len(http) + due)
                    archive.add(http)
                    told, sha = row["sha1"], hashlib.sha1() if row["record_type"] == "response" else None
                if chunk is not None and len(chunk):
                    archive.add(chunk)
                    sha.update(chunk)
                    due -= len(chunk)
        if archive is not None:
            finish()
            yield archive.row()

    return run


# --- reading ---------------------------------------------------------------------------------------------


class _Members:
    """Bytes of a file of gzip members (or of plain records), a few at a time; ``member``: where the last member begun lies."""

    def __init__(self, raw):
        self.raw, self.held, self.place = raw, b"", 0
        self.data, self.member, self.z = bytearray(), 0, None
        first = raw.read(2)
        self.held, self.plain = first, first != b"\x1f\x8b"

    def more(self) -> bool:
        """Put at least one byte more into ``data``, or tell that the file is over."""
        while True:
            if not self.held:
                self.held = self.raw.read(_READ)
                if not self.held:
                    if self.z is not None:
                        raise CorruptArchive("a member ends early")
                    return False
            if self.plain:
                self.place += len(self.held)
                self.data += self.held
                self.held = b""
                return True
            if self.z is None:
                self.z, self.member = zlib.decompressobj(31), self.place
            try:
                out = self.z.decompress(self.held, _READ)
            except zlib.error as error:
                raise CorruptArchive(str(error)) from error
            rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.place += len(self.held) - len(rest)
            self.held = rest
            if self.z.eof:
                self.z = None
            if out:
                self.data += out
                return True

    def line(self) -> bytes | None:
        """A line without its end; none at the end of the file."""
        seen = 0
        while (at := self.data.find(b"\n", seen)) < 0:
            seen = len(self.data)
            if not self.more():
                if self.data:
                    raise CorruptArchive("a line ends early")
                return None
        out = bytes(self.data[:at]).rstrip(b"\r")
        del self.data[: at + 1]
        return out

    def take(self, most: int) -> bytes:
        """At least one byte, and at most ``most``."""
        if not self.data and not self.more():
            raise CorruptArchive("a record ends early")
        out = bytes(self.data[:most])
        del self.data[:most]
        return out

    def fields(self) -> tuple[bytes, dict[str, str], int] | None:
        """(first line, fields by name in lower case, bytes taken) of a head up to its empty line."""
        first = self.line()
        if first is None:
            return None
        out, size = {}, len(first) + 2
        while line := self.line():
            name, _, value = line.partition(b":")
            out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
            size += len(line) + 2
        return first, out, size + 2


def chunks_of(raw, chunk_bytes: int = CHUNK_BYTES, payload: bool = True) -> Iterator[dict]:
    """The chunks of an open archive in order, without their file's name."""
    source = _Members(raw)
    while True:
        while not source.data and source.more():
            pass
        offset = source.member
        if (head := source.fields()) is None:
            return
        if not head[0]:
            continue  # the empty lines behind a record
        if not head[0].startswith(b"WARC/"):
            raise CorruptArchive(f"no record at {offset}")
        fields = head[1]
        left, stated = int(fields["content-length"]), fields.get("warc-payload-digest", "").removeprefix("sha1:")
        told = base64.b32decode(stated).hex() if stated else None
        kind, size = fields.get("warc-type", ""), 0
        if fields.get("content-type", "").startswith("application/http"):
            http = source.fields()
            if http is None:
                raise CorruptArchive(f"no HTTP head at {offset}")
            left, size = left - http[2], int(http[1].get("content-length", 0))
        about = {"offset": offset, "record_type": kind, "record_id": fields.get("warc-record-id"), "id": id_of(fields.get("warc-record-id")), "uri": fields.get("warc-target-uri"), "refers_to": id_of(fields.get("warc-refers-to"))}
        if kind == "revisit":
            yield about | {"chunk_no": 0, "chunk": b"", "payload_bytes": size, "sha1": told, "last": True}
            while left > 0:
                left -= len(source.take(left))
            continue
        sha, seen, number = hashlib.sha1(), 0, 0
        while True:
            parts, n = [], 0
            while left > 0 and n < chunk_bytes:
                part = source.take(min(left, chunk_bytes - n))
                sha.update(part)
                n, left = n + len(part), left - len(part)
                if payload:
                    parts.append(part)
            seen += n
            digest = sha.copy().hexdigest()
            if left <= 0 and told and digest != told:
                raise CorruptArchive(f"the payload at {offset} is not that of its digest")
            yield about | {"chunk_no": number, "chunk": b"".join(parts) if payload else None, "payload_bytes": seen, "sha1": digest, "last": left <= 0}
            number += 1
            if left <= 0:
                break


def _reader(path: str, chunk_bytes: int, payload: bool):
    names = [x.split()[0] for x in CHUNKS.split(",")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in CHUNKS.split(",")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = storage.filesystem(path)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                held, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", buffer_size=1 << 20, compression=None) as raw:
                    try:
                        for row in chunks_of(raw, chunk_bytes, payload):
                            held.append(row | {"file": name})
                            size += len(row["chunk"] or b"") + 300
                            if size >= 4 << 20:
                                yield pa.RecordBatch.from_pylist(held, schema=schema)
                                held, size = [], 0
                    except CorruptArchive as error:
                        raise CorruptArchive(f"{name}: {error}") from error
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema).select(names)

    return run


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, payload: bool = True) -> DataFrame:
    """The archives of a manifest as a table of chunks (``CHUNKS``), warcinfo records included.

    A task reads whole files, as many at a time as they come; without ``payload`` chunks have no bytes, all else is the same."""
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("file")
    return files.repartition(max(1, min(files.count(), 100_000))).mapInArrow(lean(_reader(path, chunk_bytes, payload)), CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """A row a record: its last chunk knows its digest and length."""
    kept = ("file", "offset", "record_type", "record_id", "id", "uri", "refers_to", "payload_bytes", "sha1")
    return chunks.where("last AND record_type IN ('response', 'revisit')").select(*kept)
