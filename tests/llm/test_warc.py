"""WARC archives as chunk tables: exact round trips, revisits, bounded memory, damage."""

import glob
import gzip
import hashlib
import io
import random
import tracemalloc
import zlib

import pytest
from pyspark.sql import functions as F

from loquat.llm import warc

SCHEMA = "page_id long, url string, html string"


def brute(rows, least):
    """[(id, bytes, sha1, type, refers to)]"""
    low = lambda i: (i is not None, i or 0)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", (False, 0)), low(i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= least and low(i) < top[h or ""]
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top[h or ""][1] if again else None))
    return sorted(out, key=repr)


def odd_rows():
    rng = random.Random(5)
    texts = ["x" * 999, "x" * 1000, "é" * 500, "é" * 499, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40, "\r\n\r\n", "\n", "", None, "words " * 50_000]
    rows = [(k, rng.choice([None, "", "http://x.example/a b\r\nEvil: 1", "http://é.example/?q=%41&<>", f"http://x.example/{k}"]), rng.choice(texts)) for k in range(120)]
    rows += [(119, "u", "x" * 1000), (119, "u", "x" * 1000), (None, None, "x" * 1000), (None, "a", None), (500, "u", "y" * 3000), (500, "u", "y" * 3000), (None, "u", "z" * 2000), (None, "u", "z" * 2000)]
    return rows


def test_round_trip_of_odd_rows(spark, tmp_path):
    rows = odd_rows()
    path = f"file://{tmp_path}/w"
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(9) for c in ("id", "uri", "payload", "sha1", "bytes", "chunk_no", "r_id", "refers_to", "chunk", "html_")})
    manifest = warc.write_archives(df, path, chunk_bytes=700, file_bytes=5_000)
    kinds = ("id", "payload_bytes", "sha1", "record_type", "refers_to")
    chunks = warc.read_chunks(spark, path, chunk_bytes=900).cache()
    got = [(r.id and int(r.id), r.payload_bytes, r.sha1, r.record_type, r.refers_to and int(r.refers_to)) for r in warc.records(chunks).select(*kinds).collect()]
    assert sorted(got, key=repr) == brute(rows, 1000)
    files = manifest.collect()
    assert len(files) > 3 and sum(f["records"] for f in files) == len(rows)
    assert all(f["bytes"] == len(open(f"{tmp_path}/w/{f['file']}", "rb").read()) for f in files)
    # Payloads put together from chunks, and the state that each chunk carries.
    whole = {}
    for r in sorted(chunks.where("record_type = 'response'").collect(), key=lambda r: (r.file, r.offset, r.chunk_no)):
        assert len(r.chunk) <= 900 and (r.chunk_no == 0) == ((r.file, r.offset) not in whole)
        whole[r.file, r.offset] = whole.get((r.file, r.offset), b"") + r.chunk
        assert (r.payload_bytes, r.sha1) == (len(whole[r.file, r.offset]), hashlib.sha1(whole[r.file, r.offset]).hexdigest())
    said = {(i, h or "") for i, _, h in rows}
    assert {(r.id and int(r.id), whole[r.file, r.offset].decode()) for r in chunks.where("record_type = 'response' AND last").collect()} <= said
    uris = {(r.id and int(r.id), r.uri) for r in chunks.where("record_type <> 'warcinfo'").collect()}
    assert uris == {(i, u and u.replace(" ", "%20").replace("\r\n", "%0D%0A")) for i, u, _ in rows}
    # Without payloads all else is the same; other members can be found at their offsets.
    bare = warc.read_chunks(spark, path, chunk_bytes=900, payload=False)
    assert sorted(map(repr, bare.drop("chunk").collect())) == sorted(map(repr, chunks.drop("chunk").collect()))
    one = chunks.where("record_type = 'revisit'").first()
    with open(f"{tmp_path}/w/{one.file}", "rb") as f:
        f.seek(one.offset)
        assert next(warc.chunks_of(f))["record_id"] == one.record_id


def test_empty_table_and_files_of_failed_attempts(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.records(warc.read_chunks(spark, path)).collect() == []
    path = f"file://{tmp_path}/v"
    warc.write_archives(spark.createDataFrame([(1, "u", "a")], SCHEMA), path)
    with gzip.open(f"{tmp_path}/v/part-000000-lost-0000.warc.gz", "wb") as f:
        f.write(b"an attempt that did not count")
    assert warc.records(warc.read_chunks(spark, path)).count() == 1


def test_damage_is_told(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame([(1, "u", "a" * 5000), (2, "u", "b" * 5000)], SCHEMA).coalesce(1), path)
    (name,) = glob.glob(f"{tmp_path}/w/*.warc.gz")
    raw = open(name, "rb").read()
    plain = gzip.decompress(raw)
    want = [(r["id"], r["payload_bytes"], r["sha1"]) for r in warc.chunks_of(io.BytesIO(raw))]
    assert [(r["id"], r["payload_bytes"], r["sha1"]) for r in warc.chunks_of(io.BytesIO(plain))] == want  # plain archives are read too
    for bad in (raw[:-30], plain[:-30], plain.replace(b"aaaa", b"aaba", 1), b"HTTP/1.1 200\r\n\r\n", raw[:200] + b"\0" * 40 + raw[240:]):
        with pytest.raises(warc.CorruptArchive):
            list(warc.chunks_of(io.BytesIO(bad)))
    open(name, "wb").write(raw[:-30])
    with pytest.raises(Exception, match="ends early"):
        warc.read_chunks(spark, path).collect()


class Endless(io.RawIOBase):
    """A record of many megabytes as a file that is never in memory whole."""

    def __init__(self, megabytes, packed):
        self.parts = self._packed(megabytes) if packed else self._plain(megabytes)
        self.held = b""

    def _plain(self, megabytes):
        yield b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:7>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" % (19 + (megabytes << 20))
        for _ in range(megabytes):
            yield b"0123456789abcdef" * (1 << 16)
        yield b"\r\n\r\n"

    def _packed(self, megabytes):
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        for part in self._plain(megabytes):
            yield z.compress(part)
        yield z.flush()

    def read(self, n):
        while not self.held and (part := next(self.parts, None)) is not None:
            self.held = part
        out, self.held = self.held[:n], self.held[n:]
        return out


@pytest.mark.parametrize("packed", [False, True])
def test_memory_does_not_grow_with_the_record(packed):
    tracemalloc.start()
    n = 0
    for row in warc.chunks_of(Endless(200, packed), chunk_bytes=1 << 20):
        n, last = n + 1, row
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200 and last["last"] and last["payload_bytes"] == 200 << 20 and peak < 8 << 20
    want = hashlib.sha1()
    for _ in range(200):
        want.update(b"0123456789abcdef" * (1 << 16))
    assert last["sha1"] == want.hexdigest()
