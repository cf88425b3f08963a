"""Vector code compression: product quantisation in integers, screened in float32 and settled in int64.

A component x becomes the integer floor(scale * x); a vector is cut into equal consecutive parts, and each
part position has a codebook of integer entries. A part's code is the index of its nearest entry (squared
Euclidean distance, ties to the lower index), exactly, and yet found by a float32 matrix product:

* entries are ranked by h_j - x . c_j with h_j = |c_j|^2 / 2, which orders them as the distances do;
* in float32 that is off by at most e = (d + 8) u (|x| max|c| + max h), u = 2^-24: a product of d terms in
  any order errs by less than (d + 2) u |x| |c| when its factors are rounded too, the rest is rounding of h
  and of the difference. So [s - e, s + e] holds the true value of an entry whose product gave s;
* every entry whose interval overlaps the lowest one's is measured again in int64, and the lowest index
  among the least distances wins. What the product cannot settle is thus settled exactly, and little else is.

Codebooks start as the parts of the vectors with the least ids. Each round is one pass over the vectors:
a task adds up components by part and entry, Spark sums these few rows a task by key, and the driver
gets one number a component of the codebooks, whose size is fixed by the parameters. Codebooks travel in
the tasks' closure. Nothing else leaves the executors, and no row is shuffled.

Defined cases: a vector that is null or empty, that holds a null or non-finite component, or whose length is not
that of the first vector (least id) is dropped; null ids come after all others when codebooks are
begun, equal ids are ordered by their vectors; repeated rows each count; with fewer vectors than entries a codebook has as many
entries as there are vectors; other columns pass through (see ``columns`` for names that clash); an
empty table gives an empty table and empty codebooks. A length that the number of parts does not divide,
and integers of 2^24 or more (components of 16,384 at a scale of 1024), for which int64 would not be exact
at every length, are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loquat.llm import storage
from loquat.llm.columns import Carried
from loquat.llm.text import lean

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LIMIT = 1 << 24
#: Parts that are compared with a codebook at a time.
STEP = 4096
_SUMS = "part int, entry int, place int, total long, n long"


@dataclass
class Codebooks:
    """``entries``: (parts, entries, components of a part) of int64; ``scale``: integers a unit."""

    entries: np.ndarray
    scale: int = SCALE
    #: Entries that were measured exactly, and parts, of the last use in this process (for tests and figures).
    measured: list = field(default_factory=lambda: [0, 0], compare=False)

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        """SHA-256 of all components, decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of every part of integer vectors, a row a vector."""
        parts, _, width = self.entries.shape
        index, error = np.empty((len(vectors), parts), np.int64), np.empty((len(vectors), parts), np.int64)
        for p in range(parts):
            book = _Book(self.entries[p])
            for i in range(0, len(vectors), STEP):
                x = vectors[i : i + STEP, p * width : (p + 1) * width]
                index[i : i + STEP, p], error[i : i + STEP, p], n = book.nearest(x)
                self.measured[0] += n
                self.measured[1] += len(x)
        return index, error

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Approximate components of codes, a row a vector."""
        picked = [self.entries[p][codes[:, p]] for p in range(len(self.entries))]
        return np.concatenate(picked, 1) / self.scale


class _Book:
    """One codebook, ready for screening."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        squares = (entries * entries).sum(1).astype(np.float64)
        self.turned = np.ascontiguousarray(entries.T.astype(np.float32))
        self.half = (squares / 2).astype(np.float32)
        self.longest, self.most = np.sqrt(squares.max()), squares.max() / 2

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        screen = x.astype(np.float32) @ self.turned
        np.subtract(self.half, screen, out=screen)
        # The bound, with room for its own rounding in float64 and for that of the limit to float32.
        norm = np.sqrt((x * x).sum(1).astype(np.float64))
        width = (entry_width(x.shape[1])) * (norm * self.longest + self.most)
        least = screen.min(1)
        limit = np.nextafter((least + 2 * width).astype(np.float32), np.float32(np.inf))
        row, entry = np.nonzero(screen <= limit[:, None])
        gap = x[row] - self.entries[entry]
        exact = (gap * gap).sum(1)
        first = np.searchsorted(row, np.arange(len(x)))
        best = np.minimum.reduceat(exact, first) if len(x) else exact
        # Of a row's entries at the least distance the first is the lowest.
        hit = np.flatnonzero(exact == best[row])
        keep = hit[np.searchsorted(row[hit], np.arange(len(x)))]
        return entry[keep], best, len(row)


def entry_width(d: int) -> float:
    """Half the width of an entry's interval, as a share of |x| max|c| + max h."""
    return (d + 8) * 2.0**-24 * (1 + 1e-3)


def _integers(column: pa.Array, scale: int, length: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a list column that are kept, their integers); without ``length`` the integers of the first kept row's length."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    if not sizes.any():
        return np.empty(0, np.int64), np.empty((0, length or 0), np.int64)
    flat = column.flatten()
    values = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False)  # a null component becomes NaN
    bad = np.flatnonzero(~np.isfinite(values))
    ends = np.cumsum(sizes)
    whole = sizes > 0
    whole[np.searchsorted(ends, bad, side="right")] = False
    if length is None:
        length = int(sizes[np.flatnonzero(whole)[0]]) if whole.any() else 0
    kept = np.flatnonzero(whole & (sizes == length))
    picked = values[(ends - sizes)[kept][:, None] + np.arange(length)]
    out = np.floor(picked * scale)
    if out.size and np.abs(out).max() >= LIMIT:
        raise OverflowError(f"a component times {scale} is {LIMIT} or more in size")
    return kept, out.astype(np.int64)


def _quantised(vector: str, scale: int, length: int | None):
    """Rows (id, integers) of the vectors that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(vector)
            if length is None:  # any length: a row at a time is enough, there are few
                rows = [(k, _integers(column.slice(k, 1), scale, None)) for k in range(batch.num_rows)]
                rows = [(k, z[0].tolist()) for k, (kept, z) in rows if len(kept)]
                index, lists = pa.array([k for k, _ in rows], pa.int64()), pa.array([z for _, z in rows], pa.list_(pa.int32()))
            else:
                kept, z = _integers(column, scale, length)
                index = pa.array(kept)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * length), pa.array(z.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(index), lists], names=["_id", "_z"])

    return run


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("_z").flatten().to_numpy().reshape(-1, length).astype(np.int64)


def _sums(books: Codebooks):
    """A task's sums by part, entry and place, with the number of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.entries.shape
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            z = _matrix(batch, books.length)
            index, _ = books.nearest(z)
            for p in range(parts):
                order = np.argsort(index[:, p], kind="stable")
                used, first, count = np.unique(index[order, p], return_index=True, return_counts=True)
                if len(used):
                    total[p, used] += np.add.reduceat(z[order, p * width : (p + 1) * width], first)
                    n[p, used] += count
        p, e = np.nonzero(n)
        names = ("part", "entry", "place", "total", "n")
        rows = (np.repeat(p, width).astype(np.int32), np.repeat(e, width).astype(np.int32), np.tile(np.arange(width, dtype=np.int32), len(p)), total[p, e].ravel(), np.repeat(n[p, e], width))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=list(names))

    return run


def train(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks after ``rounds`` rounds; the integer vectors are written to the shared folder once."""
    rows = df.select(F.col(vec_id).alias("_id"), F.col(vector).alias("_v"))
    schema = T.StructType([T.StructField("_id", df.schema[vec_id].dataType), T.StructField("_z", T.ArrayType(T.IntegerType()))])
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    first = rows.where(finite & (F.size("_v") > 0)).orderBy(F.asc_nulls_last("_id"), "_v").limit(1).mapInArrow(_quantised("_v", scale, None), schema).first()
    if first is None:
        return Codebooks(np.empty((parts, 0, 0), np.int64), scale)
    length = len(first["_z"])
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    kept = storage.materialise(rows.mapInArrow(lean(_quantised("_v", scale, length)), schema), "integers")
    begun = kept.orderBy(F.asc_nulls_last("_id"), "_z").limit(entries).select("_z").collect()
    start = np.array([r["_z"] for r in begun], np.int64).reshape(len(begun), parts, length // parts)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        sums = kept.select("_z").mapInArrow(lean(_sums(books)), _SUMS).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        new, table = books.entries.copy(), sums.toArrow()
        part, entry, place, total, n = (table[c].to_numpy() for c in ("part", "entry", "place", "total", "n"))
        new[part, entry, place] = total // n  # floors go down
        books = Codebooks(new, scale)
    return books


def encode(df: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """``df``'s columns of every kept row, ``_code`` (a number a part) and ``_error`` (squared distance in integers, over all parts)."""
    carried = Carried(df)
    df, vector = carried.df, carried(vector)
    schema = T.StructType([*df.schema.fields, T.StructField("_code", T.ArrayType(T.IntegerType())), T.StructField("_error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, z = _integers(batch.column(vector), books.scale, books.length)
            index, error = books.nearest(z)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * index.shape[1]), pa.array(index.astype(np.int32).ravel()))
            rows = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*rows.columns, codes, pa.array(error.sum(1))], names=[*rows.schema.names, "_code", "_error"])

    if not books.length:
        return carried.back(df.where("false").selectExpr("*", "CAST(NULL AS array<int>) AS _code", "CAST(NULL AS bigint) AS _error"), "_code", "_error")
    return carried.back(df.mapInArrow(lean(run), schema), "_code", "_error")


def group_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``_label_error``: ``_error`` summed over equal labels, nulls together.

    Sums are made before rows move; a label's one row is joined to its many, which adaptive execution
    broadcasts if the labels are few, and splits if one is hot."""
    carried = Carried(coded, "_error")
    coded, label = carried.df, carried(label)
    sums = coded.groupBy(F.col(label).alias("_label")).agg(F.sum("_error").alias("_label_error"))
    return carried.back(coded.join(sums, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label"), "_label_error")
