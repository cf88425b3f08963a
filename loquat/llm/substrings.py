"""Substring dedup with a count-min prefilter.

A window is ``size`` consecutive words of one document. A word goes if some window over it also
starts in a document with a smaller id; windows are judged on the input, never on what is left.

1. Every block counts its windows in a count-min sketch of ``ROWS`` rows. A partition's sketch holds
   few non-zero counters, so it travels as sorted counter numbers; ranges of counters are merged in
   separate tasks, so the sketch grows with the corpus and no task or executor holds all of it.
2. Merged counters overestimate. Only windows whose counters all reach two are grouped exactly, by a
   128-bit hash of the word sequence (two independent 64-bit hashes), one entry a block and window.
   A repeated window has counters of two or more in every row, so none is lost.
3. Each block learns, a bit a window, whether a smaller id owns it elsewhere, and cuts its texts.

Defined cases: ids are integers (others are an error); null or empty text has no words; texts under ``size`` words are kept whole; a null id
ranks after every id, and rows of equal id (or null) do not own windows of each other; repeated rows
come out as often as they came in; other columns pass through (see ``columns`` for names that clash); an
empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loquat.llm import exchange as X
from loquat.llm import storage
from loquat.llm.columns import Carried
from loquat.llm.text import Words, decode, encode, mix

ROWS = 2
#: Counters of a row for each window.
WIDTH = 16
#: Windows whose counters are made or looked up at a time.
_STEP = 1 << 16
_NULL_ID = np.iinfo(np.int64).max
_PIECE = re.compile(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+")


def dedup_substrings(df: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 13, cleaned: bool = False, block_bytes: int = X.BLOCK_BYTES) -> DataFrame:
    """``df``'s columns and: ``_n_words``, ``_n_removed``, ``_kept`` (kept words joined by one space).

    ``cleaned``: ``_kept`` is instead the text itself without the removed words, its other white space
    as it was (null if it was null)."""
    carried = Carried(df)
    df, text, doc_id = carried.df, carried(text), carried(doc_id)
    added = [("_n_words", T.LongType()), ("_n_removed", T.LongType()), ("_kept", T.StringType())]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added)])
    blocks = X.Blocks(df.sparkSession, df, text, block_bytes)
    shards = blocks.shards()
    width = -(-max(64, int(blocks.bytes / 6.0)) * WIDTH // shards)  # counters of a shard and row
    estimated = storage.materialise(blocks.answer(blocks.ask(_count(text, size, shards, width)), _merge(width)), "estimated")
    owned = blocks.answer(blocks.ask(_candidates(text, doc_id, size, shards, width), estimated), _owners)
    # The estimates are needed again, to number the candidates: a bit a counter.
    both = estimated.unionByName(owned.selectExpr("block", f"shard + {ROWS * shards} AS shard", "payload"))
    return carried.back(blocks.map(both, _cut(text, doc_id, size, shards, width, cleaned), schema), *(n for n, _ in added))


class _Windows:
    """Window hashes and row numbers of a block. A block is held several times over in such arrays: no more is kept than is asked for."""

    def __init__(self, rows: pa.Table, text: str, size: int):
        words = Words.of([encode(x) for x in rows[text].to_pylist()])
        self.n_words, self.first = words.counts, words.first
        start, self.per_row = words.window_starts(size)
        self.h1, self.h2 = words.runs(start, size, 11), words.runs(start, size, 12)

    def rows_of(self, at: np.ndarray) -> np.ndarray:
        """The row of each window (in order)."""
        return np.searchsorted(np.cumsum(self.per_row), at, side="right")

    def starts_of(self, at: np.ndarray) -> np.ndarray:
        """The first word of each window (in order)."""
        row = self.rows_of(at)
        return at + (self.first - (np.cumsum(self.per_row) - self.per_row))[row]

    def cells(self, row: int, total: int) -> np.ndarray:
        """The counter of each window in a row of the sketch."""
        out = np.empty(len(self.h1), np.uint32 if total < 2**31 else np.uint64)
        for i in range(0, len(out), _STEP):
            at = slice(i, i + _STEP)
            h = self.h1[at] if row == 0 else mix(self.h1[at] ^ self.h2[at])
            out[at] = (h >> np.uint64(32)).astype(np.float64) * (total / 2**32) if total < 2**31 else h % np.uint64(total)
        return out


def _sorted_cells(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct counters in order, and which of them occur several times; ``cells`` is sorted in place."""
    cells.sort()
    new = np.ones(len(cells), bool)
    new[1:] = cells[1:] != cells[:-1]
    many = ~np.r_[new[1:], np.ones(min(1, len(new)), bool)]
    return cells[new], many[new]


def _among(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each of ``x`` is one of the sorted values."""
    out = np.zeros(len(x), bool)
    for i in range(0, len(x) if len(values) else 0, _STEP):
        some = x[i : i + _STEP]
        out[i : i + _STEP] = values[np.minimum(np.searchsorted(values, some), len(values) - 1)] == some
    return out


def _ranges(cells: np.ndarray, shards: int, width: int) -> Iterator[tuple[int, slice]]:
    cuts = np.searchsorted(cells, (np.arange(shards + 1, dtype=np.uint64) * np.uint64(width)).astype(cells.dtype))
    for s in range(shards):
        if cuts[s + 1] > cuts[s]:
            yield s, slice(cuts[s], cuts[s + 1])


def _count(text: str, size: int, shards: int, width: int):
    """The block's sketch: counter numbers, and which of them hold two or more."""

    def ask(rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        w = _Windows(rows, text, size)
        for row in range(ROWS):
            cells, many = _sorted_cells(w.cells(row, shards * width))
            for s, at in _ranges(cells, shards, width):
                yield row * shards + s, X.join_parts(X.pack_sorted(cells[at].astype(np.uint64) - np.uint64(s * width)), X.pack(np.packbits(many[at])))

    return ask


def _merge(width: int):
    """Sum of the blocks' counters, saturated at two; to each block, a bit for each of its counters."""

    def answer(shard: int, payloads: list[bytes]) -> list[bytes]:
        sketch = np.zeros(width + 1, np.uint8)
        cells = []
        for raw in payloads:
            at, many = X.split_parts(raw)
            at = X.unpack_sorted(at)
            sketch[at] = np.minimum(sketch[at] + 1 + np.unpackbits(X.unpack(many), count=len(at)), 2)
            cells.append(at)
        return [X.pack(np.packbits(sketch[at] > 1)) for at in cells]

    return answer


class _Candidates:
    """Windows of a block that the sketch estimates repeated, once each, by key."""

    def __init__(self, w: _Windows, rows: pa.Table, doc_id: str, answers: dict[int, bytes], shards: int, width: int):
        maybe = np.ones(len(w.h1), bool)
        for row in range(ROWS):
            cells, _ = _sorted_cells(w.cells(row, shards * width))
            flags = np.zeros(len(cells), bool)
            for s, at in _ranges(cells, shards, width):
                flags[at] = np.unpackbits(X.unpack(answers[row * shards + s]), count=at.stop - at.start)
            cells = cells[flags]
            maybe &= _among(cells, w.cells(row, shards * width))
        self.at = np.flatnonzero(maybe)
        h1, h2 = w.h1[self.at], w.h2[self.at]
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        self.key = np.empty(len(order), np.int64)  # of each candidate window, its key's number
        self.key[order] = np.cumsum(new) - 1
        self.h1, self.h2 = h1[new], h2[new]
        ids = np.array([_NULL_ID if x is None else x for x in rows[doc_id].to_pylist()], np.int64)
        self.ids = ids[w.rows_of(self.at)]
        self.least = np.full(len(self.h1), _NULL_ID, np.int64)
        np.minimum.at(self.least, self.key, self.ids)


def _candidates(text: str, doc_id: str, size: int, shards: int, width: int):
    def ask(rows: pa.Table, answers: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        c = _Candidates(_Windows(rows, text, size), rows, doc_id, answers, shards, width)
        for s, at in X.slices(c.h1, shards):
            yield s, X.join_parts(X.pack_sorted(c.h1[at]), X.pack(c.h2[at]), X.pack(c.least[at]))

    return ask


def _owners(shard: int, payloads: list[bytes]) -> list[bytes]:
    """Exact grouping; to each block, whether another block has a smaller id for the window."""
    h1, h2, least = [], [], []
    for raw in payloads:
        a, b, c = X.split_parts(raw)
        h1.append(X.unpack_sorted(a))
        h2.append(X.unpack(b))
        least.append(X.unpack(c))
    lengths = [len(x) for x in h1]
    h1, h2, least = np.concatenate(h1), np.concatenate(h2), np.concatenate(least)
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    owner = np.minimum.reduceat(least[order], start)
    smaller = np.empty(len(order), bool)
    smaller[order] = np.repeat(owner, np.diff(start, append=len(order))) < least[order]
    return [X.pack(np.packbits(x)) for x in np.split(smaller, np.cumsum(lengths)[:-1])]


def _cut(text: str, doc_id: str, size: int, shards: int, width: int, cleaned: bool):
    def use(rows: pa.Table, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        w = _Windows(rows, text, size)
        c = _Candidates(w, rows, doc_id, answers, shards, width)
        smaller = np.zeros(len(c.h1), bool)
        for s, at in X.slices(c.h1, shards):
            smaller[at] = np.unpackbits(X.unpack(answers[ROWS * shards + s]), count=at.stop - at.start)
        starts = w.starts_of(c.at[smaller[c.key] | (c.ids > c.least[c.key])])
        n_words, first = w.n_words, w.first
        del w, c  # what follows needs the texts and a bit a word
        gone = np.zeros(int(n_words.sum()), bool)
        for start in _runs_of(starts, size):
            gone[start] = True
        below = np.r_[0, np.cumsum(gone, dtype=np.int32)]
        n_removed = (below[first + n_words] - below[first]).astype(np.int64)
        del below
        for i in range(0, rows.num_rows, 256):
            part = rows.slice(i, 256)
            out = []
            for k, value in enumerate(part[text].to_pylist(), i):
                keep = None if not n_removed[k] else ~gone[first[k] : first[k] + n_words[k]]
                out.append(_cleaned(value, keep) if cleaned else _kept(value, keep))
            at = slice(i, i + part.num_rows)
            columns = [*(x.combine_chunks() for x in part.itercolumns()), pa.array(n_words[at]), pa.array(n_removed[at]), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.column_names, "_n_words", "_n_removed", "_kept"])

    return use


def _runs_of(starts: np.ndarray, size: int) -> Iterator[slice]:
    """Words that windows (in order) cover: overlapping ones as one slice."""
    if len(starts):
        new = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + size])
        for a, b in zip(starts[new].tolist(), starts[np.r_[new[1:], len(starts)] - 1].tolist()):
            yield slice(a, b + size)


def _kept(value: str | None, keep: np.ndarray | None) -> str:
    words = encode(value).split()
    return decode(b" ".join(words if keep is None else compress(words, keep.tolist())))


def _cleaned(value: str | None, keep: np.ndarray | None) -> str | None:
    return value if keep is None else decode(b"".join(compress(_PIECE.findall(encode(value)), keep.tolist())).lstrip(b" \n"))
