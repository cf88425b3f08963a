"""Quality rules with cross-document line frequency.

A line is normalised to its lower-cased (A-Z) words and hashed together with its host. Distinct documents
are counted per host and line over the whole corpus; lines found in more than ``max_docs`` documents
of a host are removed, and a document that keeps less than ``min_share`` of its words is rejected, as
is one that fails the base rules (too few words, or mostly repeated 3-word windows).

Lines travel by block exchange: a block sends each of its distinct lines once with the documents that
hold it (at most ``max_docs`` + 1, which decides it already), and learns a bit a line. A line on every
page of a hot host costs one entry a block.

Defined cases: documents are told by their id, so rows of one id are one document; a row without an id is
no document when lines are counted, but loses lines like others; null text has no words and
fails the base rules; a null host is a host of its own; lines without words are neither counted nor
removed; other columns pass through (see ``columns`` for names that clash); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loquat.llm import exchange as X
from loquat.llm.columns import Carried
from loquat.llm.text import Words, decode, encode, mix

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\v\f\r"


def apply_line_rules(df: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", max_docs: int = 20, min_share: float = 0.3, min_words: int = 50, max_repeat_percent: int = 50, cleaned: bool = False, block_bytes: int = X.BLOCK_BYTES) -> DataFrame:
    """``df``'s columns and ``_n_words``, ``_word_chars``, ``_n_symbols``, ``_n_dup_lines``,
    ``_n_repeat_words``, ``_n_removed_words``, ``_base_failed``, ``_kept`` and, if ``cleaned``, ``_text``
    (the text without the removed lines; null if it was null)."""
    carried = Carried(df)
    df, text, host, doc_id = carried.df, carried(text), carried(host), carried(doc_id)
    added = [(f"_{x}", T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words")]
    added += [("_base_failed", T.BooleanType()), ("_kept", T.BooleanType())] + [("_text", T.StringType())] * cleaned
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added)])
    blocks = X.Blocks(df.sparkSession, df, text, block_bytes)
    shards = blocks.shards()
    frequent = blocks.answer(blocks.ask(_ask(text, host, doc_id, shards, max_docs)), _over(max_docs))
    judged = blocks.map(frequent, _judge(text, host, shards, min_share, min_words, max_repeat_percent, cleaned), schema)
    return carried.back(judged, *(n for n, _ in added))


class _Lines:
    """Lines of a block: their key (host and words), row and words."""

    def __init__(self, rows: pa.Table, text: str, host: str):
        self.raws = [encode(x) for x in rows[text].to_pylist()]
        self.lines = [raw.split(b"\n") for raw in self.raws]
        words = Words.of(list(chain.from_iterable(self.lines)), lower=True)
        self.row = np.repeat(np.arange(len(self.raws)), [len(x) for x in self.lines])
        self.n_words = words.counts
        hosts, number = np.unique([b"" if x is None else b"." + encode(str(x)) for x in rows[host].to_pylist()] or [b""], return_inverse=True)
        of_host = Words.of(list(hosts), inside=np.ones(256, bool) & (np.arange(256) != 10))
        host_hash = np.zeros(len(hosts), np.uint64)
        host_hash[of_host.counts > 0] = of_host.hashes[of_host.first[of_host.counts > 0]] if len(of_host.hashes) else 0
        self.key = words.runs(words.first, words.counts, 41)
        self.key = mix(self.key + mix(host_hash)[number][self.row]) if len(self.row) else self.key

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted keys of lines with words, number of each line's key or -1)"""
        used = np.flatnonzero(self.n_words > 0)
        keys, number = np.unique(self.key[used], return_inverse=True)
        of_line = np.full(len(self.key), -1, np.int64)
        of_line[used] = number
        return keys, of_line


def _pairs(line: np.ndarray, doc: np.ndarray, lines: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct documents of each line, ``most`` at most; which they are, line by line)"""
    order = np.lexsort((doc, line))
    line, doc = line[order], doc[order]
    new = np.r_[True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])][: len(line)]
    line, doc = line[new], doc[new]
    count = np.bincount(line, minlength=lines)
    keep = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count) < most
    return np.minimum(count, most), doc[keep]


def _ask(text: str, host: str, doc_id: str, shards: int, max_docs: int):
    def ask(rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        lines = _Lines(rows, text, host)
        keys, of_line = lines.distinct()
        names = Words.of([b"" if x is None else b"." + encode(str(x)).replace(b"\n", b"\0") for x in rows[doc_id].to_pylist()], inside=np.arange(256) != 10)
        known = names.counts > 0  # every id but null is one word, of any bytes
        ids = np.zeros(rows.num_rows, np.uint64)
        ids[known] = names.hashes[names.first[known]]
        counted = np.flatnonzero((of_line >= 0) & known[lines.row])
        docs, which = _pairs(of_line[counted], ids[lines.row[counted]], len(keys), max_docs + 1)
        ends = np.r_[0, np.cumsum(docs)]
        for s, at in X.slices(keys, shards):
            yield s, X.join_parts(X.pack_sorted(keys[at]), X.pack(docs[at].astype(np.uint32)), X.pack(which[ends[at.start] : ends[at.stop]]))

    return ask


def _over(max_docs: int):
    def answer(shard: int, payloads: list[bytes]) -> list[bytes]:
        parts = [X.split_parts(x) for x in payloads]
        keys = [X.unpack_sorted(a) for a, _, _ in parts]
        every, number = np.unique(np.concatenate(keys), return_inverse=True)
        lines = np.repeat(number, np.concatenate([X.unpack(b) for _, b, _ in parts]))
        docs, _ = _pairs(lines, np.concatenate([X.unpack(c) for _, _, c in parts]), len(every), max_docs + 1)
        over = (docs > max_docs)[number]
        return [X.pack(np.packbits(x)) for x in np.split(over, np.cumsum([len(k) for k in keys])[:-1])]

    return answer


def repeated_words(words: Words, size: int = 3) -> np.ndarray:
    """By text: words inside windows found twice or more in it."""
    start, per_text = words.window_starts(size)
    text = np.repeat(np.arange(len(per_text)), per_text)
    key = mix(words.runs(start, size, 42) + mix(text.astype(np.uint64) + np.uint64(1)))
    _, number, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = start[count[number] > 1]
    n = len(words.hashes)
    inside = np.cumsum(np.bincount(twice, minlength=n + 1) - np.bincount(twice + size, minlength=n + 1))[:n] > 0
    below = np.r_[0, np.cumsum(inside)]
    return below[words.first + words.counts] - below[words.first]


def _judge(text: str, host: str, shards: int, min_share: float, min_words: int, max_repeat_percent: int, cleaned: bool):
    def use(rows: pa.Table, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        lines = _Lines(rows, text, host)
        keys, of_line = lines.distinct()
        over = np.zeros(len(keys) + 1, bool)
        for s, at in X.slices(keys, shards):
            over[at] = np.unpackbits(X.unpack(answers[s]), count=at.stop - at.start)
        gone = over[of_line]
        words = Words.of(lines.raws)
        n_words = words.counts
        removed = np.bincount(lines.row, weights=lines.n_words * gone, minlength=len(n_words)).astype(np.int64)
        repeat = repeated_words(words)
        failed = (n_words < min_words) | (100 * repeat > max_repeat_percent * n_words)
        kept = ~failed & (n_words - removed >= min_share * n_words)
        chars, symbols, dups, texts = [], [], [], []
        first = np.cumsum([0, *(len(x) for x in lines.lines)])
        for k, (raw, value) in enumerate(zip(lines.raws, rows[text], strict=True)):
            bare = raw.translate(None, _SPACE)
            chars.append(len(bare) if bare.isascii() else len(decode(bare)))
            symbols.append(len(raw) - len(raw.translate(None, SYMBOLS)))
            own = [x for x in lines.lines[k] if x and not x.isspace()]
            dups.append(len(own) - len(set(own)))
            if cleaned:
                flags = gone[first[k] : first[k + 1]]
                texts.append(value.as_py() if not flags.any() else decode(b"\n".join(x for x, g in zip(lines.lines[k], flags.tolist(), strict=True) if not g)))
        added = [("_n_words", n_words), ("_word_chars", chars), ("_n_symbols", symbols), ("_n_dup_lines", dups), ("_n_repeat_words", repeat), ("_n_removed_words", removed)]
        columns = [*rows.combine_chunks().itercolumns(), *(pa.array(np.asarray(x, np.int64)) for _, x in added), pa.array(failed), pa.array(kept)]
        names = [*rows.column_names, *(n for n, _ in added), "_base_failed", "_kept"]
        if cleaned:
            columns, names = [*columns, pa.array(texts, pa.string())], [*names, "_text"]
        yield from pa.table(columns, names=names).to_batches(max_chunksize=500)

    return use
