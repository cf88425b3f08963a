"""Benchmark decontamination by one Aho-Corasick automaton over the items' word windows.

Items and texts are normalised alike (words of digits, letters and non-ASCII characters, A-Z lower-cased).
Every run of ``size`` item words, or a shorter item's whole text, is a pattern. The automaton's letters are
words, told by 64-bit hashes: windows that overlap share their nodes, so it has at most ``size`` nodes an
item word, of 16 bytes each. It lies in flat arrays: transitions are sorted (node, word) keys, and
every node has a failure link (the longest proper suffix that is a node) and the nearest pattern that ends
there. The driver builds it a level at a time and broadcasts it; ``max_nodes`` checks its size, and a
larger benchmark is an error that says so, never a partial or another scan.

Each text is scanned once, words passing through the automaton in their order. Many places are scanned in
step: a batch's words are cut into lanes that begin ``size`` - 1 words early, so that every match is seen
by the lane it ends in. Matched words are mapped to byte offsets of the original.

Defined cases: null or empty texts and items, and items without words, match nothing; repeated item ids
count once; null item ids are ignored; item ids may have any type; rows are judged one by one, whatever
their ids; other columns pass through (see ``columns`` for names that clash); empty tables give an empty
result, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loquat.llm.columns import Carried
from loquat.llm.text import Words, alphabet, chunks_of, encode, lean

#: Bytes between words, before lower-casing.
OUTSIDE = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
INSIDE = alphabet(OUTSIDE)
#: Nodes of an automaton at most: 16 bytes each, in every Python worker.
MAX_NODES = 30_000_000
#: Places scanned in step.
LANES = 2048


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each wanted key in sorted keys, whether it is there)"""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Automaton:
    """Node 0 is the root; node k > 0 is reached by transition k - 1, so nodes are numbered by depth."""

    words: np.ndarray  # sorted hashes of the words; a word's letter is its place
    keys: np.ndarray  # parent * letters + letter, sorted
    fail: np.ndarray
    ends: np.ndarray  # by node: itself if a pattern ends there, or the nearest such node by failure links, or 0
    first: np.ndarray  # letter -> node of depth 1, or 0
    patterns: np.ndarray  # sorted nodes where patterns end
    lengths: np.ndarray  # words of each
    starts: np.ndarray  # of each pattern's items in ``items``, and the end
    items: np.ndarray
    size: int

    def scan(self, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(end, pattern) of every occurrence in a stream of letters, -1 where there is none."""
        n, over = len(letters), self.size - 1
        if not n or not len(self.keys):
            return
        step = max(-(-n // LANES), 4 * over, 1)
        begin = np.arange(0, n, step)
        state = np.zeros(len(begin), np.int64)
        for t in range(-over, step):
            at = begin + t
            live = (at >= 0) & (at < n)
            letter = np.where(live, letters[np.clip(at, 0, n - 1)], -1)
            state = self._next(state, letter)
            if t >= 0:
                hit = np.flatnonzero((self.ends[state] > 0) & live)
                node, where = self.ends[state[hit]].astype(np.int64), at[hit]
                while len(node):
                    yield where, np.searchsorted(self.patterns, node)
                    node = self.ends[self.fail[node]].astype(np.int64)
                    node, where = node[node > 0], where[node > 0]

    def _next(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        out = np.where(letter >= 0, self.first[letter], 0).astype(np.int64)
        todo = np.flatnonzero((state > 0) & (letter >= 0))
        node, wanted = state[todo], letter[todo]
        while len(todo):
            at, found = _find(self.keys, node * len(self.words) + wanted)
            out[todo[found]] = at[found] + 1
            node = self.fail[node]
            going = ~found & (node > 0)
            todo, node, wanted = todo[going], node[going].astype(np.int64), wanted[going]
        return out


def build(words: np.ndarray, length: np.ndarray, items: np.ndarray, size: int, max_nodes: int = MAX_NODES) -> Automaton:
    """``words``: hashes of all items' words, ``length`` of each item, which is number ``items`` of the distinct ids."""
    known, letter = np.unique(words, return_inverse=True)
    n = np.minimum(length, size)
    per_item = np.where(length > 0, length - n + 1, 0)
    start = np.arange(per_item.sum()) + np.repeat(np.cumsum(length) - length - (np.cumsum(per_item) - per_item), per_item)
    n, owner = np.repeat(n, per_item), np.repeat(items, per_item)
    node, keys, bounds = np.zeros(len(start), np.int64), [], [0, 1]
    for d in range(int(n.max()) if len(n) else 0):
        live = n > d
        level, number = np.unique(node[live] * len(known) + letter[start[live] + d], return_inverse=True)
        if bounds[-1] + len(level) > max_nodes:
            raise ValueError(f"benchmark of {len(words)} words: its automaton has over {max_nodes} nodes, the bound of what is broadcast")
        node[live] = bounds[-1] + number
        keys.append(level)
        bounds.append(bounds[-1] + len(level))
    every = np.concatenate(keys) if keys else np.empty(0, np.int64)
    total = bounds[-1]
    first = np.zeros(max(1, len(known)), np.int32)
    first[every[: bounds[2] - 1] if len(bounds) > 2 else every[:0]] = np.arange(1, (bounds[2] if len(bounds) > 2 else 1), dtype=np.int32)
    least = int(items.max()) + 1 if len(items) else 1
    ending, holder = np.divmod(np.unique(node * least + owner), least)
    patterns, starts = np.unique(ending, return_index=True)
    depth_of = np.searchsorted(np.array(bounds), patterns, side="right") - 1
    ends = np.zeros(total, np.int32)
    ends[patterns] = patterns
    machine = Automaton(known, every, np.zeros(total, np.int32), ends, first, patterns, depth_of, np.r_[starts, len(holder)], holder, size)
    for a, b in zip(bounds[2:-1], bounds[3:], strict=True):  # depth 2 and on: failure links of the depth before are known
        parent, own = np.divmod(every[a - 1 : b - 1], len(known))
        machine.fail[a:b] = machine._next(machine.fail[parent].astype(np.int64), own)
    for a, b in zip(bounds[1:-1], bounds[2:], strict=True):
        ends[a:b] = np.where(ends[a:b] > 0, ends[a:b], ends[machine.fail[a:b]])
    return machine


def automaton(items: DataFrame, item_id: str, text: str, size: int, max_chars: int, max_nodes: int) -> tuple[Automaton, list]:
    """The automaton of a benchmark and its item ids, in the order of their strings.

    The driver turns ``max_chars`` characters of item text at a time into word hashes, and keeps those."""
    rows = items.select(F.col(item_id).alias("i"), F.col(item_id).cast("string").alias("s"), F.encode(F.col(text), "UTF-8").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    ids, names, hashes, lengths, part, size_ = [], [], [], [], [], 0

    def take() -> None:
        nonlocal part, size_
        for chunk in chunks_of(part):
            words = Words.of(chunk, INSIDE, lower=True)
            hashes.append(words.hashes)
            lengths.append(words.counts)
        part, size_ = [], 0

    for row in rows.toLocalIterator():
        ids.append(row.i)
        names.append(row.s)
        part.append(bytes(row.t))
        size_ += len(part[-1])
        if size_ >= max_chars:
            take()
    take()
    order, number = np.unique(np.array(names, object), return_inverse=True) if names else ([], np.empty(0, np.int64))
    of_name = dict(zip(names, ids, strict=True))
    none = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    return build(np.concatenate(hashes or none[0]), np.concatenate(lengths or none[1]), number, size, max_nodes), [of_name[x] for x in order]


def find_contamination(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, max_chars: int = 8_000_000, max_nodes: int = MAX_NODES) -> DataFrame:
    """``df``'s columns and ``_n_words``, ``_n_hit`` (words inside matches), ``_items`` (ids of matching
    items, sorted as strings), ``_spans`` (byte offsets of the runs of hit words in the UTF-8 text)."""
    from pyspark.sql.pandas.types import to_arrow_type

    carried = Carried(df)
    df, text = carried.df, carried(text)
    kind = items.schema[item_id].dataType
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    added = [("_n_words", T.LongType()), ("_n_hit", T.LongType()), ("_items", T.ArrayType(kind)), ("_spans", T.ArrayType(span))]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added)])
    arrow = [to_arrow_type(t) for _, t in added]
    shared = df.sparkSession.sparkContext.broadcast(automaton(items, item_id, item_text, size, max_chars, max_nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, ids = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                raws = [encode(x) for x in batch.column(text).to_pylist()]
                found = [x for chunk in chunks_of(raws) for x in matches(machine, chunk)]
                values = zip(*((n, hit, [ids[k] for k in own], spans) for n, hit, own, spans in found), strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, t in zip(values, arrow, strict=True))], names=schema.names)

    return carried.back(df.mapInArrow(lean(run), schema), *(n for n, _ in added))


def matches(machine: Automaton, raws: list[bytes]) -> list[tuple[int, int, list[int], list[dict[str, int]]]]:
    """Of each text: (words, words inside matches, numbers of the matching items, spans of the original)."""
    words = Words.of(raws, INSIDE, lower=True)
    at, known = _find(machine.words, words.hashes)
    n = len(at)
    # One letter that leads nowhere after every text.
    text = np.repeat(np.arange(len(raws)), words.counts)
    letters = np.full(n + len(raws), -1, np.int64)
    letters[np.arange(n) + text] = np.where(known, at, -1)
    edges, pairs = np.zeros(n + len(raws) + 1, np.int32), []
    owner = np.repeat(np.arange(len(raws)), words.counts + 1)
    for end, pattern in machine.scan(letters):
        np.add.at(edges, end - machine.lengths[pattern] + 1, 1)
        np.add.at(edges, end + 1, -1)
        pairs.append(np.unique(owner[end] * len(machine.patterns) + pattern))
    hit = np.cumsum(edges[:-1]) > 0
    hit = hit[np.arange(n) + text]
    below = np.r_[0, np.cumsum(hit)]
    n_hit = below[words.first + words.counts] - below[words.first]
    of_text = {}
    for k, pattern in zip(*np.divmod(np.unique(np.concatenate(pairs)), len(machine.patterns)), strict=True) if pairs else ():
        of_text.setdefault(int(k), []).append(machine.items[machine.starts[pattern] : machine.starts[pattern + 1]])
    out = []
    for k, raw in enumerate(raws):
        own, spans = [], []
        if n_hit[k]:
            own = np.unique(np.concatenate(of_text[k])).tolist()
            spans = byte_spans(raw, hit[words.first[k] : words.first[k] + words.counts[k]])
        out.append((int(words.counts[k]), int(n_hit[k]), own, spans))
    return out


def byte_spans(raw: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Original byte offsets of the runs of hit words."""
    inside = np.r_[False, INSIDE[np.frombuffer(raw, np.uint8)], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    change = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return [{"start": int(edges[2 * a]), "end": int(edges[2 * b - 1])} for a, b in zip(change[0::2], change[1::2], strict=True)]
