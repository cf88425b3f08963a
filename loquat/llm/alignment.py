"""Tokens of one tokenizer aligned with those of another, over a corpus.

A is a byte-level BPE (tokenizers file), B a sentencepiece model, which puts a space before a text; A gets the
text with that space, so both cut the same bytes. B's tokens are a static interval index, the sorted bounds of
their byte ranges, and each A token asks it by bisection for the B tokens that its range overlaps
(``overlaps``: first and last of a consecutive list). The gap behind an A token that none of them spans is a place where tokens
of both end, and cuts both sequences into groups. The last tokens of a group end together: they are a link.

How often a pair of ids is linked in the corpus, and how often the most frequent partner of a B id is, takes
two questions to all documents. Ids are written once, in blocks (``exchange``); a block sends each distinct pair
once with its count, by ranges of a hash of the pair, so neither a frequent pair nor a frequent id makes a
large shard. Highest counts are a number for each B id: they pass the driver, bounded by B's vocabulary. A second pass over
what was asked gives every block its pairs' counts back.

Defined cases: null and empty texts have no tokens, nor have texts that either tokenizer does not give back
byte for byte (with U+2581, for one, which B reads as a space); the strings of special tokens in a text are
ordinary text; repeated rows count as often as they occur; an empty table gives an empty table. All columns
but the text, which the tokens hold, pass through (see ``columns`` for names that clash). A text is
taken whole: its tokens and their bounds, about 60 bytes a token, are in memory together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loquat.llm import storage
from loquat.llm.columns import Carried
from loquat.llm.exchange import Blocks, join_parts, pack, pack_sorted, slices, split_parts, unpack, unpack_sorted
from loquat.llm.text import encode, mix
from loquat.llm.tokens import Encoder, PieceEncoder

#: Text bytes tokenized at a time.
CHUNK = 1 << 20
#: Words remembered by a worker for each tokenizer, at about 50 bytes each.
REMEMBERED = 1_000_000
ADDED = {"_n_a": "long", "_n_b": "long", "_n_groups": "long", "_n_links": "long", "_n_best": "long", "_count_sum": "long", "_groups": "string"}


def last_overlaps(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """The last B token that overlaps each A token, where both cover the same bytes; B's sorted ends are the index."""
    return np.searchsorted(b_end, a_end)


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last B token that overlaps each A token. The list of an A token begins with the last of the one before,
    unless that ends where the A token begins: then with the next."""
    last = last_overlaps(a_end, b_end)
    return np.r_[0, last[:-1] + (b_end[last[:-1]] == a_end[:-1])], last


def unmix(x: np.ndarray) -> np.ndarray:
    """What ``mix`` made of it."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
    x ^= x >> np.uint64(33)
    x *= np.uint64(pow(0xFF51AFD7ED558CCD, -1, 1 << 64))
    x ^= x >> np.uint64(33)
    return x


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Encoder(a_path, None, limit=REMEMBERED), PieceEncoder(b_path, limit=REMEMBERED)
        # Byte-level tokens write a byte as a character: printable Latin-1 as itself, the others from 256 on, in order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
        names = sorted((k, t) for t, k in self.a.tokenizer.get_vocab(with_added_tokens=True).items())
        self.a_bytes = [b""] * (names[-1][0] + 1)
        for k, t in names:
            self.a_bytes[k] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        model = self.b.model
        pieces = [(k, model.id_to_piece(k)) for k in range(model.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in pieces]
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.kind = "<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4"
        first = self.a.encode(["a"])[0]
        self.first = len(first)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(A ids, B ids) of each text; none of both where one of them is not the text again."""
        # A letter and then the space: the letter is a token of its own, and the encoder knows such texts by their words.
        a_ids = [np.frombuffer(x, "<u4", offset=self.first) for x in self.a.encode([f"a {x}" for x in texts])]
        b_ids = [np.frombuffer(x, "<u4") for x in self.b.encode(texts)]
        out, nothing = [], np.empty(0, self.kind)
        for text, a, b in zip(texts, a_ids, b_ids, strict=True):
            raw = b" " + encode(text)
            # Byte-level merges change no byte, so A can only lack some; B may write another character instead.
            same = text and self.a_size[a].sum() == len(raw) and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == raw
            out.append((a.astype(self.kind), b.astype(self.kind)) if same else (nothing, nothing))
        return out

    def sizes(self) -> Sizes:
        return Sizes(self.a_size.astype(np.int32), np.array([len(x) for x in self.b_bytes], np.int32), self.kind)


_loaded: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _loaded:
        _loaded.clear()
        _loaded[a_path, b_path] = Tokenizers(a_path, b_path)
    return _loaded[a_path, b_path]


class Sizes:
    """Bytes of each id of A and of B, and how ids are stored."""

    def __init__(self, a: np.ndarray, b: np.ndarray, kind: str):
        self.a, self.b, self.kind = a, b, kind

    def store(self, a: np.ndarray, b: np.ndarray) -> bytes:
        return len(a).to_bytes(8, "little") + a.tobytes() + b.tobytes() if len(a) else b""

    def load(self, stored: list[bytes]) -> Aligned:
        """Several texts' ids, one behind the other."""
        n = [int.from_bytes(x[:8], "little") for x in stored]
        a = [np.frombuffer(x, self.kind, k, 8) if k else np.empty(0, self.kind) for x, k in zip(stored, n, strict=True)]
        b = [np.frombuffer(x, self.kind, -1, 8 + k * np.dtype(self.kind).itemsize) if k else np.empty(0, self.kind) for x, k in zip(stored, n, strict=True)]
        return Aligned(np.concatenate([*a, np.empty(0, self.kind)]), np.concatenate([*b, np.empty(0, self.kind)]), np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64), self)


class Aligned:
    """Ids of some texts, one behind the other (the texts that have tokens are of equal bytes for A and B), and where both end."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, sizes: Sizes):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        place = np.int32 if len(a) * int(sizes.a.max()) < 1 << 31 else np.int64
        a_end, b_end = np.cumsum(sizes.a[a], dtype=place), np.cumsum(sizes.b[b], dtype=place)
        last = last_overlaps(a_end, b_end)
        # Gaps that the last B token of the list does not span.
        self.a_last = np.flatnonzero(b_end[last] == a_end) if len(a) else np.empty(0, np.int64)
        self.b_last = last[self.a_last]
        #: Links of each text lie between these.
        self.bounds = np.searchsorted(self.a_last, np.cumsum(np.r_[0, n_a]))

    def pairs(self) -> np.ndarray:
        """A hash of each link's pair of ids, which ``unmix`` gives back: A's above B's."""
        return mix(self.a[self.a_last].astype(np.uint64) << np.uint64(32) | self.b[self.b_last].astype(np.uint64))

    def sums(self, of_links: np.ndarray) -> np.ndarray:
        """A number a link, summed by text."""
        upto = np.r_[0, np.cumsum(of_links, dtype=np.int64)]
        return np.diff(upto[self.bounds])

    def rendered(self, pieces: tuple[np.ndarray, np.ndarray], first: int, stop: int) -> pa.Array:
        """The groups of some texts: ``a1,a2|b1;a3|b2,b3``; ``pieces`` from ``_pieces``."""
        n_a, n_b = self.n_a[first:stop], self.n_b[first:stop]
        a_at, b_at = int(self.n_a[:first].sum()), int(self.n_b[:first].sum())
        a, b = self.a[a_at : a_at + n_a.sum()].astype(np.int32), self.b[b_at : b_at + n_b.sum()].astype(np.int32)
        links = slice(self.bounds[first], self.bounds[stop])
        a_last, b_last = self.a_last[links] - a_at, self.b_last[links] - b_at
        # An A token stands behind the B tokens of earlier groups, a B token behind the A tokens of its own too.
        before, upto = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        a_place = np.arange(len(a)) + np.repeat(np.r_[0, b_last[:-1] + 1][: len(a_last)], before)
        b_place = np.arange(len(b)) + np.repeat(a_last + 1, upto)
        signs = np.empty(len(a) + len(b), np.int32)
        signs[a_place], signs[b_place] = 3 * a, 3 * b
        signs[a_place[a_last]] += 1
        signs[b_place[b_last]] += 2
        letters, held = pieces
        mask = held[signs]
        end = np.r_[0, np.cumsum(mask.sum(1))][np.cumsum(n_a + n_b)]
        # The last sign of a text is left out.
        full = n_a > 0
        blob = np.delete(letters[signs][mask], end[full] - 1)
        offsets = np.r_[0, end - np.cumsum(full)].astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(n_a), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(blob.tobytes())])


def _pieces(sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """Every id with each of the signs ``,|;`` behind it, as rows of bytes, and which bytes count."""
    every = [f"{k}{sign}".encode() for k in range(max(len(sizes.a), len(sizes.b))) for sign in ",|;"]
    letters = np.array(every).view(np.uint8).reshape(len(every), -1)
    return letters, letters > 0


def _encoding(text: str, kept: list[str], a_path: str, b_path: str):
    """Rows with the ids of both tokenizers instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = None
        for batch in batches:
            if batch.num_rows and tokenizers is None:
                tokenizers = _tokenizers(a_path, b_path)
                sizes = tokenizers.sizes()
            texts, at = [x or "" for x in batch.column(text).to_pylist()], 0
            while at < len(texts):
                stop, held = at, 0
                while stop < len(texts) and (held < CHUNK or stop == at):
                    held, stop = held + len(texts[stop]), stop + 1
                ids = pa.array([sizes.store(a, b) for a, b in tokenizers.encode(texts[at:stop])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, stop - at) for c in kept), ids], names=[*kept, "_ids"])
                at = stop

    return run


def _ask(sizes: Sizes, shards: int):
    def ask(rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        pairs, count = np.unique(sizes.load(rows["_ids"].to_pylist()).pairs(), return_counts=True)
        for shard, part in slices(pairs, shards):
            yield shard, join_parts(pack_sorted(pairs[part]), pack(count[part].astype(np.uint32)))

    return ask


def _summed(payloads: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(pairs of each payload, all pairs, their counts over all payloads)"""
    parts = [split_parts(x) for x in payloads]
    keys = [unpack_sorted(x[0]) for x in parts]
    every, number = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, every, np.bincount(number, np.concatenate([unpack(x[1]) for x in parts])).astype(np.int64)


def _highest(asks: DataFrame) -> DataFrame:
    """(B id, count of its most frequent pair in a shard)"""

    def run(table: pa.Table) -> pa.Table:
        _, pairs, count = _summed(table["payload"].to_pylist())
        b = (unmix(pairs) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        order = np.lexsort((count, b))
        last = np.flatnonzero(np.r_[b[order][1:] != b[order][:-1], True])
        return pa.table({"b": b[order][last], "n": count[order][last]})

    return asks.groupBy("shard").applyInArrow(run, "b long, n long").groupBy("b").agg(F.max("n").alias("n"))


def _answer(highest: np.ndarray):
    """For each pair that a block asked for: its count, and whether no pair of its B id has more."""

    def answer(_: int, payloads: list[bytes]) -> list[bytes]:
        keys, every, count = _summed(payloads)
        best = count == highest[(unmix(every) & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        places = [np.searchsorted(every, k) for k in keys]
        return [join_parts(pack(count[p]), pack(best[p].astype(np.uint8))) for p in places]

    return answer


def _use(sizes: Sizes, kept: list[str], step: int = 100):
    def use(rows: pa.Table, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        found = sizes.load(rows["_ids"].to_pylist())
        pairs, number = np.unique(found.pairs(), return_inverse=True)
        parts = [split_parts(answers[s]) for s in sorted(answers)]
        count = np.concatenate([unpack(x[0]) for x in parts]) if parts else np.empty(0, np.int64)
        best = np.concatenate([unpack(x[1]) for x in parts]) if parts else np.empty(0, np.int64)
        if len(count) != len(pairs):
            raise ValueError("a block has other pairs than it asked for")
        links = np.diff(found.bounds)
        numbers = [found.n_a, found.n_b, links, links, found.sums(best[number]), found.sums(count[number])]
        pieces = _pieces(sizes)
        for i in range(0, rows.num_rows, step):
            stop = min(i + step, rows.num_rows)
            table = rows.slice(i, step).select(kept).combine_chunks()
            columns = [*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns), *(pa.array(x[i:stop]) for x in numbers), found.rendered(pieces, i, stop)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *ADDED])

    return use


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """``df``'s columns but the text, and of each text

    ``_n_a``, ``_n_b``: tokens; ``_n_groups``, and ``_groups``: ids by group, ``a1,a2|b1;a3|b2,b3``; ``_n_links``,
    ``_count_sum``: links, and how often their pairs are linked in all texts, summed; ``_n_best``: links whose pair is
    linked as often as any of its B id."""
    spark = df.sparkSession
    carried = Carried(df)
    df, text = carried.df, carried(text)
    kept = [c for c in df.columns if c != text]
    total = int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    blocks = Blocks(spark, df, "_ids", block_bytes=4 << 20, total=total, prepare=_encoding(text, kept, a_path, b_path))
    tokenizers = _tokenizers(a_path, b_path)
    sizes = tokenizers.sizes()
    shards = blocks.shards(bytes_per_key=24)
    asks = storage.materialise(blocks.ask(_ask(sizes, shards)), "pairs")
    highest = np.zeros(len(sizes.b), np.int64)
    for row in _highest(asks).collect():
        highest[row["b"]] = row["n"]
    answers = storage.materialise(blocks.answer(asks, _answer(highest)), "pair-counts")
    out = blocks.map(answers, _use(sizes, kept), T.StructType([*(df.schema[c] for c in kept), *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in ADDED.items())).fields]))
    names = {c: n for c, n in zip(carried.own, carried.names, strict=True)}
    carried.own, carried.names = kept, [names[c] for c in kept]
    return carried.back(out, *ADDED)
