"""Cost-balanced packing of documents into sequences of bounded length.

The cost of a piece is linear in its tokens plus quadratic (attention within a piece). Tokens are
pooled to ``pool_tokens``; whole sequences' worth of a long document stand alone, the remainders are
taken by descending cost and each goes to the lowest-cost sequence with room for it, or, if none has
room, is cut to fill the lowest-cost sequence that is not full. A pool makes only full sequences;
what is left over (under one sequence) joins the next pool. The last left-over of a task is cut into
sequences whose lengths are powers of two, which need no padding: nothing is padded at all.

Tasks pack independently, so there is no shuffle; ``sequence_id`` is unique, not dense.

Defined cases: ids are integers (others are an error); null or empty text is the end id alone; null or repeated ids are packed like others
(rows of equal id are separate documents); an empty table gives no pieces; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquat.llm.text import lean
from loquat.llm.tokens import encoded, shared_encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def cost(length, linear: float = 1.0, quadratic: float = 1 / 2048):
    return linear * length + quadratic * length * length


def pack_pool(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """(full sequences, left-over pieces), as (document, start, length). Left-overs are under one capacity in all."""
    full, rest = [], []
    for doc, n in enumerate(lengths):
        whole = n // capacity * capacity
        full += [[(doc, at, capacity)] for at in range(0, whole, capacity)]
        if n > whole:
            rest.append((doc, whole, n - whole))
    rest.sort(key=lambda x: (-x[2], x[0]))
    sequences = [[] for _ in range(sum(x[2] for x in rest) // capacity)]
    room, costs = np.full(len(sequences), capacity), np.zeros(len(sequences))
    left = []
    for doc, at, n in rest:
        while n:
            fits = room >= n
            if not fits.any():
                fits = room > 0
            if not fits.any():
                left.append((doc, at, n))
                break
            k = int(np.where(fits, costs, np.inf).argmin())
            put = min(n, int(room[k]))
            sequences[k].append((doc, at, put))
            room[k] -= put
            costs[k] += cost(put, linear, quadratic)
            at, n = at + put, n - put
    return full + sequences, left


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Pieces cut into sequences whose lengths are the powers of two of their sum, largest first."""
    total, out = sum(x[2] for x in pieces), []
    queue = list(reversed(pieces))
    for bit in range(total.bit_length() - 1, -1, -1):
        need, sequence = total & (1 << bit), []
        while need:
            doc, at, n = queue.pop()
            put = min(n, need)
            sequence.append((doc, at, put))
            if n > put:
                queue.append((doc, at + put, n - put))
            need -= put
        if sequence:
            out.append(sequence)
    return out


def pack(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048, pool_tokens: int = 2_000_000, specials: bool = False) -> DataFrame:
    """A row for each piece: where it lies in its document and in its sequence, and its ids (32-bit little-endian).

    ``specials``: strings of special tokens become their ids (see ``tokens.Encoder``)."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(_packer(tokenizer, end_id, capacity, linear, quadratic, pool_tokens, specials)), PIECES)


def _packer(tokenizer: str, end_id: int, capacity: int, linear: float, quadratic: float, pool_tokens: int, specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, next_id = shared_encoder(tokenizer, end_id, specials), TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # (doc_id, ids before, ids, the document's ids)
        size = 0

        def placed(sequences) -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            for i in range(0, len(sequences), 500):
                columns = [[] for _ in range(7)]
                for sequence in sequences[i : i + 500]:
                    offset = 0
                    for doc, at, n in sequence:
                        name, before, ids, total = held[doc]
                        for column, x in zip(columns, (name, before + at, n, total, next_id, offset, ids[4 * at : 4 * (at + n)]), strict=True):
                            column.append(x)
                        offset += n
                    next_id += 1
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:6]), pa.array(columns[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            sequences, left = pack_pool([len(x[2]) // 4 for x in held], capacity, linear, quadratic)
            yield from placed(sequences + powers(left) if last else sequences)
            held = [(held[d][0], held[d][1] + at, held[d][2][4 * at : 4 * (at + n)], held[d][3]) for d, at, n in left]
            size = sum(n for _, _, n in left)

        for batch in batches:
            names = batch.column("doc_id")
            for k, ids in encoded(batch, "text", encoder):
                held.append((names[k].as_py(), 0, ids, len(ids) // 4))
                size += len(ids) // 4
                if size >= pool_tokens:
                    yield from flush(last=False)
        if held:
            yield from flush(last=True)

    return run
