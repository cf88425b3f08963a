"""Katz backoff language model over a corpus, with every document scored.

Order 1: P(w) = (c + 1) / (N + V + 1) over training tokens; an unseen word is one further type.
Order n: for a history h seen in training, P(w | h) = d(c) c / c(h) if c = c(h w) > 0, else
alpha(h) P(w | shorter h); for an unseen history, P(w | shorter h). d is the Good-Turing discount of
counts up to ``K`` (Katz 1987), from counts of counts over the whole training corpus; alpha(h) gives
the words not seen after h exactly the mass that discounting left: (1 - sum of seen P(. | h)) /
(1 - sum of the seen words' shorter-history P). Where uneven counts of counts give a discount outside
(0, 1), the cut-off goes down to the largest one that gives none (see ``good_turing``). Where none of h's
continuations is discounted, they give up half a count in all. Probabilities always sum to one.

Words are told by 64-bit hashes and get a number (their rank in a shard, and the shard); so do n-grams, by
which the next order names histories. Per order there are two steps, over a block exchange. Counting: each
block sends its distinct n-grams with its counts, by history; shards sum them and store them (a table an
order, partitioned by shard). A history whose count passes ``split`` is dealt over several shards by word, and
the sums of its parts are added up: no history, however frequent, is one task's. Weighing, once counts of counts
are known: each shard's table of histories gets its back-off weights, and every block is answered from the stored tables.
The lower-order mass of a history is summed from its seen words' lower-order counts, which blocks know. Histories that no
training text has are not asked about. ``score_by_tables`` evaluates texts from the tables alone, recursively per token.

Defined cases: null or empty text is one end token; a null id counts as the text "" when folds are
drawn; repeated rows count as often as they occur; with no training rows, N is 0 and every token has
probability 1 / 1 under the base; other columns pass through (see ``columns`` for names that clash); an
empty table gives an empty table.
"""

from __future__ import annotations

import contextlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from loquat.llm import exchange as X
from loquat.llm import storage
from loquat.llm.columns import Carried
from loquat.llm.text import Words, encode, give_back, hold, lean, mix

#: Counts above this are not discounted; the cut-off may be lower.
K = 5
#: Occurrences of a history beyond which its continuations are dealt over several shards.
SPLIT = 1_500_000
#: The number of an n-gram of two words or more is its shard, and its rank there in so many bits. Such numbers that lie
#: within the same ``2 ** RUN`` (fewer where a shard would have under ``RUNS`` of these) go to one shard as histories, so
#: that what is sent of them is small steps.
RANK, RUN, RUNS = 28, 10, 64
#: Stands for the hash of the end token.
END = np.uint64(0x5BD1E995_5BD1E995)


def good_turing(counts_of_counts: np.ndarray, k: int = K) -> np.ndarray:
    """d(r) for r = 0..k+1 (d(0) unused; the last is 1), from ``counts_of_counts[r]``, the number of n-grams seen r times, r = 0..k+1.

    Katz's discounts up to the largest cut-off at which all are in (0, 1); counts above it are not
    discounted. Where no cut-off of two or more has such discounts, counts of counts are first smoothed by
    a log-linear fit; where that has no falling line either, absolute discounting by 1/2."""
    n = counts_of_counts.astype(np.float64)
    for counts in (n, _smoothed(n)):
        for top in range(k, 1, -1):
            if counts is not None and np.all(counts[1 : top + 1] > 0):
                r = np.arange(1, top + 1)
                tail = (top + 1) * counts[top + 1] / counts[1]
                d = ((r + 1) * counts[2 : top + 2] / (r * counts[1 : top + 1]) - tail) / (1 - tail) if tail < 1 else np.zeros(top)
                if np.all((d > 0) & (d < 1)):
                    return np.concatenate([[1.0], d, np.ones(k + 1 - top)])
    return np.concatenate([[1.0], 1 - 0.5 / np.arange(1, k + 1), [1.0]])


def _smoothed(n: np.ndarray) -> np.ndarray | None:
    """Counts of counts on the line through log n(r) by log r (Gale and Sampson 1995); None unless it falls faster than 1/r."""
    r = np.flatnonzero(n[1:] > 0) + 1
    if len(r) < 2:
        return None
    slope, at_one = np.polyfit(np.log(r), np.log(n[r]), 1)
    return np.concatenate([[0.0], np.exp(at_one) * np.arange(1.0, len(n)) ** slope]) if slope < -1 else None


class Katz:
    """A fitted model's shared facts: ``tokens`` (N), ``types`` (V) and discounts by order (2 and up)."""

    def __init__(self, tokens: int, types: int):
        self.tokens, self.types, self.discounts = tokens, types, {}
        #: By order of histories: the bits of their numbers that do not decide on a shard.
        self.run = {1: 0}

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return (c + 1.0) / (self.tokens + self.types + 1.0)


def fold(doc_id, folds: int, part: int) -> bool:
    """Whether the row is held out: crc32 of the id as text falls on ``part``."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == part


_SEEN = [f"s{r}" for r in range(1, K + 1)]
#: Sums of a part of a history; where ``h`` is null, of a shard: n-grams by count, 1 to K + 1, and in all.
_PARTS = f"h long, shard int, total long, {' long, '.join(_SEEN)} long, above long, mass double"


def score_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = 2, folds: int = 7, held: int = 2, block_bytes: int = X.BLOCK_BYTES, tables: str | None = None, split: int = SPLIT) -> DataFrame:
    """``df``'s columns and ``_held_out``, ``_n_tokens``, ``_n_known``, ``_train_tokens``, ``_base_score``, ``_score``.

    Learns from the rows that are not held out. ``tables``: folder for the model's tables; by default
    a fresh one in the shared folder."""
    carried = Carried(df)
    df, text, doc_id = carried.df, carried(text), carried(doc_id)
    spark = df.sparkSession
    blocks = X.Blocks(spark, df, text, block_bytes)
    tables = tables or storage.new_path(spark, "ngrams")
    shards = blocks.shards()
    reader = _Reader(text, doc_id, folds, held)
    reply = storage.materialise(_counted_words(blocks.ask(_ask_words(reader, shards)), f"{tables}/order=1"), "replies")
    replies = storage.paths()[-1]
    seen = reply.where("block < 0").select("payload").mapInArrow(_sum_stats, "r int, n long").groupBy("r").agg(F.sum("n").alias("n")).collect()
    seen = {x["r"]: x["n"] for x in seen}
    model, answers = Katz(seen.get(-1, 0), seen.get(-2, 0)), [blocks.keep(reply.where("block >= 0"))]
    storage.delete(spark, replies)
    for n in range(2, order + 1):
        work = storage.new_path(spark, "work")
        asks = blocks.ask(_ask_grams(reader, n, shards, model, split), answers)
        parts = storage.materialise(asks.groupBy("shard").applyInArrow(_count(n, model, f"{tables}/order={n}", work), _PARTS), "parts")
        of = parts.where("h IS NULL").agg(*(F.sum(c).alias(c) for c in (*_SEEN, "above", "total"))).first()
        model.run[n] = min(RUN, max(1, (of["total"] or 0) // (RUNS * shards)).bit_length() - 1)
        model.discounts[n] = good_turing(np.array([0, *(of[c] or 0 for c in (*_SEEN, "above"))]))
        reply = _weighed(parts, shards, _weigh(model.discounts[n], n < order, f"{tables}/histories/order={n}", work))
        answers.append(blocks.keep(reply.selectExpr("block", f"shard + {(n - 1) * shards} AS shard", "payload")))
        storage.delete(spark, work)
    _store_discounts(model, shards, tables)
    added = [("_held_out", T.BooleanType()), ("_n_tokens", T.LongType()), ("_n_known", T.LongType()), ("_train_tokens", T.LongType()), ("_base_score", T.DoubleType()), ("_score", T.DoubleType())]
    schema = T.StructType([*df.schema.fields, *(T.StructField(a, t) for a, t in added)])
    return carried.back(blocks.map(answers, _scores(reader, order, shards, model, split), schema), *(n for n, _ in added))


class _Reader:
    """Tokens of a block's rows as word hashes, one end a row."""

    def __init__(self, text: str, doc_id: str, folds: int, held: int):
        self.text, self.doc_id, self.folds, self.held = text, doc_id, folds, held

    def __call__(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each token, row of each token, whether each row is held out)"""
        hold()
        words = Words.of([encode(x) for x in rows[self.text].to_pylist()], lower=True)
        counts = words.counts + 1
        row = np.repeat(np.arange(len(counts)), counts)
        token = np.full(len(row), END, np.uint64)
        token[np.arange(len(words.hashes)) + np.repeat(np.arange(len(counts)), words.counts)] = words.hashes
        held = np.array([fold(x, self.folds, self.held) for x in rows[self.doc_id].to_pylist()], bool)
        return token, row, held


def _ask_words(reader: _Reader, shards: int):
    def ask(rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        token, row, held = reader(rows)
        keys, _, number = _distinct(token)
        counts = np.bincount(number, weights=~held[row], minlength=len(keys)).astype(np.int64)
        for s, at in X.slices(keys, shards):
            yield s, X.join_parts(X.pack_sorted(keys[at]), X.pack(counts[at]))

    return ask


def _order(x: np.ndarray) -> np.ndarray:
    """Places in order of value: values and places sorted as one number, which is much faster, where both fit in 64 bits."""
    n = len(x)
    if not n:
        return np.empty(0, np.int64)
    low = np.uint64((1 << max(1, (n - 1).bit_length())) - 1)
    if x.dtype == np.uint64:  # hashes: the high bits tell almost all apart
        both = (x & ~low) | np.arange(n, dtype=np.uint64)
    elif int(x.min()) >= 0 and int(x.max()) < (1 << 63) // (int(low) + 1):
        both = x.astype(np.uint64) * (low + np.uint64(1)) | np.arange(n, dtype=np.uint64)
    else:
        return np.argsort(x)
    both.sort()
    both &= low
    order = both.view(np.int64)
    ordered = x[order]
    return order if np.all(ordered[1:] >= ordered[:-1]) else np.argsort(x)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, a place of each, number of each occurrence's)"""
    order = _order(x)
    ordered = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


class _State:
    """What a block knows of its tokens after the answers of orders 1..n: probability at that order, and of the n-gram
    that ends at each token its number, count (0 if unseen, or if the text has too few tokens) and history's scale."""

    def __init__(self, reader: _Reader, rows: pa.Table, answers: dict[int, bytes], n: int, shards: int, model: Katz, split: int):
        self.token, self.row, self.held = reader(rows)
        keys, _, number = _distinct(self.token)
        counts, names = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for s, at in X.slices(keys, shards):
            count, rank = X.split_parts(answers[s])
            counts[at], names[at] = X.unpack(count), X.unpack(rank).astype(np.int64) * shards + s
        by_name = np.argsort(names)
        #: Numbers of the block's words in order, their counts, and the place there of each token.
        self.names, self.counts = names[by_name], counts[by_name]
        self.word = _places(by_name)[number]
        #: Likewise of the block's n-grams; the place of the n-gram that ends at each token, or -1.
        self.numbers, self.totals, self.gram = self.names, self.counts, self.word
        self.count = self.counts[self.word]
        self.known, self.scale = self.count > 0, np.full(len(self.token), model.unigram(0.0))
        self.p = model.unigram(self.count)
        for m in range(2, n + 1):
            self._extend(_Grams(self, m, shards, model, split), answers, (m - 1) * shards, model.discounts[m])

    def _extend(self, g: _Grams, answers: dict[int, bytes], first: int, d: np.ndarray) -> None:
        count, rank, alpha, cut = np.zeros(len(g.word), np.int64), np.zeros(len(g.word), np.int64), np.ones(len(g.word)), np.zeros(len(g.histories), bool)
        for s, e in g.by_shard():
            *known, given, mass = X.split_parts(answers[first + s])
            c, r, flags = map(X.unpack, known)
            count[e] = c
            if len(r):
                rank[e] = np.cumsum(r, dtype=np.int64) | s << RANK
            own = g.history[e][_starts(g.history[e])]
            cut[own] = np.unpackbits(flags, count=len(own))
            unseen = e[c == 0]
            alpha[unseen] = X.unpack_repeated(given) / (1 - g.scale[g.history[unseen]] * X.unpack_repeated(mass))
        scale = (1 - np.where(cut, 0.5 / g.total, 0.0)) / g.total
        self.numbers, self.totals, self.gram = rank, count, np.full(len(self.row), -1)
        self.count, self.scale = np.zeros(len(self.row), np.int64), np.zeros(len(self.row))
        self.gram[g.at], self.count[g.at], self.scale[g.at] = g.number, count[g.number], scale[g.history][g.number]
        c = self.count[g.at]
        self.p[g.at] = np.where(c > 0, d[np.minimum(c, K + 1)] * c * self.scale[g.at], alpha[g.number] * self.p[g.at])


class _Grams:
    """Distinct n-grams of a block whose history some training text has, by history and word; ``state`` is of order n - 1."""

    def __init__(self, state: _State, n: int, shards: int, model: Katz, split: int):
        row = state.row
        at = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) + n - 1 if len(row) >= n else np.empty(0, np.int64)
        #: Places of the tokens, and their n-gram.
        self.at = at[state.count[at - 1] > 0]
        before = state.gram[self.at - 1]
        used = _marked(before, len(state.numbers))
        used = used[_order(state.numbers[used])] if n > 2 else used
        history = _places(used, len(state.numbers))[before]
        self.histories, self.total = state.numbers[used], state.totals[used]
        self.scale = np.zeros(len(used))  # of the shorter history
        self.scale[history] = state.scale[self.at]
        wide = max(1, len(state.names))
        keys, self.first, self.number = _distinct(history * wide + state.word[self.at])
        self.history, self.word = np.divmod(keys, wide)
        self.parts = -(-self.total // split)
        self.shards = shards
        run = mix((self.histories >> model.run[n - 1]).astype(np.uint64))
        self.shard = (mix(run) % np.uint64(shards)).astype(np.int64)[self.history]
        dealt = np.flatnonzero((self.parts > 1)[self.history])
        of = self.history[dealt]
        part = mix(state.names[self.word[dealt]].astype(np.uint64)) % self.parts[of].astype(np.uint64)
        self.shard[dealt] = (mix(run[of] + part) % np.uint64(shards)).astype(np.int64)

    def by_shard(self) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, its n-grams by history and word)"""
        small = self.shard.astype(np.uint16) if self.shards <= 1 << 16 else self.shard
        order = np.argsort(small, kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(self.shard, minlength=self.shards))]
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            yield s, order[cuts[s] : cuts[s + 1]]


def _marked(x: np.ndarray, n: int) -> np.ndarray:
    """The distinct values of numbers below n, in order."""
    mark = np.zeros(n, bool)
    mark[x] = True
    return np.flatnonzero(mark)


def _places(values: np.ndarray, n: int | None = None) -> np.ndarray:
    """Where each number below n lies among distinct values."""
    out = np.empty(len(values) if n is None else n, np.int64)
    out[values] = np.arange(len(values))
    return out


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])


def history_terms(total, seen, d):
    """By history: what its seen words give up beyond their discounts, and all that is left for unseen ones."""
    kept = seen[:, :K] @ (d[1 : K + 1] * np.arange(1, K + 1)) + seen[:, K]
    with np.errstate(all="ignore"):
        cut = np.where((kept >= total) & (total > 0), 0.5 / total, 0.0)  # nothing was discounted: half a count goes
        return cut, np.where(total > 0, 1 - kept / total + cut, 1.0)


def katz_terms(count, history, total, seen, lower, d):
    """P(w | h) of seen n-grams (0 if unseen) and alpha(h), a value an n-gram.

    ``history``: number of each n-gram's history; by history: ``total`` c(h), ``seen`` continuations
    by count 1..K and (last column) the summed counts above K, ``lower`` their lower-order mass."""
    cut, left = history_terms(total, seen, d)
    t = total[history]
    with np.errstate(all="ignore"):
        alpha = np.where(total > 0, left / (1 - lower), 1.0)
        p = np.where(count > 0, d[np.minimum(count, K + 1)] * count / t * (1 - cut[history]), 0.0)
    return p, alpha[history]


def _ask_grams(reader: _Reader, n: int, shards: int, model: Katz, split: int):
    """By shard: histories (number, n-grams, parts), and of each n-gram the word, the block's count, and the count of what
    is left without its first word. Order 2: words are told once, with that count."""

    def ask(rows: pa.Table, answers: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        state = _State(reader, rows, answers, n - 1, shards, model, split)
        g = _Grams(state, n, shards, model, split)
        counts = np.bincount(g.number, weights=~state.held[state.row[g.at]], minlength=len(g.word)).astype(np.int64)
        lower = state.count[g.at][g.first]
        for s, e in g.by_shard():
            start = _starts(g.history[e])
            own = g.history[e][start]
            if n == 2:
                words = _marked(g.word[e], len(state.names))
                names, code, low = state.names[words], _places(words, len(state.names))[g.word[e]], state.counts[words]
            else:  # frequent words have low numbers, so that a number takes fewer bytes than a list and places there
                names, code, low = state.names[:0], state.names[g.word[e]], lower[e]
            sent = (np.diff(start, append=len(e)), g.parts[own], code, counts[e], low)
            yield s, X.join_parts(X.pack_steps(g.histories[own]), X.pack_steps(names), *(X.pack(X.narrow(x)) for x in sent))

    return ask


def _counted_words(asks: DataFrame, path: str) -> DataFrame:
    """Answers of order 1 (count and rank: frequent words first), and statistics as rows of block -1. The shard's words are stored below ``path`` by the same task."""

    def per_shard(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        out, stats, stored = _merge_words(table["payload"].to_pylist())
        _store(f"{path}/shard={shard}/counts.parquet", stored)
        give_back()
        return pa.table({"block": pa.array([*table["block"].to_pylist(), -1], pa.int64()), "shard": pa.array([shard] * (len(out) + 1), pa.int32()), "payload": pa.array([*out, X.pack(stats)], pa.binary())})

    return asks.groupBy("shard").applyInArrow(per_shard, X.ASK)


def _store(path: str, table: pa.Table) -> None:
    """One Parquet file, written whole and then renamed: a repeated task replaces it by the same rows."""
    import pyarrow.parquet as pq

    coded = dict.fromkeys(("history", "word", "rank"), "DELTA_BINARY_PACKED")
    signed = table.cast(pa.schema([(f.name, f.type if pa.types.is_floating(f.type) else pa.int64()) for f in table.schema]), safe=False)
    with _replacing(path) as out:
        pq.write_table(signed, out, compression="zstd", use_dictionary=[c for c in ("count", "total", "half", "given", "mass") if c in table.column_names], column_encoding={c: e for c, e in coded.items() if c in table.column_names})


@contextlib.contextmanager
def _replacing(path: str):
    """A stream to a file that takes the name only when it is whole."""
    fs, target = storage.filesystem(path)
    folder, name = target.rsplit("/", 1)
    fs.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        yield out
    fs.move(temporary, target)


def _read(path: str) -> bytes:
    fs, source = storage.filesystem(path)
    with fs.open_input_stream(source) as stream:
        return stream.read()


def _store_discounts(model: Katz, shards: int, tables: str) -> None:
    """The few numbers that are not in the tables: tokens, types, shards, and discounts by order and count."""
    facts = [{"order": 1, "r": r, "value": float(x)} for r, x in enumerate((model.tokens, model.types, shards))]
    facts += [{"order": n, "r": r, "value": float(x)} for n, d in model.discounts.items() for r, x in enumerate(d)]
    import pyarrow.parquet as pq

    with _replacing(f"{tables}/facts/facts.parquet") as out:
        pq.write_table(pa.Table.from_pylist(facts, pa.schema([("order", pa.int64()), ("r", pa.int64()), ("value", pa.float64())])), out)


def _merge_words(payloads: list[bytes]) -> tuple[list[bytes], np.ndarray, pa.Table]:
    parts = [X.split_parts(x) for x in payloads]
    keys = [X.unpack_sorted(a) for a, _ in parts]
    every, number = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(number, weights=np.concatenate([X.unpack(b) for _, b in parts]), minlength=len(every)).astype(np.int64)
    own = np.split(number, np.cumsum([len(k) for k in keys])[:-1])
    rank = _places(np.argsort(-total, kind="stable"))
    out = [X.join_parts(X.pack(X.narrow(total[k])), X.pack(X.narrow(rank[k]))) for k in own]
    seen = total > 0
    stats = np.array([[-1, total.sum()], [-2, seen.sum()]], np.int64)
    return out, stats.ravel(), pa.table({"word": every[seen], "rank": rank[seen], "count": total[seen]})


def _count(n: int, model: Katz, path: str, work: str):
    """Sums a shard's n-grams and stores them; what weighing needs goes to a file. Returns sums of parts of split histories."""

    def per_shard(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        hold()
        histories, each, word, count, lower, parts, lengths = [], [], [], [], [], [], []
        for raw in table["payload"].to_pylist():
            h, w, per, part, code, c, low = map(X.unpack, X.split_parts(raw))
            low = (low[code] if n == 2 else low).astype(np.int64)
            below = low + 1.0 if n == 2 else model.discounts[n - 1][np.minimum(low, K + 1)] * low
            histories.append(np.cumsum(h, dtype=np.int64))
            each.append(per.astype(np.int64))
            parts.append(part.astype(np.int64))
            word.append((np.cumsum(w, dtype=np.int64)[code] if n == 2 else code).astype(np.int64))
            count.append(c.astype(np.int64))
            lower.append(below)
            lengths.append(len(code))
        known, one, number = _distinct(np.concatenate(histories))
        parts = np.concatenate(parts)[one]
        named, _, place = _distinct(np.concatenate(word))
        keys, _, own = _distinct(np.repeat(number, np.concatenate(each)) * len(named) + place)
        if len(keys) >> RANK:
            raise ValueError(f"a shard has more than 2 ** {RANK} n-grams")
        history, w = np.divmod(keys, len(named))
        count, lower = np.concatenate(count), np.concatenate(lower)
        total = np.bincount(own, weights=count, minlength=len(keys)).astype(np.int64)
        below = np.zeros(len(keys))
        below[own[count > 0]] = lower[count > 0]
        sums = lambda x: np.bincount(history, weights=x, minlength=len(known))
        c_h = sums(total).astype(np.int64)
        seen = np.stack([*(sums(total == r) for r in range(1, K + 1)), sums(np.where(total > K, total, 0))], 1).astype(np.int64)
        mass = sums(below)
        rank = np.flatnonzero(total > 0)
        _store(f"{path}/shard={shard}/counts.parquet", pa.table({"history": known[history[rank]], "word": named[w[rank]], "rank": rank, "count": total[rank]}))
        blocks = [X.pack_steps(x) for x in np.split(own, np.cumsum(lengths)[:-1])]
        with _replacing(f"{work}/{shard}") as out:
            facts = (np.diff(_starts(history), append=len(history)), total, c_h, *seen.T)
            out.write(X.join_parts(X.pack_steps(known), X.pack_repeated(mass), X.pack(np.array(table["block"].to_pylist(), np.int64)), *(X.pack(X.narrow(x)) for x in facts), *blocks))
        give_back()
        split = np.flatnonzero(parts > 1)
        columns = {"h": pa.array([*known[split].tolist(), None], pa.int64()), "shard": pa.array([shard] * (len(split) + 1), pa.int32()), "total": pa.array(np.r_[c_h[split], len(rank)])}
        columns |= {c: pa.array(np.r_[seen[split, r], (total == r + 1).sum()]) for r, c in enumerate(_SEEN)}
        columns |= {"above": pa.array(np.r_[seen[split, K], (total == K + 1).sum()]), "mass": pa.array(np.r_[mass[split], 0.0])}
        return pa.table(columns)

    return per_shard


def _weighed(parts: DataFrame, shards: int, weigh) -> DataFrame:
    """Each shard weighed, given the sums over all parts of its split histories; the least shard stores a history's weight."""
    of_parts = [*_SEEN, "above", "mass", "total"]
    split = parts.where("h IS NOT NULL")
    whole = split.groupBy("h").agg(*(F.sum(c).alias(c) for c in of_parts), F.min("shard").alias("owner"))
    given = split.select("h", "shard").join(whole, "h").unionByName(parts.where("h IS NULL").withColumn("owner", F.col("shard")))
    return given.repartition(shards, "shard").groupBy("shard").applyInArrow(weigh, X.ASK)


def _weigh(d: np.ndarray, numbered: bool, path: str, work: str):
    """Stores a shard's back-off weights and answers its blocks: count, rank (if numbered) of each n-gram; whether each
    history's seen words gave up half a count; the back-off weight of the unseen n-grams.

    A weight alpha(h) = given / (1 - scale * mass) is stored as ``given``, what seen words leave, and ``mass``, the seen
    words' discounted lower-order counts: numbers that repeat, and so take few bytes. ``scale``, of the shorter
    history, is what turns its discounted counts into probabilities: (1 - half / (2 total)) / total there."""

    def per_shard(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        hold()
        known, mass, blocks, *facts = X.split_parts(_read(f"{work}/{shard}"))
        known, mass, blocks, own = X.unpack_steps(known), X.unpack_repeated(mass), X.unpack(blocks), facts[K + 4 :]
        per, total, c_h, *seen = (X.unpack(x).astype(np.int64) for x in facts[: K + 4])
        seen = np.stack(seen, 1)
        stored = np.ones(len(known), bool)
        for x in (x for x in table.to_pylist() if x["h"] is not None):
            k = np.searchsorted(known, x["h"])
            c_h[k], seen[k], mass[k], stored[k] = x["total"], [x[c] for c in (*_SEEN, "above")], x["mass"], x["owner"] == shard
        cut, left = history_terms(c_h, seen, d)
        stored &= c_h > 0
        _store(f"{path}/shard={shard}/weights.parquet", pa.table({"history": known[stored], "total": c_h[stored], "half": (cut > 0).astype(np.int64)[stored], "given": left[stored], "mass": mass[stored]}))
        history = np.repeat(np.arange(len(known)), per)
        out = []
        for raw in own:
            rank = X.unpack(raw)
            at = np.cumsum(rank, dtype=np.int64)
            of = history[at]
            count = total[at]
            unseen = of[count == 0]
            out.append(X.join_parts(X.pack(X.narrow(count)), X.pack(rank if numbered else rank[:0]), X.pack(np.packbits(cut[of[_starts(of)]] > 0)), X.pack_repeated(left[unseen]), X.pack_repeated(mass[unseen])))
        give_back()
        return pa.table({"block": pa.array(blocks), "shard": pa.array([shard] * len(out), pa.int32()), "payload": pa.array(out, pa.binary())})

    return per_shard


def _sum_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("payload").to_pylist():
            pairs = X.unpack(raw).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int32)), pa.array(pairs[:, 1])], names=["r", "n"])


def _scores(reader: _Reader, order: int, shards: int, model: Katz, split: int) -> Callable:
    def use(rows: pa.Table, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        state = _State(reader, rows, answers, order, shards, model, split)
        n = rows.num_rows
        sums = lambda x: np.bincount(state.row, weights=x, minlength=n)
        base, score = sums(np.log10(model.unigram(state.counts[state.word]))), sums(np.log10(state.p))
        tokens, known = sums(np.ones(len(state.row))).astype(np.int64), sums(state.known).astype(np.int64)
        columns = [*rows.combine_chunks().itercolumns(), pa.array(state.held), pa.array(tokens), pa.array(known), pa.array(np.full(n, model.tokens, np.int64)), pa.array(base), pa.array(score)]
        names = [*rows.column_names, "_held_out", "_n_tokens", "_n_known", "_train_tokens", "_base_score", "_score"]
        for batch in pa.table(columns, names=names).to_batches(max_chunksize=500):
            yield batch

    return use


def score_by_tables(df: DataFrame, tables: str, text: str = "text", order: int = 2) -> DataFrame:
    """``df``'s columns and ``_n_tokens`` and ``_score``, by a model's tables alone (of ``score_documents``): plain joins.

    For any texts, whether the model knows them or not; null or empty text is one end token."""
    spark, carried = df.sparkSession, Carried(df)
    facts = {(x["order"], x["r"]): x["value"] for x in spark.read.parquet(f"{tables}/facts").collect()}
    tokens, types, shards = (facts[1, r] for r in range(3))
    text = carried(text)
    rows = storage.materialise(carried.df.withColumn("_row", F.monotonically_increasing_id()), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                batch = whole.slice(i, 200)
                token, row, _ = _Reader("text", "row", 1, 1)(pa.table({"text": batch.column(0), "row": batch.column(1)}))
                at = np.arange(len(row)) - np.r_[0, np.flatnonzero(np.diff(row)) + 1][row] if len(row) else row
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row)), pa.array(at), pa.array(token.view(np.int64))], names=["_row", "at", "token"])

    number = F.shiftleft(F.col("shard").cast("long"), RANK) + F.col("rank")
    of_words = spark.read.parquet(f"{tables}/order=1").select(F.col("word").alias("token"), (F.col("rank") * int(shards) + F.col("shard").cast("long")).alias("w"), F.col("count").alias("c"))
    now = rows.select(text, "_row").mapInArrow(lean(run), "_row long, at long, token long").join(of_words, "token", "left")
    one = 1 / (tokens + types + 1)
    now = now.withColumns({"p": (F.coalesce("c", F.lit(0)) + 1) * one, "g": F.col("w"), "scale": F.lit(one)}).select("_row", "at", "w", "g", "p", "scale")
    before = W.partitionBy("_row").orderBy("at")
    for n in range(2, order + 1):
        seen = spark.read.parquet(f"{tables}/order={n}").select(F.col("history").alias("h"), F.col("word").alias("w"), number.alias("g"), F.col("count").alias("c"))
        weights = spark.read.parquet(f"{tables}/histories/order={n}").select(F.col("history").alias("h"), "given", "mass", ((1 - F.col("half") / (2 * F.col("total"))) / F.col("total")).alias("own"))
        now = now.withColumn("h", F.lag("g").over(before)).drop("g").join(seen, ["h", "w"], "left").join(weights, "h", "left")
        kept = F.element_at(F.array(*(F.lit(facts[n, r]) for r in range(K + 2))), (F.least("c", F.lit(K + 1)) + 1).cast("int")) * F.col("c") * F.col("own")
        backed = F.col("given") / (1 - F.col("scale") * F.col("mass")) * F.col("p")
        now = now.select("_row", "at", "w", "g", F.coalesce(kept, backed, F.col("p")).alias("p"), F.col("own").alias("scale"))
    sums = now.groupBy("_row").agg(F.count("*").alias("_n_tokens"), F.sum(F.log10("p")).alias("_score"))
    return carried.back(rows.join(sums, "_row"), "_n_tokens", "_score")
