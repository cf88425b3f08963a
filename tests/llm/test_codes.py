"""Vector codes against plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loquat.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts, entries, rounds, scale=1024):
    """({row number: (code, error)}, codebooks) of [(id, vector, label)], all in Python integers."""
    length = None
    kept = []
    for k, (i, v, _) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[1][1] or [])):
        if v and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(scale * float(np.float32(x))) for x in v]
            length = length or len(v)
            if len(v) == length:
                kept.append((k, v))
    if not kept:
        return {}, []
    w = length // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v in kept[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((gap(cut(v, p), c), j) for j, c in enumerate(books[p]))
    for _ in range(rounds):
        fresh = []
        for p in range(parts):
            mine = {}
            for _, v in kept:
                mine.setdefault(near(v, p)[1], []).append(cut(v, p))
            fresh.append([[sum(x) // len(x) for x in zip(*mine[j])] if j in mine else c for j, c in enumerate(books[p])])
        books = fresh
    return {k: ([near(v, p)[1] for p in range(parts)], sum(near(v, p)[0] for p in range(parts))) for k, v in kept}, books


def held(spark, rows, entries, rounds, parts=4):
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA + ", k int").repartition(3)
    books = codes.train(df, entries=entries, rounds=rounds, parts=parts)
    want, entries_ = plain(rows, parts, entries, rounds)
    assert books.entries.tolist() == entries_ or not entries_
    got = codes.encode(df, books).collect()
    assert {r["k"]: (r["_code"], r["_error"]) for r in got} == want and len(got) == len(want)
    return df, books, want


def test_equals_plain_integers_with_odd_rows(spark):
    rng = random.Random(3)
    vector = lambda n=8: [rng.choice([rng.gauss(0, 1), rng.gauss(0, 40), 0.25, -0.25]) for _ in range(n)]
    rows = [(k, vector(), rng.choice([0, 1, None])) for k in range(150)]
    rows += [(k, rows[k][1], 2) for k in range(40)]  # repeated ids and vectors
    rows += [(None, vector(), 1), (None, vector(), None), (-5, None, 1), (-4, [], 1), (-3, [1.0, None] * 4, 1), (-2, [math.nan] * 8, 0), (-1, [math.inf] * 8, 0), (999, vector(6), 1)]
    held(spark, rows, 16, 3)


def test_ties_go_to_the_lower_index_and_unused_entries_stay(spark):
    rows = [(k, [float(k % 3)] * 4, 0) for k in range(30)]  # nine of the twelve entries repeat others
    _, books, _ = held(spark, rows, 12, 2)
    assert books.entries[0, 3].tolist() == [0]
    rows = [(k, [x / 1024] * 4, 0) for k, x in enumerate([0, 4, 2, 2, 2])]
    _, _, want = held(spark, rows, 2, 0)  # 2 is as far from 0 as from 4
    assert want[2] == ([0] * 4, 16)


def test_screening_alone_would_err():
    """Entries that differ by one in the last place, far from zero: float32 products cannot tell them."""
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 23), 1 << 23, 16)
    entries = base + rng.integers(-2, 3, (256, 16))
    x = base + rng.integers(-2, 3, (500, 16))
    book = codes._Book(entries)
    index, error, measured = book.nearest(x)
    gaps = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert (index == gaps.argmin(1)).all() and (error == gaps.min(1)).all()
    screen = (book.half - x.astype(np.float32) @ book.turned).argmin(1)
    assert (screen != index).mean() > 0.5 and measured == 500 * 256
    # Ordinary vectors: hardly more than one entry each is measured.
    x, entries = rng.integers(-400, 400, (3000, 16)), rng.integers(-400, 400, (256, 16))
    index, error, measured = codes._Book(entries).nearest(x)
    gaps = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert (index == gaps.argmin(1)).all() and (error == gaps.min(1)).all() and measured < 3300


def test_intervals_hold_the_true_values():
    rng = np.random.default_rng(2)
    for size in (10, 1000, 1 << 23):
        for d in (1, 16, 192):
            x, c = rng.integers(-size, size + 1, (50, d)), rng.integers(-size, size + 1, (256, d))
            book = codes._Book(c)
            screen = (book.half - x.astype(np.float32) @ book.turned).astype(np.float64)
            true = [[(sum(int(b) ** 2 for b in cj) - 2 * sum(int(a) * int(b) for a, b in zip(xi, cj))) / 2 for cj in c[:40]] for xi in x]
            width = codes.entry_width(d) * (np.sqrt((x * x).sum(1)) * book.longest + book.most)
            assert (np.abs(screen[:, :40] - true) <= width[:, None]).all()


def test_label_sums_digest_and_decoding(spark):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)], rng.choice([0, 1, None, None])) for k in range(60)]
    df, books, want = held(spark, rows, 8, 2)
    sums = {}
    for k, (_, error) in want.items():
        sums[rows[k][2]] = sums.get(rows[k][2], 0) + error
    out = codes.group_errors(codes.encode(df, books))
    assert {r["k"]: r["_label_error"] for r in out.collect()} == {k: sums[rows[k][2]] for k in want}
    text = ",".join(str(x) for book in books.entries.tolist() for entry in book for x in entry)
    assert books.digest() == hashlib.sha256(text.encode()).hexdigest()
    near = books.decode(np.array([c for c, _ in want.values()]))
    assert np.abs(near - np.array([rows[k][1] for k in want])).max() < 4


def test_empty_tables_clashing_columns_and_errors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    books = codes.train(empty)
    out = codes.group_errors(codes.encode(empty, books))
    assert out.collect() == [] and out.columns == ["vec_id", "embedding", "label", "_code", "_error", "_label_error"]
    assert books.digest() == hashlib.sha256(b"").hexdigest()
    rows = spark.createDataFrame([(k, [0.5 * k] * 4, 7) for k in range(5)], SCHEMA)
    clash = rows.withColumns({c: F.lit(i) for i, c in enumerate(["_code", "_error", "_label", "_z", "_v", "_id", "entry", "c0", "n", "_label_error"])})
    out = codes.group_errors(codes.encode(clash, codes.train(clash)))
    assert out.columns[-3:] == ["_code", "_error", "_label_error"] and len({c.lower() for c in out.columns}) == len(out.columns)
    assert out.count() == 5 and {r["entry"] for r in out.collect()} == {6}
    with pytest.raises(ValueError):
        codes.train(spark.createDataFrame([(1, [1.0] * 6, 0)], SCHEMA))
    with pytest.raises(Exception, match="or more in size"):
        codes.train(spark.createDataFrame([(1, [1e9] * 4, 0)], SCHEMA))
