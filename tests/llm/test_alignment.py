"""Alignment of two tokenizers' tokens against plain loops over the libraries' own tokens."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loquat.llm import alignment

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """([(A id, bytes)], [(B id, bytes)]) or two empty lists."""
    if not text:
        return [], []
    a, b = libraries
    raw = (" " + text).encode()
    found = a.encode(" " + text, add_special_tokens=False)
    ours, theirs = [(k, bytes(BYTES[c] for c in a.id_to_token(k))) for k in found.ids], []
    for k in b.encode(text):
        name = b.id_to_piece(k)
        theirs.append((k, bytes([int(name[1:-1], 16)]) if b.is_byte(k) else name.replace("▁", " ").encode()))
    same = b"".join(x for _, x in ours) == raw == b"".join(x for _, x in theirs)
    return (ours, theirs) if same else ([], [])


def _byte_names():
    """The published table of byte-level tokenizers."""
    shown = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    names, n = {}, 0
    for x in range(256):
        if x in shown:
            names[chr(x)] = x
        else:
            names[chr(256 + n)] = x
            n += 1
    return names


BYTES = _byte_names()


def ends(sequence):
    out, at = [], 0
    for _, x in sequence:
        at += len(x)
        out.append(at)
    return out


def brute(libraries, docs):
    """{row number: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)}"""
    cut, counts = {}, Counter()
    for k, (_, text) in enumerate(docs):
        a, b = tokens(libraries, text)
        ea, eb = ends(a), ends(b)
        at_b = dict(zip(eb, (i for i, _ in b)))
        links = [(i, at_b[x]) for x, (i, _) in zip(ea, a) if x in at_b]
        groups, start = [], 0
        for end in sorted(set(ea) & set(eb)):
            inside = lambda e: start < e <= end  # noqa: B023, E731
            groups.append(",".join(str(t[0]) for t, e in zip(a, ea) if inside(e)) + "|" + ",".join(str(t[0]) for t, e in zip(b, eb) if inside(e)))
            start = end
        cut[k] = (len(a), len(b), links, ";".join(groups))
        counts.update(links)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return {k: (na, nb, len(x), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), g) for k, (na, nb, x, g) in cut.items()}


def odd_docs():
    rng = random.Random(11)
    parts = ["hello", "world", "naïve", "été", "日本語", "🙂🙂", "é", "▁", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "\x00", "﻿", "　", "\xa0", "1234567", "...", "'s", "I'll", "DON'T", "aaaaaaaaaa", "\r\n", "\t", "  ", "   ", "\n\n", "x=1;", "ﬁ", "Ω"]
    docs = [(k, rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))) for k in range(250)]
    docs += [(1, "hello world"), (1, "hello world"), (None, "hello world"), (300, None), (301, ""), (302, " "), (303, "\n"), (304, "▁"), (305, "a▁b"), (306, " a"), (307, "a ")]
    docs += [(400, " ".join(rng.choice(parts[:6]) for _ in range(4000)))]
    return docs


def result(df):
    return {r["k"]: tuple(r[c] for c in alignment.ADDED) for r in df.collect()}


def test_equals_plain_loops(spark, libraries):
    docs = odd_docs()
    rows = [(*d, k) for k, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(5)
    want = brute(libraries, docs)
    got = result(alignment.align(df, A, B))
    assert got == want
    assert sum(v[0] == 0 for v in want.values()) > 20 and sum(v[0] > 0 for v in want.values()) > 100


def test_groups_hold_all_tokens_and_end_together(spark, libraries):
    docs = [d for d in odd_docs() if d[0] is not None]
    for _, _, text, groups in alignment.align(spark.createDataFrame([(k, k, t, t) for k, (_, t) in enumerate(docs)], "k int, id long, copy string, text string"), A, B).select("k", "id", "copy", "_groups").collect():
        a, b = tokens(libraries, text)
        cut = [g.split("|") for g in groups.split(";")] if groups else []
        assert ",".join(x for x, _ in cut) == ",".join(str(k) for k, _ in a) and ",".join(x for _, x in cut) == ",".join(str(k) for k, _ in b)


def test_a_long_text_and_many_copies(spark, libraries):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma,", "delta.", "épsilon", "zeta\n"]
    long = " ".join(rng.choices(words, k=150_000))
    df = spark.createDataFrame([(1, long, 0)] + [(2, "alpha beta", k + 1) for k in range(300)], "doc_id long, text string, k int").repartition(4)
    got = result(alignment.align(df, A, B))
    a, b = tokens(libraries, long)
    assert got[0][:3] == (len(a), len(b), len(set(ends(a)) & set(ends(b))))
    assert len({got[k] for k in range(1, 301)}) == 1 and got[1][5] > 600


def test_empty_table_and_clashing_columns(spark):
    clash = ["_n_a", "_groups", "_ids", "block", "shard", "payload", "k", "c0", "c9", "_N_B"]
    for docs in ([], [(1, "hello world"), (2, None)]):
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(i) for i, c in enumerate(clash)})
        out = alignment.align(df, A, B)
        assert out.columns == ["doc_id", "_n_a_in", "_groups_in", "_ids", "block", "shard", "payload", "k", "c0", "c9", "_N_B_in", *alignment.ADDED]
        assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, _ in docs)
        assert all(r["shard"] == 4 and r["_groups_in"] == 1 for r in out.collect())


def test_unmix_and_overlaps():
    x = np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert (alignment.unmix(alignment.mix(x.copy())) == x).all()
    rng = random.Random(2)
    cuts = lambda: np.array(sorted({*rng.sample(range(1, 60), 20), 60}))
    for _ in range(50):
        a, b = cuts(), cuts()
        a_start, b_start = np.r_[0, a[:-1]], np.r_[0, b[:-1]]
        first, last = alignment.overlaps(a, b)
        for k in range(len(a)):
            assert list(range(first[k], last[k] + 1)) == [j for j in range(len(b)) if b_start[j] < a[k] and a_start[k] < b[j]]
