import random
import zlib

import numpy as np
import pytest

from loquat.llm import packing, records

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = ["", " a", "a ", "a  b", "a\n b\n\n c", "it's 's 'S ünïcode", "ẍ ̈y", "ΑΣ ΑΣ. Σ", "don't  stop\t\tnow", "<|endoftext|> hi", "　z q", "12 345 6,7", "ﬁ İ", "word " * 5000, None]


def reference(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for x in texts]


def documents(seed=0):
    rng = random.Random(seed)
    made = [" ".join(rng.choices("the cat sat on a mat, quickly; Éa 12 !! | x".split(), k=rng.randrange(0, 300))) for _ in range(150)]
    return [(i * 3, t) for i, t in enumerate(TEXTS + made)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunked_ids_equal_whole_text_ids(name):
    from loquat.llm.tokens import Encoder

    encoder = Encoder(public_tokenizers.path(name), 1, limit=50)
    texts = [t for _, t in documents()]
    assert encoder.encode(texts) == reference(name, texts)
    assert encoder.encode(texts[::-1]) == reference(name, texts[::-1])


def test_records_round_trip(spark, tmp_path):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    path = f"file://{tmp_path}/records"
    manifest = records.write_records(df, path, public_tokenizers.path("word_bpe_49k.json")).collect()
    want = reference("word_bpe_49k.json", [t for _, t in docs])
    starts = np.cumsum([0, *(len(x) // 4 for x in want)]).tolist()
    got = {r.doc_id: (r.start, r.n_tokens, bytes(r.ids)) for r in records.read_records(spark, path).collect()}
    assert got == {i: (s, len(x) // 4, x) for (i, _), s, x in zip(docs, starts, want)}
    first = min(manifest, key=lambda m: m.shard)
    assert records.read_at(path, first.file, 1) == (docs[1][0], starts[1], want[1])
    with pytest.raises(IndexError):
        records.read_at(path, first.file, first.records)


def test_damage_is_noticed():
    import io

    good = records.frame(records.serialize(-7, b"\1\0\0\0\2\0\0\0", True))
    assert records.deserialize(records.read_frame(io.BytesIO(good))) == (-7, b"\1\0\0\0\2\0\0\0")
    assert records.deserialize(records.serialize(None, b"\0\0\1\0", False)) == (None, b"\0\0\1\0")
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(records.CorruptRecord):
            records.read_frame(io.BytesIO(bytes(bad)))
    with pytest.raises(records.CorruptRecord):
        records.read_frame(io.BytesIO(good[:-2]))


def test_null_and_repeated_ids_and_empty_tables(spark, tmp_path):
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(None, "b", 1), (2, "b", 2), (2, "a", 3), (None, None, 4)], "doc_id long, text string, start int")
    records.write_records(df, f"file://{tmp_path}/a", tokenizer)
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in records.read_records(spark, f"file://{tmp_path}/a").collect())
    assert rows == [(0, None, 1), (1, None, 2), (3, 2, 2), (5, 2, 2)]
    records.write_records(df.limit(0), f"file://{tmp_path}/b", tokenizer)
    assert records.read_records(spark, f"file://{tmp_path}/b").collect() == []


def test_packing_places_every_token_once(spark):
    docs = documents(1)
    df = spark.createDataFrame([*docs, (None, "x y")], "doc_id long, text string").repartition(3)
    want = dict(zip([*(i for i, _ in docs), None], reference("byte_bpe_50k.json", [*(t for _, t in docs), "x y"])))
    pieces = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), capacity=256, pool_tokens=3000).collect()
    texts, sequences = {}, {}
    for p in pieces:
        texts.setdefault(p.doc_id, []).append((p.start, p.length, bytes(p.ids)))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert p.doc_tokens == len(want[p.doc_id]) // 4 and len(p.ids) == 4 * p.length
    assert {i: b"".join(x for _, _, x in sorted(v)) for i, v in texts.items()} == want
    padding = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding == 0


def test_descending_pieces_go_to_the_cheapest_sequence_with_room():
    full, left = packing.pack_pool([6, 5, 4, 3, 2], 10)
    assert full == [[(0, 0, 6), (3, 0, 3), (4, 1, 1)], [(1, 0, 5), (2, 0, 4), (4, 0, 1)]] and left == []
    assert [sum(n for _, _, n in s) for s in packing.powers([(0, 0, 7), (1, 2, 4)])] == [8, 2, 1]


def test_packing_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json")).collect() == []
    assert zlib.crc32(b"") == 0


def library(name, texts):
    """Ids by the library as it is, end id appended."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for x in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_special_strings_become_ids_where_asked(name):
    from tokenizers import Tokenizer

    from loquat.llm.tokens import Encoder

    texts = ["<|endoftext|>", "a<|endoftext|>b", "x <|endoftext|> y", " <|startoftext|>A.", "<|ENDOFTEXT|> no", "<|endoftext|><|endoftext|>\n\n!", "it is <|endoftext", "İ. <|endoftext|>", *TEXTS]
    assert Encoder(public_tokenizers.path(name), 1, specials=True).encode(texts) == library(name, texts)
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    assert Encoder(public_tokenizers.path(name), 1).encode(texts) == [np.array([*plain.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for x in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_code_point_with_signs_around_it(name):
    """Each code point after, before and between letters, signs and spaces; then random mixtures of the odd ones."""
    import sys
    import unicodedata

    from loquat.llm.tokens import Encoder

    points = [chr(k) for k in range(sys.maxunicode + 1) if not 0xD800 <= k < 0xE000 and (k < 0x30000 or k % 97 == 0)]
    texts = [f"{c}. a{c}! {c} {c}b, A{c}" for c in points]
    assert Encoder(public_tokenizers.path(name), 1, specials=True).encode(texts) == library(name, texts)
    odd = [c for c in points if len(c.lower()) > 1 or unicodedata.normalize("NFC", c) != c or unicodedata.category(c) in ("Mn", "Lm", "Nl", "Zs", "Zl", "Cc") or c.isspace()]
    rng = random.Random(4)
    mixed = ["".join(rng.choice(odd) if rng.random() < 0.4 else rng.choice("aZé .,'!-\n9ßİ") for _ in range(rng.randrange(1, 14))) for _ in range(100_000)]
    assert Encoder(public_tokenizers.path(name), 1, limit=20_000, specials=True).encode(mixed) == library(name, mixed)
