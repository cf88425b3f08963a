import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loquat.llm import decontaminate, licenses, line_rules, ordinal, toxicity
from tests.llm import brute


def frame(spark, docs, more=""):
    return spark.createDataFrame(docs, f"doc_id long, text string{more}").repartition(3)


# Line rules


def lines_corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(80)] + ["naïve", "#tag", "50%", "a|b"]
    stock = ["All Rights  reserved here", "read more on this site", "x y"]
    docs = []
    for i in range(150):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 12))) for _ in range(rng.randrange(0, 10))]
        lines += rng.choices(stock, k=rng.randrange(0, 4)) + ([lines[0]] * 2 if lines and i % 9 == 0 else [])
        rng.shuffle(lines)
        docs.append((i, "\n".join(x.upper() if rng.random() < 0.1 else x for x in lines), f"s{i % 4}" if i % 10 else None))
    return docs + [(900, None, "s1"), (901, "", "s1"), (902, " \n\t\n", None), (900, "x y\nx y\nx y", "s1"), (None, "x y " * 30, "s2")]


def plain_line_rules(docs, max_docs, min_share, min_words):
    norm = lambda x: " ".join(brute.words(brute.lower(x)))
    count = {}
    for k, (_, t, s) in enumerate(docs):
        for x in (t or "").split("\n"):
            if brute.words(x):
                count.setdefault((s, norm(x)), set()).add(k)
    out = []
    for i, t, s in docs:
        w, lines = brute.words(t), [x for x in (t or "").split("\n") if brute.words(x)]
        removed = sum(len(brute.words(x)) for x in lines if len(count[s, norm(x)]) > max_docs)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        repeat = {j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(k, k + 3)}
        failed = len(w) < min_words or 100 * len(repeat) > 50 * len(w)
        kept = not failed and len(w) - removed >= min_share * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeat), removed, failed, kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1, 1500, 8 << 20])
def test_line_rules_match_brute_force(spark, block_bytes):
    docs = lines_corpus()
    rows = line_rules.apply_line_rules(frame(spark, docs, ", source string"), max_docs=8, min_share=0.8, min_words=10, block_bytes=block_bytes).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")
    assert sorted(((r.doc_id, *(r[f"_{c}"] for c in names)) for r in rows), key=repr) == plain_line_rules(docs, 8, 0.8, 10)


def test_removed_lines_leave_the_text(spark):
    docs = [(i, f"own line {i}\nStock  LINE\n\nend {i}", "a") for i in range(4)] + [(9, "stock line\nalone", "b"), (10, None, "b")]
    rows = {r.doc_id: r._text for r in line_rules.apply_line_rules(frame(spark, docs, ", source string"), max_docs=3, cleaned=True).collect()}
    assert rows[0] == "own line 0\n\nend 0" and rows[9] == "stock line\nalone" and rows[10] is None


def test_line_rules_on_an_empty_table(spark):
    assert line_rules.apply_line_rules(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


# Decontamination


def plain_hits(docs, items, size):
    words = lambda t: "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in brute.lower(t)).split(" ")
    clean = lambda t: [x for x in words(t) if x]
    patterns = {}
    for i, t in items:
        w = clean(t)
        for k in range(max(0, len(w) - size + 1) or bool(w)):
            if i is not None:
                patterns.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = clean(t), set(), set()
        for n in {len(p) for p in patterns}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in patterns:
                    hit |= set(range(k, k + n))
                    found |= patterns[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(found, key=str)))
    return sorted(out, key=repr)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "x9"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9))) + "?") for k in range(25)] + [(3, "w1 w2"), (None, "w1"), (77, None), (78, "!!!"), (100, "W1, w2; w3")]
    docs = [(k, rng.choice([" ", ", ", "--"]).join(rng.choices(vocabulary + ["zz"], k=rng.randrange(0, 40)))) for k in range(80)] + [(200, None), (201, ""), (202, "..."), (5, "w1 w2")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for most in (8_000_000, 20):  # one automaton, or many parts
        rows = decontaminate.find_contamination(frame(spark, docs), table, size=4, max_chars=most).collect()
        assert sorted(((r.doc_id, r._n_words, r._n_hit, r._items) for r in rows), key=repr) == plain_hits(docs, items, 4)


def test_spans_are_offsets_of_the_original(spark):
    text = "Ünder — Alpha, BETA; gamma!  rest alpha"
    row = decontaminate.find_contamination(frame(spark, [(1, text)]), spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"), size=3).first()
    assert [text.encode()[s.start : s.end].decode() for s in row._spans] == ["Alpha, BETA; gamma"]


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(frame(spark, [(1, "a b")]), none).first()._n_hit == 0
    assert decontaminate.find_contamination(spark.createDataFrame([], "doc_id long, text string, _x int"), none).collect() == []


# Licences


def test_licenses_match_brute_force(spark):
    rng = random.Random(2)
    templates = dict(licenses.TEMPLATES) | {"own": " ".join(f"t{k}" for k in range(70)), "one": "five words make one shingle"}
    vocabulary = [f"w{k}" for k in range(50)]
    docs = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randrange(0, 120))
        for name in rng.sample(sorted(templates), rng.randrange(0, 3)):
            notice = templates[name].split()
            for _ in range(rng.randrange(0, 4)):
                notice[rng.randrange(len(notice))] = rng.choice(vocabulary)
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        docs.append((i, " ".join(words)))
    docs += [(500, None), (501, ""), (502, "all RIGHTS reserved"), (503, "All rights")]
    docs += [(504, " ".join(rng.choices(vocabulary, k=3000)) + ". All rights reserved.")]  # three words at the end of a long text

    def split(t):
        return "".join(c if c.isascii() and c.isalnum() else " " for c in brute.lower(t)).split()

    def shingles(t):
        w = split(t)
        return [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []

    def find(t):
        own, found = shingles(t), set()
        for name, body in templates.items():
            want, whole = set(shingles(body)), split(body)
            if len(whole) < 5:  # fewer words than a shingle: wherever they stand in a row
                if any(split(t)[k : k + len(whole)] == whole for k in range(len(split(t)))):
                    found.add(name)
                continue
            step = max(4, 1 << (len(want) - 1).bit_length())
            for k in range(0, len(own), step):
                if 100 * len(want & set(own[k : k + 2 * step])) >= 80 * len(want):
                    found.add(name)
        return sorted(found)

    rows = licenses.scan_licenses(frame(spark, docs), templates=templates).collect()
    assert {r.doc_id: r._licenses for r in rows} == {i: find(t) for i, t in docs}
    assert any(r._licenses for r in rows)


def test_short_notices_are_found_anywhere(spark):
    rng = random.Random(8)
    templates = dict(licenses.TEMPLATES) | {"one": "Copyleft", "two": "public domain", "four": "no rights reserved here", "none": "(c)!".replace("c", "")}
    long = " ".join(f"w{k}" for k in range(400))
    docs = [(1, f"{long} All rights reserved."), (2, f"All rights reserved {long}"), (3, f"{long} all Rights;  RESERVED {long}"), (4, f"{long} all rights"), (5, f"reserved {long}")]
    docs += [(6, "All rights reserved"), (7, "all rights"), (8, "All rights reservedly made of words"), (9, None), (10, "")]
    pieces = ["copyleft", "public", "domain", "no", "all", "rights", "reserved", "here", "w1"]
    docs += [(100 + k, " ".join(rng.choices(pieces, k=rng.randrange(1, 60)))) for k in range(80)]

    def clean(t):
        return " " + " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in brute.lower(t)).split()) + " "

    short = {name: clean(t) for name, t in templates.items() if 0 < len(clean(t).split()) < 5}
    assert set(short) == {"rights-reserved", "one", "two", "four"}
    rows = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, docs), templates=templates).collect()}
    assert {i: r._licenses for i, r in rows.items()} == {i: sorted(name for name, x in short.items() if x in clean(t)) for i, t in docs}
    assert [tuple(m) for m in rows[1]._matches] == [("rights-reserved", 400, 1)] and [tuple(m) for m in rows[3]._matches] == [("rights-reserved", 400, 1)]
    assert [rows[i]._licenses for i in (2, 4, 5, 6, 7, 8)] == [["rights-reserved"], [], [], ["rights-reserved"], [], []]


def test_licenses_on_empty_tables_and_without_templates(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert licenses.scan_licenses(frame(spark, [(1, "Released under the MIT License")]), templates={}).first()._licenses == []


# Ordinal quality


def graded(n, seed):
    rng = random.Random(seed)
    good, bad = [f"g{k}" for k in range(40)], [f"B{k}!!" for k in range(40)]
    docs, grades = [], []
    for i in range(n):
        grade = rng.randrange(3)
        share = (0.1, 0.5, 0.9)[grade]
        docs.append((i, " ".join(rng.choice(good if rng.random() < share else bad) for _ in range(rng.randrange(20, 60)))))
        grades.append((i, grade))
    return docs, grades


def test_ordinal_regression_orders_held_out_texts(spark):
    docs, grades = graded(500, 1)
    model = ordinal.train(frame(spark, docs), spark.createDataFrame(grades[:350], "doc_id long, grade int"))
    assert np.all(np.diff(model.thresholds) > 0)
    rows = {r.doc_id: r for r in ordinal.score(frame(spark, docs), model).collect()}
    held = [(g, rows[i]._expected_grade, rows[i]._tail) for i, g in grades[350:]]
    means = [np.mean([e for g, e, _ in held if g == k]) for k in range(3)]
    assert means[0] < 0.5 < means[1] < 1.5 < means[2]
    assert np.mean([(t >= 0.5) == (g >= 1) for g, _, t in held]) > 0.9


def test_ordinal_cases(spark):
    docs, grades = graded(60, 2)
    docs += [(900, None), (901, ""), (0, docs[0][1])]
    table = spark.createDataFrame([*grades, (None, 1), (5, None)], "doc_id long, grade int")
    model = ordinal.train(frame(spark, docs), table, epochs=2)
    rows = ordinal.score(frame(spark, docs).withColumn("grade", F.lit(7)), model).collect()
    assert len(rows) == len(docs) and all(0 <= r._expected_grade <= 2 for r in rows)
    one = ordinal.train(frame(spark, docs), spark.createDataFrame([(1, 1)], "doc_id long, grade int"))
    assert {(r._expected_grade, r._tail) for r in ordinal.score(frame(spark, docs), one).collect()} == {(1.0, 1.0)}
    none = ordinal.train(frame(spark, docs), table.limit(0))
    assert {r._kept for r in ordinal.score(frame(spark, docs), none).collect()} == {False}
    assert ordinal.score(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_gradient_fits_separable_grades():
    rows = [np.array([k % 4]) for k in range(80)]
    model = ordinal.fit(rows, [np.ones(1)] * 80, np.array([k % 4 // 2 for k in range(80)]), bits=4, epochs=80)
    eta = model.weights[:4]
    assert min(eta[2:]) > model.thresholds[0] > max(eta[:2])


# Toxicity


def insulting(n, seed):
    rng = random.Random(seed)
    plain, rude = [f"w{k}" for k in range(300)], ["moron", "scum", "clown"]
    docs, labels = [], []
    for i in range(n):
        words, toxic = rng.choices(plain, k=rng.randrange(10, 80)), int(rng.random() < 0.3)
        for _ in range(rng.randrange(1, 4) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(rude))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def test_toxicity_tells_held_out_texts(spark):
    docs, labels = insulting(600, 3)
    train = [(i, y) for i, y in labels if not toxicity.in_fold(i, 5, 0)]
    model = toxicity.train(frame(spark, docs), spark.createDataFrame(train, "doc_id long, toxic int"))
    rows = {r.doc_id: r for r in toxicity.score(frame(spark, docs), model).collect()}
    held = [(y, rows[i]._score, rows[i]._predicted) for i, y in labels if toxicity.in_fold(i, 5, 0)]
    assert np.mean([p == y for y, _, p in held]) > 0.93
    pairs = [a > b for y, a, _ in held if y for z, b, _ in held if not z]
    assert np.mean(pairs) > 0.95


def test_toxicity_probabilities_are_normalised():
    texts = [["a b c a b", "a a b"] * 5, ["a b x", "x y x y"] * 2]
    model = toxicity.estimate([toxicity.Counts.of(toxicity.hashed(t)) for t in texts])
    known = ["a", "b", "c", "x", "y", "unseen"]
    after = lambda v: model.likelihoods(toxicity.hashed([f"{v} {w}" for w in known])) - model.likelihoods(toxicity.hashed([v]))
    for v in known:
        assert np.allclose(np.exp(after(v)).sum(1), 1, atol=1e-6)
    assert np.allclose(np.exp(model.likelihoods(toxicity.hashed(known))).sum(1), 1, atol=1e-6)


def test_a_small_class_is_not_drowned_by_a_large_one(spark):
    """Every labelled row is learned from: with 20 ordinary texts a toxic one, held-out texts are told as well."""
    docs, labels = insulting(1500, 6)
    toxic = [i for i, y in labels if y]
    gone = set(toxic[60:])
    docs, labels = [d for d in docs if d[0] not in gone], [x for x in labels if x[0] not in gone]
    fresh, truth = insulting(300, 7)
    model = toxicity.train(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.ranked > 0.9
    rows = {r.doc_id: r._score for r in toxicity.score(frame(spark, fresh), model).collect()}
    assert np.mean([rows[i] > rows[j] for i, y in truth if y for j, z in truth if not z]) > 0.95


def test_toxicity_cases(spark):
    docs, labels = insulting(40, 4)
    docs += [(900, None), (901, ""), (0, docs[0][1])]
    table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.score(frame(spark, docs).withColumn("label", F.lit("x")), toxicity.train(frame(spark, docs), table)).collect()
    assert len(rows) == len(docs) and all(0 <= r._score <= 1 for r in rows)
    ordinary = toxicity.train(frame(spark, docs), table.where("toxic = 0"))
    assert {r._predicted for r in toxicity.score(frame(spark, docs), ordinary).collect()} == {0}
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), ordinary).collect() == []
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_a_window_retrieves_only_templates_that_share_a_slot(spark, monkeypatch):
    """With many templates of a class, those verified are the few that a band names."""
    rng = random.Random(9)
    templates = {f"t{k}": " ".join(rng.choices([f"w{j}" for j in range(3000)], k=40)) for k in range(400)}
    known = licenses.Templates(templates)
    text = " ".join(rng.choices([f"x{j}" for j in range(500)], k=300)) + " " + templates["t7"] + " " + templates["t300"]
    asked = []
    isin = np.isin
    monkeypatch.setattr(licenses.np, "isin", lambda members, *a, **kw: asked.append(1) or isin(members, *a, **kw))
    found, _ = known.find([text])
    assert {m[0] for m in found[0]} == {"t7", "t300"} and len(asked) < 60


def test_full_licence_texts_are_found_with_small_changes(spark):
    body = licenses.TEMPLATES["BSD-3-Clause-full"].replace("copyright holder nor", "University nor").replace("COPYRIGHT HOLDER OR", "REGENTS OR")
    rows = {r.doc_id: r._licenses for r in licenses.scan_licenses(frame(spark, [(1, f"Copyright (c) 1999\n\n{body}"), (2, licenses.TEMPLATES["ISC-full"]), (3, body[: len(body) // 2])])).collect()}
    assert "BSD-3-Clause-full" in rows[1] and "ISC-full" in rows[2] and "BSD-3-Clause-full" not in rows[3]


def test_repeated_rows_of_an_id_are_one_document_of_a_line(spark):
    docs = [(1, "stock line\nown words", "h")] * 9 + [(k, f"other line\nmore{k}", "h") for k in range(10, 14)] + [(None, "other line", "h")] * 9
    rows = line_rules.apply_line_rules(frame(spark, docs, ", source string"), max_docs=3, min_words=0, block_bytes=1).collect()
    removed = {(r.doc_id, r._n_removed_words) for r in rows}
    assert removed == {(1, 0), *((k, 2) for k in range(10, 14)), (None, 2)}


def test_item_ids_of_any_type_and_a_bounded_automaton(spark):
    docs = frame(spark, [(1, "alpha beta gamma delta"), (2, "one two three")])
    named = spark.createDataFrame([("b-2", "beta gamma"), ("a-1", "alpha beta gamma"), ("a-1", "two three"), (None, "one two")], "item_id string, text string")
    rows = {r.doc_id: (r._n_hit, r._items) for r in decontaminate.find_contamination(docs, named, size=3).collect()}
    assert rows == {1: (3, ["a-1", "b-2"]), 2: (2, ["a-1"])}
    with pytest.raises(ValueError):
        decontaminate.find_contamination(docs, named, size=3, max_nodes=3)


def test_a_large_benchmark_is_one_small_automaton():
    """Eight million characters of items stay below 500 MB: 16 bytes a node, and few nodes a word."""
    rng = np.random.default_rng(0)
    words = 120_000
    numbers = np.minimum((rng.pareto(0.6, words) * 20).astype(np.int64), 49_999).astype(np.uint64)
    machine = decontaminate.build(decontaminate.np.asarray(numbers) * np.uint64(0x9E3779B97F4A7C15), np.full(words // 120, 120), np.arange(words // 120), 10)
    held = sum(getattr(machine, x).nbytes for x in ("words", "keys", "fail", "ends", "first", "patterns", "lengths", "starts", "items"))
    assert held * (8_000_000 / (4.5 * words)) < 500e6
