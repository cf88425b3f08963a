"""The store between scans, incremental generation, orders and patterns that grow."""

import dataclasses
import os
import random

import pytest
from pyspark.sql import functions as F

from loquat.operators import analysis as A
from loquat.operators import detect as D
from loquat.operators import order
from loquat.functions import strings
from loquat.plans import codegen, config, generate, scan
from loquat.plans.store import Store
from loquat.sources import readers
from loquat.streaming.watch import follow

SCHEMA = {"entries": "path string, hash string", "more": "path string, n int"}


def sizes(root):
    """Bytes of each data file below a folder."""
    out = {}
    for folder, _, names in os.walk(root):
        out |= {os.path.join(folder, x): os.path.getsize(os.path.join(folder, x)) for x in names if x.startswith("part-")}
    return out


def content(store, table="entries"):
    return sorted(map(tuple, store.read(table).collect()))


def test_only_buckets_with_changes_are_rewritten(spark, tmp_path):
    rows = [(f"p{k}", "a") for k in range(3000)]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA["entries"])
    more = lambda paths: spark.createDataFrame([(p, k) for k, p in enumerate(paths)], SCHEMA["more"])
    root = f"file://{tmp_path}/s"
    store = Store(spark, root, SCHEMA).open()
    assert content(store) == []
    store.update({"entries": frame(rows), "more": more(["p1", "p2"])}, frame(rows), 64 * 2000)
    assert store.version.buckets == 64 and content(store) == sorted(rows) and len(content(store, "more")) == 2
    before = sizes(tmp_path)
    other = Store(spark, root, SCHEMA).open()
    held = other.read("entries")  # a reader of the first version
    changed = Store(spark, root, SCHEMA).open()
    changed.update({"entries": frame([("p7", "b"), ("new", "b")]), "more": more([])}, frame([("p7", ""), ("new", ""), ("p8", "")]), 64 * 2000)
    want = sorted({**dict(rows), "p7": "b", "new": "b"}.items() - {("p8", "a")})
    assert content(changed) == want and content(Store(spark, root, SCHEMA).open()) == want
    assert sorted(map(tuple, held.collect())) == sorted(rows)
    written = {f: n for f, n in sizes(tmp_path).items() if f not in before and "/entries/" in f}
    assert 1 <= changed.rewritten["entries"] <= 3 and sum(written.values()) < sum(n for f, n in before.items() if "/entries/" in f) / 10
    # Two versions are kept; a third publication sweeps what only the first names.
    for k in range(2):
        Store(spark, root, SCHEMA).open().update({"entries": frame([("p9", f"{k}")]), "more": more([])}, frame([("p9", "")]), 64 * 2000)
    last = Store(spark, root, SCHEMA).open()
    assert len(last.versions()) == 2 and dict(content(last))["p9"] == "1" and content(last, "more") == [("p1", 0), ("p2", 1)]
    assert len([f for f in sizes(tmp_path) if "/entries/" in f]) <= 64 + 3


def test_a_store_that_has_grown_is_dealt_anew_and_may_become_empty(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA["entries"])
    schema = {"entries": SCHEMA["entries"]}
    root = f"file://{tmp_path}/s"
    store = Store(spark, root, schema).open()
    store.update({"entries": frame([("a", "1"), ("b", "1")])}, frame([("a", ""), ("b", "")]), 10)
    assert store.version.buckets == 1
    store = Store(spark, root, schema).open()
    store.update({"entries": frame([("c", "2")])}, frame([("c", "")]), 20_000)
    assert store.version.buckets == 10 and content(store) == [("a", "1"), ("b", "1"), ("c", "2")]
    store.update({"entries": frame([])}, frame([(x, "") for x in "abc"]), 0)
    assert content(Store(spark, root, schema).open()) == []


def test_a_second_writer_fails_and_changes_nothing(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA["entries"])
    schema = {"entries": SCHEMA["entries"]}
    root = f"file://{tmp_path}/s"
    one, two = Store(spark, root, schema).open(), Store(spark, root, schema).open()
    one.update({"entries": frame([("a", "1")])}, frame([("a", "")]), 1)
    with pytest.raises(Exception):
        two.update({"entries": frame([("a", "2")])}, frame([("a", "")]), 1)
    assert content(Store(spark, root, schema).open()) == [("a", "1")]


def view(k, extra=""):
    return f'struct V{k}View: View {{ var body: some View {{ Text("Value number {k}")\n {extra} }} }}\n'


def test_generating_again_parses_only_what_changed(spark, tmp_path):
    (tmp_path / "Sources").mkdir()
    for k in range(12):
        (tmp_path / f"Sources/V{k}View.swift").write_text(view(k, f"Text(i18n.V{(k + 1) % 12}.valueNumber())"))
    conf = config.Config(minimum_confidence=0.5, incremental=True, exclude=("Generated",))
    cache = f"file://{tmp_path}/cache"
    first = generate.run(spark, conf, str(tmp_path), cache)
    assert first["parsed"] == 12 and first["preserved"] == 0
    before = dict(sizes(tmp_path / "cache"))
    # One file loses its literal; another still refers to the accessor.
    (tmp_path / "Sources/V3View.swift").write_text("struct V3View {}\n")
    out = generate.run(spark, conf, str(tmp_path), cache)
    full = generate.run(spark, dataclasses.replace(conf, incremental=False), str(tmp_path), dry_run=True)
    assert out["parsed"] == 1 and out["generated"][0][1] == full["generated"][0][1] and "Value number 3" in out["generated"][0][1]
    assert sorted(map(tuple, out["referenced"].collect())) == sorted(map(tuple, full["referenced"].collect()))
    assert out["summary"].drop("cache_hits").collect() == full["summary"].drop("cache_hits").collect()
    assert all(f in sizes(tmp_path / "cache") for f in before)
    # The reference goes, too: then so does the accessor, which no scan reads a file for but the changed one.
    (tmp_path / "Sources/V2View.swift").write_text(view(2))
    out = generate.run(spark, conf, str(tmp_path), cache)
    assert out["parsed"] == 1 and "Value number 3" not in out["generated"][0][1]
    again = generate.run(spark, conf, str(tmp_path), cache)
    assert again["parsed"] == 0 and again["summary"].first().cache_hits == 12
    # A scan of the same settings profits from what generating kept.
    assert scan.run(spark, conf, str(tmp_path), cache)["parsed"] == 0


def test_ranks_and_places_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaaab"), rng.randrange(40), k) for k in range(3000)]
    want = {}
    for g in "ab":
        for n, (_, x, k) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            want[k] = n
    place = {k: n for n, (_, _, k) in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "3", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            df = spark.createDataFrame(rows, "g string, x int, k int").repartition(5)
            assert {r["k"]: r["rank"] for r in order.ranked(df, ["g"], ["x", "k"]).collect()} == want
            assert {r["k"]: r["place"] for r in order.placed(df, "x", "k").collect()} == place
        empty = spark.createDataFrame([], "g string, x int, k int")
        assert order.ranked(empty, ["g"], ["x"]).collect() == order.placed(empty, "x").collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_failed_files_come_first(spark):
    files = spark.createDataFrame([("b", "x"), ("z", None), ("a", "y"), ("c", None)], "path string, content string")
    assert [r.path for r in A.files_in_order(files).orderBy("place").collect()] == ["c", "z", "a", "b"]
    rows = spark.createDataFrame([("b", 2, "m"), (None, None, "n"), ("b", 1, "o"), ("a", 9, "p")], "path string, pos int, message string")
    assert [r.message for r in A.findings_in_order(rows).orderBy("place").collect()] == ["n", "p", "o", "m"]
    strings = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.95), ("b", 1, 0.9), ("c", 1, 0.2)], "path string, pos int, confidence double")
    assert [(r.path, r.pos) for r in A.by_confidence(strings, 0.5).orderBy("place").collect()] == [("a", 2), ("a", 1), ("b", 1)]


def test_one_name_of_many_assets(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "image").otherwise("color").alias("type"), F.concat(F.repeat(F.lit("-"), (F.col("id") % 10).cast("int")), F.lit("x"), F.repeat(F.lit("."), F.floor(F.col("id") / 10).cast("int"))).alias("full_name"))
    out = A.unique_identifiers(rows).collect()
    names = ["x"] + [f"x_{k}" for k in range(2, 20_001)]
    assert [r.identifier for r in sorted(out, key=lambda r: (r.type != "image", r.full_name))] == names


def test_many_patterns_equal_few(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["A", "B", "Ab", "A.B", "B.A.C", "", "."])
    events = [(f"f{k % 9}", k, 1, 1, rng.choice(["call", "path", "static"]), ".".join(rng.choice(["A", "B", "Ab", "C"]) for _ in range(rng.randrange(1, 5))), ) for k in range(400)] + [("g", 1, 1, 1, "call", None), ("g", 2, 1, 1, "call", "")]
    df = spark.createDataFrame(events, "path string, pos int, line int, col int, kind string, dotted string")
    for _ in range(4):
        patterns = [word() + rng.choice(["", ".", ".C"]) for _ in range(rng.randrange(1, 12))]
        few = D.existing_references(df, patterns)
        table = spark.createDataFrame(list(enumerate(patterns)), "ord long, pattern string")
        many = D.references_to(df, table)
        assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect())) and few.columns == many.columns
    many = D.existing_references(df, [f"X{k}" for k in range(100)] + ["A"])
    assert sorted(map(repr, many.collect())) == sorted(map(repr, D.existing_references(df, ["A"]).collect()))


def test_excluded_files_are_not_read(spark, tmp_path):
    (tmp_path / "Pods/Big").mkdir(parents=True)
    (tmp_path / ".build").mkdir()
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b/o+n%20e é.swift").write_text("let a = 1")
    for big in ("Pods/Big/x.swift", ".build/y.swift"):
        (tmp_path / big).write_bytes(b"x" * 100_000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # a larger file cannot be read
    try:
        found = readers.files(spark, str(tmp_path), exclude=["Pods/**"]).collect()
        assert [(r.rel_path, r.content) for r in found] == [("a b/o+n%20e é.swift", "let a = 1")]
        assert len(readers.files(spark, f"file://{tmp_path}", exclude=["Pods"]).collect()) == 1
        with pytest.raises(Exception):
            readers.files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_generating_below_a_uri(spark, tmp_path):
    (tmp_path / "Sources").mkdir()
    (tmp_path / "Sources/V1View.swift").write_text(view(1, "Text(i18n.V2.valueNumber())"))
    (tmp_path / "Sources/V2View.swift").write_text(view(2))
    conf = config.Config(minimum_confidence=0.5, exclude=("Generated",), assets=config.Assets(enabled=True))
    base = f"file://{tmp_path}"
    out = generate.run(spark, conf, base)
    assert [w for w, _ in out["generated"]] == [f"{base}/Sources/Generated/i18n.swift", f"{base}/Sources/Generated/Assets.swift"]
    target = tmp_path / "Sources/Generated/i18n.swift"
    assert target.read_text() == out["generated"][0][1] and not [x for x in os.listdir(target.parent) if x.startswith(".i18n") and not x.endswith(".crc")]
    (tmp_path / "Sources/V2View.swift").write_text("struct V2View {}")
    again = generate.run(spark, conf, base)
    assert again["preserved"] == 1 and target.read_text() == again["generated"][0][1] and "Value number 2" in target.read_text()
    assert generate.run(spark, conf, str(tmp_path), dry_run=True)["generated"][0][1] == again["generated"][0][1]
    text, where = codegen.write_file(f"{base}/region.swift", "one", "region")
    text, where = codegen.write_file(where, "two", "region")
    assert (tmp_path / "region.swift").read_text() == text and "two" in text and "one" not in text
    assert codegen.read_file(f"{base}/nothing.swift") is None and codegen.read_file(base) is None


def test_a_callers_rules(spark, tmp_path):
    (tmp_path / "Sources").mkdir()
    (tmp_path / "Sources/AView.swift").write_text('let a = Text("ACME_ROCKET_9")\nlet b = Text("Rocket fuel")\nlet c = Text("Acme-1")\nlet d = Text("x_y")')
    rules = [strings.Filter("brand", "lower(text) LIKE 'acme%'", "a brand", before="analyticsKey"), strings.Filter("fuel", lambda t: t.contains("fuel"), version="1")]
    conf = config.Config(minimum_confidence=0.0, incremental=True)
    cache = f"file://{tmp_path}/cache"
    for parsed in (1, 0):
        out = scan.run(spark, conf, str(tmp_path), cache, filters=rules)
        told = {(r.line, r.message.split("— ")[-1]) for r in out["diagnostics"].where("kind = 'filtered'").collect()}
        assert told == {(1, "a brand"), (3, "a brand"), (4, "words joined by underscores")} and out["parsed"] == parsed
        assert [r.value for r in out["detected"].collect()] == ["Rocket fuel"]  # the gate keeps what has blanks
    assert scan.run(spark, conf, str(tmp_path), cache)["parsed"] == 1  # without the rules results are others
    names = [n for n, _ in strings.cascade([strings.Filter("x", "true", before="emptyString"), strings.Filter("y", "true", before="emptyString"), strings.Filter("z", "true")])]
    assert names[:3] == ["x", "y", "emptyString"] and names[-1] == "z"
    for bad in (strings.Filter("x", "true", before="nothing"), strings.Filter("emptyString", "true")):
        with pytest.raises(ValueError):
            strings.cascade([bad])


def test_following_changes_equals_a_scan(spark, tmp_path):
    log = tmp_path / "log"
    schema = "path string, content string, at long, deleted boolean"
    batches = [
        [("a", view(1), 1, False), ("b", view(2), 1, False), ("c", view(3), 1, None), ("c", view(4), 2, False)],
        [("a", view(1), 3, False), ("b", view(5, "Text(i18n.A.b())"), 3, False), ("gone", view(6), 3, False), ("gone", None, 4, True)],
        [("c", None, 5, True), ("d", view(7), 5, False), ("never", None, 5, True)],
    ]
    seen, conf = [], config.Config(minimum_confidence=0.5)
    store = f"file://{tmp_path}/store"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(log))
        changes = spark.readStream.schema(schema).parquet(str(log))
        follow(changes, store, str(tmp_path / "check"), conf, lambda s, n: seen.append((s.parsed, s.cache_hits, s.stale, s.detected.count())), available_now=True).awaitTermination()
    assert seen == [(3, 0, 0, 3), (1, 1, 0, 3), (1, 0, 1, 3)]
    files = spark.createDataFrame([("a", view(1)), ("b", view(5, "Text(i18n.A.b())")), ("d", view(7))], "path string, content string")
    want = scan.analyse(files, conf)
    entries = scan.open_store(spark, store).open().read("entries")
    got = entries.select("path", F.inline("strings")).select(want.detected.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.detected.collect()))
    assert [(r.accessor, r.path) for r in scan.open_store(spark, store).open().read("references").collect()] == [("A.b", "b")]


def test_the_simple_scan_looks_into_packages_and_ends_at_errors(spark, tmp_path):
    (tmp_path / "Kit.framework").mkdir()
    (tmp_path / ".build").mkdir()
    for name in ("AView.swift", "Kit.framework/BView.swift", ".build/CView.swift"):
        (tmp_path / name).write_text(f'let a = Text("Hello from {name[-11:-6]}")')
    found = scan.facade(spark, str(tmp_path))["strings"].collect()
    assert len(found) == 2
    (tmp_path / "bad.swift").write_bytes(b"\xff\xfe")
    with pytest.raises(scan.UnreadableSource, match="bad.swift"):
        scan.facade(spark, str(tmp_path), strict=True)
    assert scan.facade(spark, str(tmp_path))["strings"].count() == 2
    with pytest.raises(FileNotFoundError):
        scan.facade(spark, f"{tmp_path}/nowhere")


def test_a_reference_that_stands_twice_is_told_once(spark, tmp_path):
    """patterns_as_table on lines that are in the table twice, against its SQL."""
    import duckdb

    from loquat import kept_queries as K

    con = duckdb.connect()
    con.execute(f"COPY (SELECT i::BIGINT AS p_partkey, (i % 5)::INT AS p_size FROM range(40) t(i)) TO '{tmp_path}/part.parquet'")
    con.execute(f"COPY (SELECT (i % 20)::BIGINT AS l_orderkey, (i % 20)::BIGINT AS l_partkey, (i % 5)::BIGINT AS l_suppkey, (i % 2)::INT AS l_linenumber FROM range(60) t(i)) TO '{tmp_path}/lineitem.parquet'")
    for name in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = sorted(con.execute(K.ORACLE_SQL["patterns_as_table"]).fetchall())
    assert want and sorted(map(tuple, K.patterns_as_table(spark, str(tmp_path)).collect())) == want
