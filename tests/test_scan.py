import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from loquat.operators import analysis as A
from loquat.plans import codegen, config, report, scan
from loquat.sources import extract, readers
from loquat.streaming.watch import watch

VIEW = """import SwiftUI
struct SettingsView: View {
    static let appName = "Demo App"
    var body: some View {
        VStack {
            Text("Welcome Back")
            Text("Hello \\(name)")
            Text("Hidden") // loquat:ignore
            Text("arrow.right")
            Image("hero")
            Button("Save") {}
            Toggle(title, isOn: $on)
            Text(localized("Inner"))
        }.navigationTitle("Settings")
    }
}
"""
OTHER = 'struct ProfileView: View { var body: some View { Button("Save") {}\n Text(L10n.Home.title) } }\n'


@pytest.fixture
def project(tmp_path):
    (tmp_path / "Sources/Generated").mkdir(parents=True)
    (tmp_path / "Sources/.hidden").mkdir()
    (tmp_path / "Sources/SettingsView.swift").write_text(VIEW)
    (tmp_path / "Sources/ProfileView.swift").write_text(OTHER)
    (tmp_path / "Sources/Generated/X.swift").write_text('let a = Text("Generated text")')
    (tmp_path / "Sources/.hidden/Y.swift").write_text('let a = Text("Hidden text")')
    (tmp_path / "Sources/bad.swift").write_bytes(b"\xff\xfe Text")
    (tmp_path / "L.xcstrings").write_text(json.dumps({"sourceLanguage": "en", "strings": {"Save": {}, "Old": {"localizations": {"en": {"stringUnit": {"state": "x", "value": "Save"}}, "de": {}}}, "Gone": {"localizations": {"de": {}}}}}))
    return tmp_path


CONFIG = config.Config(exclude=("Sources/Generated",), minimum_confidence=0.5, accessibility_audit=True, existing_localization=config.ExistingLocalization(patterns=("L10n.",)))


def test_scan(spark, project):
    conf = dataclasses.replace(CONFIG, exclude=("Generated",))
    out = scan.run(spark, conf, str(project))
    values = {(r.namespace, r.value, r.context) for r in out["detected"].collect()}
    assert values == {("Settings", "Demo App", "staticStringConstant"), ("Settings", "Welcome Back", "textView"), ("Settings", "Hello {…}", "textView"), ("Settings", "Save", "buttonLabel"), ("Settings", "Settings", "navigationTitle"), ("Profile", "Save", "buttonLabel")}
    kinds = sorted((r.kind, r.severity) for r in out["diagnostics"].collect())
    assert kinds == [("accessibility", "warning"), ("duplicate_value", "suggestion"), ("filtered", "note"), ("hint", "suggestion"), ("hint", "suggestion"), ("hint", "suggestion"), ("ignored", "note"), ("interpolated", "warning"), ("missing_key", "warning"), ("missing_key", "warning"), ("missing_key", "warning"), ("unreadable", "error")]
    row = out["summary"].first()
    assert (row.files, row.strings, row.namespaces, row.errors, row.warnings, row.existing_localized, row.missing_catalog_keys, row.orphaned_catalog_keys, row.duplicate_catalog_groups) == (3, 6, 2, 1, 5, 1, 3, 2, 1)


def test_incremental_scan_equals_full_scan(spark, project, tmp_path):
    conf = dataclasses.replace(CONFIG, exclude=("Generated",), incremental=True)
    cache = f"file://{tmp_path}/cache"
    key = lambda out: sorted((r.path, r.pos, r.value, r.confidence) for r in out["detected"].collect())
    first = scan.run(spark, conf, str(project), cache)
    want = key(scan.run(spark, dataclasses.replace(conf, incremental=False), str(project)))
    assert first["summary"].first().cache_hits == 0 and key(first) == want
    second = scan.run(spark, conf, str(project), cache)
    assert second["summary"].first().cache_hits == 3 and key(second) == want
    (project / "Sources/ProfileView.swift").write_text(OTHER.replace("Save", "Store"))
    (project / "Sources/bad.swift").unlink()
    third = scan.run(spark, conf, str(project), cache)
    row = third["summary"].first()
    assert (row.cache_hits, row.stale_entries_removed) == (1, 1) and "Store" in {r[2] for r in key(third)}
    changed = scan.run(spark, dataclasses.replace(conf, minimum_confidence=0.97), str(project), cache)
    assert changed["summary"].first().cache_hits == 0


def test_missing_source_and_unreadable_cache(spark, tmp_path):
    (tmp_path / "cache/version-00000000").mkdir(parents=True)
    (tmp_path / "cache/version-00000000/part.parquet").write_text("no parquet")
    out = scan.run(spark, config.Config(sources=("Nowhere",), incremental=True), str(tmp_path), f"{tmp_path}/cache")
    assert {r.kind for r in out["diagnostics"].collect()} >= {"missing_source", "cache"}


def test_excluded_functions_suppress_and_stop(spark):
    text = 'UIAlertController(title: NSLocalizedString("k", comment: ""), message: "M")\nText("kept text")\nalert("Direct title")'
    conf = config.Config(minimum_confidence=0.0, existing_localization=config.ExistingLocalization(exclude_arguments_of=("Text",)))
    done = scan.analyse(spark.createDataFrame([("a.swift", text)], "path string, content string"), conf)
    assert {r.value for r in done.detected.collect()} == {"M"}
    assert ("suppressed", "note") in {(r.kind, r.severity) for r in done.diagnostics.collect()}


def test_custom_rules(spark):
    files = spark.createDataFrame([("a.swift", 'Banner("Big News")\nfield.hint = "Type here"')], "path string, content string")
    done = scan.analyse(files, config.Config(minimum_confidence=0.0), [(99, "Banner", "direct", "Banner", "", 0.9, "banner")], [(2, "hint", 0.8, "hintText")])
    assert {(r.value, r.context) for r in done.detected.collect()} == {("Big News", "banner"), ("Type here", "hintText")}


def test_code_round_trip(spark, project):
    found = A.with_namespace(scan.analyse(readers.files(spark, str(project / "Sources"), exclude=["Generated"]), dataclasses.replace(CONFIG, minimum_confidence=0.0)).detected)
    text = codegen.strings_file(codegen.string_accessors(found))
    assert text.index("enum Profile {") < text.index("enum Settings {") and 'localized: "Welcome Back"' in text and "Hello" not in text
    parsed = extract.accessors(spark.createDataFrame([("g.swift", text)], "path string, content string"), "i18n")
    names = {(r.namespace, r.func_name, r.escaped_value) for r in parsed.collect()}
    assert ("Settings", "saveButtonTitle", "Save") in names and ("Settings", "settingsNavigationTitle", "Settings") in names
    again = codegen.strings_file(codegen.string_accessors(found, parsed.select("namespace", "func_name", "escaped_value", "escaped_comment")))
    assert again == text


def test_regions(tmp_path):
    old = f"mine\n  {codegen.BEGIN}\nold\n{codegen.END}\nalso mine"
    assert codegen.merged(old, "new") == f"mine\n  {codegen.BEGIN}\nnew\n{codegen.END}\nalso mine"
    assert codegen.merged("nothing", "new") is None and codegen.merged(f"{codegen.END}\n{codegen.BEGIN}", "x") is None
    assert codegen.region(old) == "old" and codegen.region("all") == "all"
    path = tmp_path / "a/b.swift"
    codegen.write_file(path, "one", "region")
    codegen.write_file(path, "two", "region")
    assert path.read_text() == codegen.wrapped("two")
    assert codegen.write_file(path, "three", dry_run=True)[0] == "three" and "two" in path.read_text()


def test_assets(spark, tmp_path):
    root = tmp_path / "App/Media.xcassets"
    for name in ("logo.imageset", "Outer/img.imageset", "Outer/Inner/deep.imageset", "Plain/blue.colorset", "AppIcon.appiconset", "icon_a.imageset", "icon_A.imageset"):
        (root / name).mkdir(parents=True)
        (root / name / "Contents.json").write_text("{}")
    for name in ("Outer", "Outer/Inner"):
        (root / name / "Contents.json").write_text('{"properties": {"provides-namespace": true}}')
    (root / "Plain/Contents.json").write_text("{}")
    assets = readers.assets(spark, str(tmp_path))
    assert {(r.type, r.full_name) for r in assets.collect()} == {("image", "logo"), ("image", "Outer/img"), ("image", "Outer/Inner/deep"), ("color", "blue"), ("image", "icon_a"), ("image", "icon_A")}
    assert {r.full_name: r.identifier for r in A.unique_identifiers(assets).collect()} == {"logo": "logo", "Outer/img": "img", "Outer/Inner/deep": "deep", "blue": "blue", "icon_A": "iconA", "icon_a": "iconA_2"}
    text = codegen.assets_file(assets)
    assert 'public static func deep() -> Image {\n                Image("Outer/Inner/deep")' in text and "enum Inner {" in text
    assert "No assets found" in codegen.assets_file(assets.limit(0))


def test_chained_identifier_collisions(spark):
    rows = spark.createDataFrame([("image", "a_2"), ("image", "a.2"), ("image", "A_2"), ("color", "a 2"), ("image", "x_2"), ("color", "x")], "type string, full_name string")
    out = [r.identifier for r in A.unique_identifiers(rows).collect()]
    assert len(set(out)) == 6


def test_facade(spark, project):
    (project / "M.xcassets/hero.imageset").mkdir(parents=True)
    (project / "M.xcassets/hero.imageset/Contents.json").write_text("{}")
    out = scan.facade(spark, str(project))
    assert ("Common", "Save") in {(r.namespace, r.value) for r in out["strings"].collect()}
    assert out["missing_assets"].count() == 0 and out["assets"].count() == 1


def test_config(tmp_path):
    c = config.load("minimum_confidence: 1\nsources: [A]\noutput:\n  enum_name: _L10n\naccessibility_audit:\n  enabled: true\nunknown: 3\n")
    assert (c.minimum_confidence, c.sources, c.output.enum_name, c.output.table_name, c.accessibility_audit) == (1.0, ("A",), "_L10n", "Localizable", True)
    with pytest.raises(config.ConfigError):
        config.load("sources: [")
    (tmp_path / "A").mkdir()
    config.validate(c, tmp_path)
    for bad in (dataclasses.replace(c, minimum_confidence=1.5), dataclasses.replace(c, sources=("B",)), dataclasses.replace(c, output=config.Output(enum_name="123Invalid")), dataclasses.replace(c, assets=config.Assets(enum_name="my-enum"))):
        with pytest.raises(config.ConfigError):
            config.validate(bad, tmp_path)
    (tmp_path / config.FILE_NAME).write_text("sources: [A]")
    assert config.discover(tmp_path / "A") == tmp_path / config.FILE_NAME
    (tmp_path / "A/Package.swift").write_text("")
    assert config.discover(tmp_path / "A") is None


def test_reports(spark, project):
    out = scan.run(spark, dataclasses.replace(CONFIG, exclude=("Generated",)), str(project))
    parsed = json.loads(report.json_report(out["summary"], out["diagnostics"], out["detected"]))
    assert parsed["scanned"]["strings"] == 6 and {n["name"] for n in parsed["namespaces"]} == {"Settings", "Profile"}
    assert all(d["severity"] != "suggestion" and d["code"] in ("SL000", "SL001", "SL002") for d in parsed["diagnostics"])
    assert any(r.text.startswith("::warning file=") for r in report.annotations(out["diagnostics"]).collect())
    assert report.console_lines(out["diagnostics"], "quiet").count() == 1
    lines = report.console_report(out["summary"], out["detected"], verbose=True)
    assert lines[1:3] == ["  Profile: 1", "  Settings: 5"] and len(lines) == 9
    assert [(r.namespace, r.strings) for r in report.namespace_counts(out["detected"]).collect()] == [("Profile", 1), ("Settings", 5)]
    assert [report.exit_status(1, 1, 0), report.exit_status(1, 0, 0, strict=True), report.exit_status(0, 1, 0, fail_on="warnings"), report.exit_status(0, 1, 1, fail_on="never")] == [0, 1, 1, 0]


def test_stream_of_files(spark, project, tmp_path):
    seen = []
    stream = watch(spark, str(project / "Sources"), f"{tmp_path}/check", lambda s, n: seen.extend(r.value for r in s.detected.collect()), config.Config(minimum_confidence=0.9), available_now=True)
    stream.awaitTermination(120)
    assert "Welcome Back" in seen


def test_catalog_merge_takes_the_last_path(spark):
    rows = spark.createDataFrame([("b", "k", "new", "v", 1), ("a", "k", "old", "w", 2)], "path string, key string, comment string, source_value string, translation_count int")
    assert readers.merge_catalogs(rows).first().comment == "new"
    with pytest.raises(Exception):
        readers.parse_catalogs(spark.createDataFrame([("a", "{")], "path string, content string")).collect()


def test_catalogs_nearby_and_counts(spark, tmp_path):
    (tmp_path / "a/b/c").mkdir(parents=True)
    (tmp_path / "a/M.xcassets").mkdir()
    assert readers.nearby_catalogs(str(tmp_path / "a/b/c")) == [str(tmp_path / "a/M.xcassets")]
    assert readers.nearby_catalogs(str(tmp_path / "a/b/c"), home=str(tmp_path / "a/b")) == []
    assert readers.asset_counts(spark.createDataFrame([("image", "x"), ("image", "x"), ("color", "y")], "type string, full_name string")).first()[:] == (1, 1, 2)
    assert readers.language_count(spark.createDataFrame([("k", None, None, 3)], readers.CATALOG)).first()[0] == 3
    (tmp_path / "one.swift").write_text('Text("Alone here")')
    done = scan.analyse(readers.single_file(spark, str(tmp_path / "one.swift")), config.Config(minimum_confidence=0.0))
    assert [r.value for r in done.detected.collect()] == ["Alone here"]


def test_severity_order(spark):
    rows = spark.createDataFrame([(s,) for s in ("note", "suggestion", "warning", "error", "odd")], "s string")
    assert [r[0] for r in rows.select(A.severity_rank(F.col("s"))).collect()] == [0, 1, 2, 3, 0]


def test_generate_keeps_what_sources_refer_to(spark, project):
    from loquat.plans import generate

    conf = dataclasses.replace(CONFIG, exclude=("Generated",), output=config.Output(path="Sources/Generated/Strings.swift"), assets=config.Assets(enabled=True, path="Sources/Generated/Assets.swift"))
    dry = generate.run(spark, conf, str(project), dry_run=True)
    assert not (project / "Sources/Generated/Strings.swift").exists() and "Welcome Back" in dry["generated"][0][1]
    first = generate.run(spark, conf, str(project))
    assert [p for p, _ in first["generated"]] == [str(project / "Sources/Generated/Strings.swift"), str(project / "Sources/Generated/Assets.swift")]
    assert (project / "Sources/Generated/Strings.swift").read_text() == first["generated"][0][1] and first["preserved"] == 0
    moved = VIEW.replace('Text("Welcome Back")', "Text(i18n.Settings.welcomeBack())")
    (project / "Sources/SettingsView.swift").write_text(moved)
    second = generate.run(spark, conf, str(project))
    text = (project / "Sources/Generated/Strings.swift").read_text()
    assert second["preserved"] == 1 and 'localized: "Welcome Back"' in text
    assert second["exit"] == 1  # an unreadable file
    (project / "Sources/bad.swift").unlink()
    assert generate.run(spark, dataclasses.replace(conf, migration="strict"), str(project), dry_run=True)["exit"] == 1
    assert generate.run(spark, conf, str(project), dry_run=True, common=True)["exit"] == 0
    with pytest.raises(ValueError):
        scan.run(spark, dataclasses.replace(conf, migration="other"), str(project))


def test_diagnostics_say_where(spark, project):
    out = scan.run(spark, dataclasses.replace(CONFIG, exclude=("Generated",)), str(project))
    missing = {r.message.split('"')[1]: r for r in out["diagnostics"].where("kind = 'missing_key'").collect()}
    assert missing["Welcome Back"].line == 6 and missing["Welcome Back"].col > 1 and missing["Welcome Back"].path.endswith("SettingsView.swift")
    facade = scan.facade(spark, str(project))
    told = facade["diagnostics"].where("kind = 'missing_asset'").collect()
    assert [(r.severity, r.line) for r in told] == [("warning", 10)]
    assert facade["totals"].first().missing_assets == 1 and facade["totals"].first().strings >= 6


def test_a_cache_that_cannot_be_written_is_a_warning(spark, project, tmp_path):
    (tmp_path / "file").write_text("no folder")
    conf = dataclasses.replace(CONFIG, exclude=("Generated",), incremental=True)
    out = scan.run(spark, conf, str(project), f"file://{tmp_path}/file/cache")
    assert out["detected"].count() == 6 and any(r.kind == "cache" and r.severity == "warning" for r in out["diagnostics"].collect())


def test_a_file_of_many_events_has_several_rows_in_the_cache(spark, monkeypatch):
    """replayed_strings: no row of the cache grows with a file, which comes in pieces; hits and stale files are counted once."""
    monkeypatch.setattr(scan, "PER_ROW", 5)
    lines = [f'let a{i} = Text("Some text {i}")\n' for i in range(23)]
    rows = [("a.swift", i, x, "1") for i, x in enumerate(lines)] + [("b.swift", 0, 'let b = Text("Other text")\n', "2")]
    files = spark.createDataFrame(rows, "path string, piece long, content string, hash string")
    settings = config.Config(minimum_confidence=0.0)
    first = scan.analyse_incrementally(files, settings, spark.createDataFrame([], scan.CACHE))
    sizes = {(r.path, len(r.strings)) for r in first.cache.collect()}
    assert sizes == {("a.swift", 5), ("a.swift", 3), ("b.swift", 1)} and first.cache.count() == 6
    again = scan.analyse_incrementally(files.where("path = 'a.swift'"), settings, first.cache)
    assert (again.cache_hits, again.stale) == (1, 1) and again.detected.count() == 23 and again.detected.select("pos").distinct().count() == 23
