import pytest
from pyspark.sql import functions as F

from loquat.functions import strings as S
from loquat.functions.paths import is_excluded


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


REASONS = {
    "": "emptyString", "   ": "emptyString", "\t": "emptyString",
    "👍": "emojiOnly", "👍 🎉": "emojiOnly", "👨‍👩‍👧": "emojiOnly", "👍🏽": "emojiOnly", "🇫🇷": "emojiOnly", "👍 ok": None,
    "https://a.b": "urlPattern", "FTP://x": "urlPattern", "www.x": "urlPattern", "/usr": "filePathPattern", "~/x": "filePathPattern",
    "org.swift.package": "analyticsKey", "io.github.tool": "analyticsKey", "App.Store": "analyticsKey",
    "arrow.right.circle": "dotSeparatedIdentifier", "3.14": "dotSeparatedIdentifier", "loading...": None,
    "user_name": "snakeCaseIdentifier", "profile_image_url": "snakeCaseIdentifier", "SOME_FEATURE_FLAG": "allCapsConstant", "1_2": "allCapsConstant",
    "viewModel": "camelCaseIdentifier", "featureFlag2": "camelCaseIdentifier", "iPhone": None, "macOS": None, "_": None,
    "Settings": None, "OK": None, "e-mail": None, "user name": None, "https://a b": "urlPattern",
}


def test_exclusion_reasons(spark):
    assert dict(zip(REASONS, column(spark, REASONS, S.exclusion_reason))) == REASONS


@pytest.mark.parametrize("value,base,scope,want", [("Delete Account", 0.95, (None, None), 0.99), ("OK", 0.98, (None, None), 0.87), ("ECONOMY", 0.98, (None, None), 0.9099999999999999), ("Customer#000000000", 0.90, (None, None), 0.8300000000000001), ("Save", 0.95, (None, None), 0.9199999999999999), ("Hello World", 0.99, ("AView", "body"), 1.0), ("x" * 201, 0.1, (None, None), 0.0), ("", 0.98, (None, None), 0.6799999999999999)])
def test_confidence(spark, value, base, scope, want):
    row = spark.createDataFrame([(value, base, *scope)], "v string, b double, t string, p string")
    assert row.select(S.confidence(F.col("v"), F.col("b"), F.col("t"), F.col("p"))).first()[0] == want


def test_factors_and_summary(spark):
    row = spark.createDataFrame([("Delete Account", 0.95, "HomeView", "body")], "v string, b double, t string, p string")
    e = row.select(S.score_explanation(*map(F.col, "vbtp")).alias("e"), S.score_summary(S.score_factors(*map(F.col, "vtp"))).alias("s")).first()
    assert [f.reason for f in e.e.factors] == ["multi-word phrase", "title case", "starts uppercase", "inside HomeView (View family)", "inside body property"]
    assert e.s.startswith("+2% multi-word phrase, +1% title case") and e.e.final == 1.0


def test_namespaces(spark):
    paths = {"Sources/SettingsView.swift": "Settings", "LoginViewController.swift": "Login", "View.swift": "View", "ViewController.swift": "View", "Utilities.swift": "Utilities", "a/HomePageController.swift": "HomePage", "x/Foo.generated.swift": "Foo.generated"}
    assert dict(zip(paths, column(spark, paths, S.namespace_of_file))) == paths
    strategy = lambda v: S.directory_namespace(v, S.namespace_of_file(v))
    assert column(spark, ["Payment/SettingsView.swift", "Sources/SettingsView.swift", "SettingsView.swift", "ui/AView.swift"], strategy) == ["PaymentSettings", "Settings", "Settings", "UiA"]


def test_names(spark):
    names = {"Welcome Back": "welcomeBack", "return": "return", "": "localizedString", "123 !": "localizedString", "don't-stop me": "donTStopMe", "HELLO wORLD": "helloWorld", "été fini…": "étéFini"}
    assert dict(zip(names, column(spark, names, lambda v: S.property_name(v, F.lit(""))))) == names
    assert column(spark, ["Delete Account", ""], lambda v: S.property_name(v, F.lit("ButtonTitle"))) == ["deleteAccountButtonTitle", "localizedString"]
    assert column(spark, ["return", "save"], S.backticked) == ["`return`", "save"]
    assert column(spark, ['a"b\\c'], S.escaped) == ['a\\"b\\\\c']
    assert column(spark, ["Continue →", "a, b!"], S.decorative_count) == [1, 2]


def test_asset_names(spark):
    stems = {"profile_icon": "profileIcon", "app-icon": "appIcon", "PrimaryBlue": "primaryBlue", "my.icon": "myIcon", "2x_icon": "_2xIcon", "--": "_asset"}
    assert dict(zip(stems, column(spark, stems, S.asset_identifier))) == stems
    types = {"my_icons": "MyIcons", "Icons": "Icons", "brand-assets": "BrandAssets", "": "_Namespace"}
    assert dict(zip(types, column(spark, types, S.asset_type_name))) == types


@pytest.mark.parametrize("pattern,path,want", [("*.swift", "Sources/View.swift", False), ("*.swift", "View.swift", True), ("**/*.generated.swift", "a/b/X.generated.swift", True), ("**/*.generated.swift", "X.generated.swift", True), ("Sources/**", "Sources/a/b.swift", True), ("a/?.swift", "a/b.swift", True), ("a/?.swift", "a//.swift", False), ("Gen", "Gen/x.swift", True), ("Gen/", "Gen/x.swift", True), ("Gen", "Generated/x.swift", False), ("a+b", "a+b/c", True), ("A/*", "a/x", False)])
def test_exclusion_patterns(spark, pattern, path, want):
    assert column(spark, [path], lambda v: is_excluded(v, [pattern])) == [want]


def test_long_texts_are_shortened(spark):
    assert column(spark, ["x" * 40, "x" * 41], S.shortened) == ["x" * 40, "x" * 40 + "…"]
