"""More registered queries of the source-string operators: every form of call, generated files, small source trees.

Sources are generated from rows, one file a part type; trees of a file a nation (25 rows at every scale) are written to the
shared folder and read back. What the rules are is said a second time here, for SQL, and not taken from their table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquat import queries as Q
from loquat.functions import strings as S
from loquat.operators import analysis as A
from loquat.operators import detect as D
from loquat.operators import rules as R
from loquat.plans import codegen, report, scan, stage
from loquat.plans.config import Config, is_identifier
from loquat.sources import extract, readers

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _literal(text) -> str:
    return "NULL" if text is None else str(text) if not isinstance(text, str) else "'" + text.replace("'", "''") + "'"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)


# Every form: a line of source around a quoted string (@)

#: Form, context, base confidence; a call's place is where the whole call begins.
CALL_FORMS = [
    ("Text(@)", "textView", 0.98), ("Button(@) { go() }", "buttonLabel", 0.95), ('Label(@, systemImage: "star")', "labelView", 0.95), ("Toggle(@, isOn: $on)", "toggle", 0.93),
    ("box.navigationTitle(@)", "navigationTitle", 0.97), ("box.navigationBarTitle(@)", "navigationTitle", 0.97), ("box.alert(@, isPresented: $on) { }", "alert", 0.93),
    ("box.confirmationDialog(@, isPresented: $on) { }", "confirmationDialog", 0.93), ("TextField(@, text: $name)", "textField", 0.92), ("box.accessibilityLabel(@)", "accessibilityLabel", 0.90),
    ("Section(@) { }", "section", 0.90), ("Picker(@, selection: $one) { }", "picker", 0.92), ("Menu(@) { }", "menu", 0.93), ("DisclosureGroup(@) { }", "disclosureGroup", 0.91), ("box.help(@)", "helpText", 0.88),
    ("box.setTitle(@, for: .normal)", "uiButtonTitle", 0.93), ("UIAlertController(title: @, message: nil)", "uiAlertTitle", 0.96), ("UIAlertController(title: nil, message: @)", "uiAlertMessage", 0.93),
    ("UIAlertAction(title: @, style: .cancel)", "uiAlertAction", 0.95), ("UIBarButtonItem(title: @, style: .plain)", "uiButtonTitle", 0.93), ("UITabBarItem(title: @, image: nil)", "uiTabBarItem", 0.93),
]
ASSIGNMENT_FORMS = [("box.text = @", "uiLabel", 0.88), ("box.placeholder = @", "uiTextFieldPlaceholder", 0.88), ("box.title = @", "uiNavigationTitle", 0.88), ("prompt = @", "uiNavigationTitle", 0.88), ("a.b.backButtonTitle = @", "uiNavigationTitle", 0.88)]
ASSET_FORMS = [("Image(@)", "image", "swiftUIImage"), ("Image(decorative: @)", "image", "swiftUIImageDecorative"), ("Color(@)", "color", "swiftUIColor"), ("UIImage(named: @)", "image", "uiImageNamed"), ("UIKit.UIColor(named: @)", "color", "uiColorNamed"), ("Image(systemName: @)", None, None)]


def form_files(spark: SparkSession, sf_dir: str, forms: list[tuple]) -> DataFrame:
    """One file a part type: a line a part, with its name in the form that its key falls on."""
    form = F.element_at(F.array(*(F.lit(f[0]) for f in forms)), (F.col("p_partkey") % len(forms)).cast("int") + 1)
    line = F.concat(F.lit("  "), F.replace(form, F.lit("@"), F.concat(F.lit('"'), "p_name", F.lit('"'))))
    return Q.type_files(spark, sf_dir, line, F.lit("func show() {\n"), F.lit("}\n"), ".swift")


def _forms_sql(forms: list[tuple]) -> str:
    rows = _rows((i, *form) for i, form in enumerate(forms))
    return f"fm(i, form, a, b) AS (VALUES {rows}), x AS (SELECT p_type || '.swift' AS path, (row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) + 1)::INT AS line, p_name AS t, p_name AS value, form, a, b, '' AS type_name, '' AS property_name FROM part JOIN fm ON fm.i = p_partkey % {len(forms)})"


def _form_findings(spark, sf_dir, forms):
    events = stage.written(extract.events(form_files(spark, sf_dir, forms)), "events")
    rows = D.findings(D.candidates(events, R.call_rules(spark), R.assignment_rules(spark))).where("value IS NOT NULL")
    return rows.select("path", "line", "col", "value", "context", "base", F.round("confidence", 6).alias("confidence"), "outcome")


_OUTCOME_SQL = f"round({Q.sql_score(Q.sql_trim('t'), 'b::DOUBLE')}, 6) AS confidence, CASE WHEN {Q.sql_reason('t')} IS NULL THEN 'detected' ELSE 'filtered' END AS outcome"


@query(f"WITH {_forms_sql(CALL_FORMS)} SELECT path, line, 3::INT AS col, value, a AS context, b::DOUBLE AS base, {_OUTCOME_SQL} FROM x")
def call_forms_generated(spark, sf_dir):
    return _form_findings(spark, sf_dir, CALL_FORMS)


@query(f"WITH {_forms_sql(ASSIGNMENT_FORMS)} SELECT path, line, 3::INT AS col, value, a AS context, b::DOUBLE AS base, {_OUTCOME_SQL} FROM x")
def assignment_forms_generated(spark, sf_dir):
    """Assigned strings; their place is where the assignment begins."""
    return _form_findings(spark, sf_dir, ASSIGNMENT_FORMS)


@query(f"WITH {_forms_sql(ASSET_FORMS)} SELECT path, line, value AS name, a AS type, b AS context FROM x WHERE a IS NOT NULL")
def asset_forms_generated(spark, sf_dir):
    events = stage.written(extract.events(form_files(spark, sf_dir, ASSET_FORMS)), "events")
    return D.asset_references(events).select("path", "line", "name", "type", "context")


# Texts that reports show


@query(f"WITH {Q.SCORED_SQL}, f AS (SELECT pos, list_filter([" + ", ".join(f"{{'reason': {r}, 'delta': {d}}}" for r, d in Q.sql_deltas("t")) + "], lambda f: f.delta <> 0) AS f FROM c) SELECT pos, array_to_string(list_transform(f, lambda x: printf('%+.0f%% %s', x.delta * 100, x.reason)), ', ') AS summary FROM f")
def score_summaries(spark, sf_dir):
    factors = S.score_factors(F.col("value"), F.col("type_name"), F.col("property_name"))
    return Q.scored(spark, sf_dir).select("pos", S.score_summary(factors).alias("summary"))


@query("SELECT o_orderkey, CASE WHEN length_grapheme(o_comment) > 40 THEN left_grapheme(o_comment, 40) || '…' ELSE o_comment END AS shown FROM (SELECT o_orderkey, o_orderpriority || ' ' || o_orderstatus || repeat(' 👍🏽é', (o_orderkey % 30)::INT) AS o_comment FROM orders)")
def shortened_texts(spark, sf_dir):
    text = F.concat("o_orderpriority", F.lit(" "), "o_orderstatus", F.repeat(F.lit(" 👍🏽é"), (F.col("o_orderkey") % 30).cast("int")))
    return Q.table(spark, sf_dir, "orders").select("o_orderkey", S.shortened(text).alias("shown"))


#: Context, name shown, suffix of property names.
SHOWN = [
    ("textView", "Text", ""), ("buttonLabel", "Button", "ButtonTitle"), ("labelView", "Label", "Label"), ("navigationTitle", "navigationTitle", "NavigationTitle"), ("alert", "alert", "AlertTitle"),
    ("confirmationDialog", "confirmationDialog", "DialogTitle"), ("textField", "TextField", "Placeholder"), ("accessibilityLabel", "accessibilityLabel", "AccessibilityLabel"), ("toggle", "Toggle", "ToggleLabel"),
    ("section", "Section", "SectionTitle"), ("picker", "Picker", "PickerLabel"), ("menu", "Menu", "MenuTitle"), ("disclosureGroup", "DisclosureGroup", "SectionTitle"), ("helpText", "help", "HelpText"),
    ("uiLabel", "UILabel.text", "Label"), ("uiButtonTitle", "UIButton.setTitle", "ButtonTitle"), ("uiTextFieldPlaceholder", "UITextField.placeholder", "Placeholder"), ("uiNavigationTitle", "UINavigationItem.title", "NavigationTitle"),
    ("uiAlertTitle", "UIAlertController.title", "AlertTitle"), ("uiAlertMessage", "UIAlertController.message", "AlertMessage"), ("uiAlertAction", "UIAlertAction.title", "ActionTitle"), ("uiTabBarItem", "UITabBarItem.title", "TabTitle"),
    ("staticStringConstant", "staticConstant", ""),
]


@query(f"WITH {Q.PARTS_SQL}, s(context, shown, suffix) AS (VALUES {_rows(SHOWN)}) SELECT pos, shown, suffix FROM p JOIN s USING (context)")
def context_names(spark, sf_dir):
    return Q.parts(spark, sf_dir).select("pos", R.context_name(F.col("context")).alias("shown"), R.context_suffix(F.col("context")).alias("suffix"))


@query(r"WITH v AS (SELECT DISTINCT p_partkey, CASE p_partkey % 5 WHEN 0 THEN replace(p_brand, '#', '_') WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN p_name WHEN 3 THEN lower(p_type) || '.' || p_size ELSE '_-.' END AS name FROM part) SELECT p_partkey, coalesce(nullif(array_to_string(list_transform(list_filter(regexp_split_to_array(name, '[_\-. ]'), lambda w: w <> ''), lambda w: upper(w[1:1]) || w[2:]), ''), ''), '_Namespace') AS type_name FROM v")
def asset_type_names(spark, sf_dir):
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.replace("p_brand", F.lit("#"), F.lit("_"))).when(k == 1, F.replace("p_name", F.lit(" "), F.lit("-"))).when(k == 2, F.col("p_name")).when(k == 3, F.concat(F.lower("p_type"), F.lit("."), F.col("p_size").cast("string"))).otherwise("_-.")
    return Q.table(spark, sf_dir, "part").select("p_partkey", S.asset_type_name(name).alias("type_name"))


@query(f"WITH {Q._DIAGNOSTICS_SQL} SELECT path, line, CASE severity WHEN 'suggestion' THEN 'note' ELSE severity END AS tag, count(*) AS n FROM z GROUP BY ALL")
def console_tags(spark, sf_dir):
    """Tags of verbose console lines, cut from their texts."""
    lines = report.console_lines(Q._all_diagnostics(spark, sf_dir), "verbose")
    cut = lambda i: F.regexp_extract("text", r"^([^:]*):(\d+):\d+: (\w+): .", i)
    return lines.groupBy(cut(1).alias("path"), cut(2).cast("int").alias("line"), cut(3).alias("tag")).agg(F.count("*").alias("n"))


@query(f"WITH {Q.NAMED_SQL}, l AS (SELECT 0 AS part, '' AS k, 'Scanned 7 files: ' || count(*) || ' strings, 2 warnings, 1 errors, 3 cached' AS text FROM s UNION ALL SELECT 1, namespace, '  ' || namespace || ': ' || count(*) FROM s GROUP BY namespace) SELECT row_number() OVER (ORDER BY part, k)::INT AS n, text FROM l")
def console_report_lines(spark, sf_dir):
    strings = Q.named(spark, sf_dir)
    totals = strings.agg(F.count("*").alias("strings")).withColumns({"files": F.lit(7), "warnings": F.lit(2), "errors": F.lit(1), "cache_hits": F.lit(3)})
    return spark.createDataFrame(list(enumerate(report.console_report(totals, strings), 1)), "n int, text string")


EXITS = [(0, 0, 0, False, "errors", 0), (9, 5, 0, False, "errors", 0), (9, 0, 1, False, "errors", 1), (0, 1, 0, False, "warnings", 1), (0, 0, 1, False, "warnings", 1), (9, 0, 0, False, "warnings", 0), (9, 9, 9, False, "never", 0), (1, 0, 0, True, "never", 1), (0, 9, 9, True, "never", 0)]


@query(f"SELECT strings::BIGINT AS strings, warnings::BIGINT AS warnings, errors::BIGINT AS errors, strict, fail_on, status::BIGINT AS status FROM (VALUES {_rows(EXITS)}) t(strings, warnings, errors, strict, fail_on, status)")
def exit_statuses(spark, sf_dir):
    return spark.createDataFrame([(*case[:5], report.exit_status(*case[:5])) for case in EXITS], "strings long, warnings long, errors long, strict boolean, fail_on string, status long")


IDENTIFIERS = [("i18n", True), ("_x", True), ("L10n", True), ("Übung", True), ("_", True), ("1st", False), ("", False), ("a-b", False), ("a b", False), ("a.b", False), ("x\n", False)]


@query("SELECT name, valid FROM (VALUES " + ", ".join(f"({_literal(n) if chr(10) not in n else _literal(n.strip()) + ' || chr(10)'}, {v})" for n, v in IDENTIFIERS) + ") t(name, valid)")
def identifier_cases(spark, sf_dir):
    return spark.createDataFrame([(n, is_identifier(n)) for n, _ in IDENTIFIERS], "name string, valid boolean")


# Generated files

_STRINGS_SQL = r"""a AS (SELECT CASE WHEN p_size = 1 THEN 'Common' ELSE 'N' || p_size END AS namespace, 'f' || p_partkey AS f, p_partkey, p_name FROM part),
t AS (SELECT namespace, string_agg('        /// "' || p_name || '"' || chr(10) || '        static func ' || f || '() -> String {' || chr(10) || '            String(' || chr(10) || '                localized: "' || p_name || '",' || chr(10)
 || '                table: General.table,' || chr(10) || '                bundle: General.bundle,' || chr(10) || '                comment: "c"' || chr(10) || '            )' || chr(10) || '        }' || chr(10), chr(10) ORDER BY p_partkey) AS body FROM a GROUP BY namespace),
e AS (SELECT string_agg('extension i18n {' || chr(10) || '    enum ' || namespace || ' {' || chr(10) || body || chr(10) || '    }' || chr(10) || '}' || chr(10), chr(10) ORDER BY namespace <> 'Common', namespace) AS text FROM t)"""
_HEADER_SQL = "'// Auto-generated — do not edit.' || chr(10) || '// swiftlint:disable all' || chr(10) || chr(10) || 'import {}' || chr(10) || chr(10)"
_ROOT_SQL = "'enum i18n {' || chr(10) || '    fileprivate enum General {' || chr(10) || '        static let table = \"Localizable\"' || chr(10) || '        static let bundle = Bundle.main' || chr(10) || '    }' || chr(10) || '}' || chr(10) || chr(10)"


@query(f"WITH {_STRINGS_SQL} SELECT {_HEADER_SQL.replace('{}', 'Foundation')} || {_ROOT_SQL} || text AS text FROM e")
def strings_file_text(spark, sf_dir):
    """The whole generated file of accessors, as one text."""
    size = F.col("p_size").cast("string")
    rows = Q.table(spark, sf_dir, "part").select(F.when(F.col("p_size") == 1, "Common").otherwise(F.concat(F.lit("N"), size)).alias("namespace"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("func_name"), F.col("p_name").alias("escaped_value"), F.lit("c").alias("escaped_comment"), F.lit(0).alias("part"), F.col("p_partkey").alias("pos"))
    return codegen.strings_text(rows)


def _entry_sql(kind: str, view: str, name: str, table: str) -> str:
    ident = Q.sql_identifier(name)
    return f"SELECT '    // MARK: - {kind}' || chr(10) || chr(10) || string_agg('    /// Asset: \"' || {name} || '\"' || chr(10) || '    public static func ' || {ident} || '() -> {view} {{' || chr(10) || '        {view}(\"' || {name} || '\")' || chr(10) || '    }}' || chr(10), chr(10) ORDER BY {name}) AS x FROM {table}"


@query(f"WITH i AS ({_entry_sql('Images', 'Image', 'n_name', 'nation')}), c AS ({_entry_sql('Colors', 'Color', 'r', '(SELECT lower(r_name) || ' + chr(39) + ' tint' + chr(39) + ' AS r FROM region)')}) SELECT {_HEADER_SQL.replace('{}', 'SwiftUI')} || 'public enum Assets {{' || chr(10) || chr(10) || i.x || chr(10) || c.x || chr(10) || '}}' || chr(10) AS text FROM i, c".replace("{{", "{").replace("}}", "}"))
def assets_file_text(spark, sf_dir):
    """The whole generated file of assets, as one text."""
    images = Q.table(spark, sf_dir, "nation").select(F.lit("image").alias("type"), F.col("n_name").alias("full_name"))
    colors = Q.table(spark, sf_dir, "region").select(F.lit("color").alias("type"), F.concat(F.lower("r_name"), F.lit(" tint")).alias("full_name"))
    return spark.createDataFrame([(codegen.assets_file(images.unionByName(colors)),)], "text string")


_B, _E = codegen.BEGIN, codegen.END
#: Lines of a file, and of what it is when "new" is put between its first markers (none: it has none in order).
REGIONS = [(["a", _B, "old", _E, "z"], ["a", _B, "new", _E, "z"]), ([f"  {_B}", f"\t{_E}"], [f"  {_B}", "new", f"\t{_E}"]), ([_E, _B], None), (["a"], None), ([_B, "x"], None), ([_B, "1", _E, _B, "2", _E], [_B, "new", _E, _B, "2", _E]), ([f"x {_B}", _E], None)]


@query(f"SELECT n::INT AS n, replace(merged, '|', chr(10)) AS merged FROM (VALUES {_rows((i, None if new is None else '|'.join(new)) for i, (_, new) in enumerate(REGIONS))}) t(n, merged)")
def region_cases(spark, sf_dir):
    return spark.createDataFrame([(i, codegen.merged("\n".join(old), "new")) for i, (old, _) in enumerate(REGIONS)], "n int, merged string")


# Source trees and replayed results


def write_tree(spark: SparkSession, files: dict[str, bytes]) -> str:
    """A folder of small files in the shared folder."""
    jvm, base = spark.sparkContext._jvm, f"{stage.folder(spark)}/loquat/tree-{uuid.uuid4().hex}"
    for name, content in files.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(content))
        out.close()
    return base


def _tree(spark, sf_dir) -> str:
    """A file a nation: visible, in a hidden folder, in a package, under an excluded folder, not UTF-8, or of another kind."""
    files = {}
    for row in Q.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
        place = ("App/{}.swift", "App/.hidden/{}.swift", "App/Kit.framework/{}.swift", "Pods/{}.swift", "Deep/er/{}View.swift", "App/{}.txt")[row.n_nationkey % 6]
        bad = b"\xff" if row.n_nationkey % 4 == 0 else b""
        files[place.format(row.n_name)] = f'let a = Text("Hello {row.n_name}")\n'.encode() + bad
    return write_tree(spark, files)


_TREE_SQL = "n AS (SELECT n_name, CASE n_nationkey % 6 WHEN 0 THEN 'App/' || n_name || '.swift' ELSE 'Deep/er/' || n_name || 'View.swift' END AS rel_path, n_nationkey % 4 <> 0 AS readable FROM nation WHERE n_nationkey % 6 IN (0, 4))"


@query(f"WITH {_TREE_SQL} SELECT rel_path, readable, CASE WHEN readable THEN sha256('let a = Text(\"Hello ' || n_name || '\")' || chr(10)) END AS hash FROM n")
def collected_files(spark, sf_dir):
    """Files of a tree that a scan reads; hashes of those that are UTF-8."""
    found, _ = readers.source_files(spark, [_tree(spark, sf_dir)], ["Pods/**"])
    readable = F.col("content").isNotNull()
    return found.select("rel_path", readable.alias("readable"), F.when(readable, F.col("hash")).alias("hash"))


@query(f"WITH {_TREE_SQL}, f AS (SELECT * FROM n UNION ALL SELECT n_name, 'Pods/' || n_name || '.swift', n_nationkey % 4 <> 0 FROM nation WHERE n_nationkey % 6 = 3) SELECT regexp_extract(rel_path, '[^/]*$') AS file, 'unreadable' AS kind, 'error' AS severity, 0::BIGINT AS missing_sources FROM f WHERE NOT readable UNION ALL SELECT NULL, 'missing_source', 'error', 1")
def unreadable_files(spark, sf_dir):
    """Errors of a scan of a tree, and of one that is not there; without exclusions."""
    tree = _tree(spark, sf_dir)
    told = scan.run(spark, Config(sources=(tree, f"{tree}/absent")), tree)["diagnostics"].where("severity = 'error'")
    return told.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "kind", "severity", F.when(F.col("kind") == "missing_source", 1).otherwise(0).cast("long").alias("missing_sources"))


def _catalog_files(spark, sf_dir) -> str:
    files = {}
    for row in Q.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():
        kind = "imageset" if row.n_nationkey % 2 else "colorset"
        files[f"Res/Media.xcassets/group{row.n_regionkey}/{row.n_name}.{kind}/Contents.json"] = b"{}"
    for key in {x.n_regionkey for x in Q.table(spark, sf_dir, "nation").select("n_regionkey").collect()}:
        spaced = "true" if key % 2 else "false"
        files[f"Res/Media.xcassets/group{key}/Contents.json"] = f'{{"properties": {{"provides-namespace": {spaced}}}}}'.encode()
        for folder in ("a", "b", ".hidden"):
            text = f'{{"sourceLanguage": "en", "strings": {{"key {key}": {{"localizations": {{"en": {{"stringUnit": {{"state": "new", "value": "{folder} {key}"}}}}}}}}, "only {folder}": {{}}}}}}'
            files[f"Res/{folder}/R{key}.xcstrings"] = text.encode()
    return write_tree(spark, files)


@query("SELECT CASE WHEN n_nationkey % 2 = 1 THEN 'image' ELSE 'color' END AS type, CASE WHEN n_regionkey % 2 = 1 THEN 'group' || n_regionkey || '/' ELSE '' END || n_name AS full_name FROM nation")
def asset_tree(spark, sf_dir):
    return readers.assets(spark, _catalog_files(spark, sf_dir)).select("type", "full_name")


@query("SELECT DISTINCT 'key ' || n_regionkey AS key, 'b ' || n_regionkey AS source_value, 1::INT AS translation_count FROM nation UNION ALL SELECT 'only a', 'only a', 0 UNION ALL SELECT 'only b', 'only b', 0")
def string_catalog_tree(spark, sf_dir):
    return readers.string_catalogs(spark, _catalog_files(spark, sf_dir)).select("key", "source_value", "translation_count")


@query(f"WITH {Q._LINES_SQL}, {Q._FOUND_SQL}, h AS (SELECT count(DISTINCT path) AS hits FROM g WHERE left(path, 1) < 'M') SELECT path, line, value, context, round({Q.sql_score(Q.sql_trim('t'), 'base')}, 6) AS confidence, hits, 1::BIGINT AS stale FROM x, h WHERE k < 3 AND {Q.sql_reason('t')} IS NULL")
def replayed_strings(spark, sf_dir):
    """A scan whose cache knows some of the files, and one that is gone: the same strings as without it."""
    pieces = stage.written(Q.sources(spark, sf_dir), "pieces")
    one = pieces.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("piece", F.sha2(F.col("content").cast("binary"), 256).alias("hash")))).alias("hashes"))
    files = pieces.join(one.select("path", F.sha2(F.array_join("hashes.hash", "").cast("binary"), 256).alias("hash")), "path")
    settings = Config(minimum_confidence=0.0)
    empty, gone = spark.createDataFrame([], scan.CACHE), spark.createDataFrame([("gone.swift", 0, 'let a = Text("Gone")', "0")], "path string, piece long, content string, hash string")
    known = stage.written(scan.analyse_incrementally(files.where("path < 'M'").unionByName(gone), settings, empty).cache, "cache")
    again = scan.analyse_incrementally(files, settings, known)
    return again.detected.where("NOT has_interpolation").select("path", "line", "value", "context", F.round("confidence", 6).alias("confidence"), F.lit(again.cache_hits).cast("long").alias("hits"), F.lit(again.stale).cast("long").alias("stale"))


@query("SELECT count(*) AS strings, count(*) AS namespaces, 0::BIGINT AS warnings, 0::BIGINT AS missing_assets FROM nation WHERE n_nationkey % 6 IN (0, 3, 4)")
def facade_totals(spark, sf_dir):
    """The simple scan of a folder: no exclusions, no cache."""
    files = {}
    for row in Q.table(spark, sf_dir, "nation").where("n_nationkey % 6 IN (0, 3, 4)").select("n_nationkey", "n_name").collect():
        files[f"d{row.n_nationkey % 3}/{row.n_name}View.swift"] = f'let a = Text("Hello {row.n_name}")\n'.encode()
    files["Media.xcassets/Contents.json"] = b"{}"
    return scan.facade(spark, write_tree(spark, files))["totals"]
