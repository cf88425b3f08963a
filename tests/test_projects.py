import os

import duckdb
import pytest

from loquat import projects
from loquat.sources import readers

TABLES = "/root/testdata/sf0.001"
CHEAP = ["assignment_forms_generated", "asset_forms_generated", "score_summaries", "shortened_texts", "context_names", "asset_type_names", "console_report_lines", "exit_statuses", "identifier_cases", "strings_file_text", "assets_file_text", "region_cases", "collected_files", "string_catalog_tree"]


def test_a_catalog_describes_itself_too(spark):
    rows = [("M.xcassets/Contents.json", "{}"), ("M.xcassets/a.imageset/Contents.json", "{}"), ("M.xcassets/g/Contents.json", '{"properties": {"provides-namespace": true}}'), ("M.xcassets/g/b.colorset/Contents.json", None)]
    found = readers.assets_of(spark.createDataFrame(rows, "path string, content string")).collect()
    assert sorted(map(tuple, found)) == [("color", "g/b"), ("image", "a")]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, name):
    base = duckdb.connect()
    for file in os.listdir(TABLES):
        base.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{file}'")
    want = base.sql(projects.ORACLE_SQL[name])
    got = projects.QUERIES[name](spark, TABLES).select(*want.columns).collect()
    assert len(got) > 0 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_a_generated_file_is_a_row_without_the_driver(spark, monkeypatch):
    """strings_file_text: nothing is collected; the text is that of a file, in order, of accessors of many pieces."""
    from pyspark.sql.classic.dataframe import DataFrame

    from loquat.plans import codegen

    monkeypatch.setattr(codegen, "PER_PIECE", 3)
    rows = spark.createDataFrame([(n, f"f{k}", f"v{k}", "c", 0, k) for n in ("B", "Common", "A") for k in (7, 3, 12, 1)], "namespace string, func_name string, escaped_value string, escaped_comment string, part int, pos int")
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", lambda self: pytest.fail("collected"))
        text = codegen.strings_text(rows)
    lines = text.first()["text"].split("\n")
    assert [x.split()[1] for x in lines if x.startswith("    enum ")] == ["Common", "A", "B"]
    assert [x.split()[2] for x in lines if "static func" in x] == ["f1()", "f3()", "f7()", "f12()"] * 3
    assert codegen.strings_file(rows) == "\n".join(lines)
