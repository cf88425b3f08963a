"""Reports of a scan: JSON, annotations, console lines, exit status."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquat.functions import strings as S
from loquat.operators import analysis as A
from loquat.operators import rules as R


def code(severity):
    return F.when(severity == "warning", "SL001").when(severity == "error", "SL002").otherwise("SL000")


def shown_severity(severity):
    """Suggestions are reported as notes."""
    return F.when(severity.isin("warning", "error"), severity).otherwise("note")


def diagnostic_rows(diagnostics: DataFrame) -> DataFrame:
    """code, severity, message, file, line of all but notes."""
    return diagnostics.where("severity <> 'note'").select(code(F.col("severity")).alias("code"), shown_severity(F.col("severity")).alias("severity"), "message", F.col("path").alias("file"), "line")


def string_rows(strings: DataFrame) -> DataFrame:
    """A row a string, with what reports show. Confidence has three decimals."""
    name = S.property_name(F.col("value"), R.context_suffix(F.col("context")))
    return strings.select("namespace", F.col("path").alias("file"), "pos", "value", R.context_name(F.col("context")).alias("context"), F.round("confidence", 3).alias("confidence"), F.col("has_interpolation").alias("hasInterpolation"), name.alias("suggested_property_name"), "line")


def json_report(summary: DataFrame, diagnostics: DataFrame, strings: DataFrame, version: str = "1.0") -> str:
    """Sorted keys, indented. Rows are nested by Spark; the report of a project is a driver-sized text."""
    scanned = summary.toJSON().first() if hasattr(summary, "toJSON") else None
    files = string_rows(strings).groupBy("namespace", "file").agg(F.array_sort(F.collect_list(F.struct("pos", "value", "context", "confidence", "hasInterpolation", "suggested_property_name", "line", "file"))).alias("strings"))
    namespaces = [{"name": x["namespace"], "sourceFile": x["file"], "strings": [{k: v for k, v in s.asDict().items() if k != "pos"} for s in x["strings"]]} for x in files.orderBy("file").collect()]
    told = [x.asDict() for x in diagnostic_rows(diagnostics).orderBy("file", "line", "message").collect()]
    return json.dumps({"schema_version": "1", "version": version, "scanned": json.loads(scanned), "diagnostics": told, "namespaces": namespaces}, indent=2, sort_keys=True, ensure_ascii=False)


def annotations(diagnostics: DataFrame) -> DataFrame:
    """One line each for warnings and errors: ``::level file=,line=,col=,title=...::message``."""
    place = F.when(F.col("path").isNotNull(), F.format_string("file=%s,line=%d,col=%d,", "path", "line", "col")).otherwise("")
    rows = diagnostics.where(A.severity_rank(F.col("severity")) >= 2)
    return rows.select("path", "pos", F.concat(F.lit("::"), "severity", F.lit(" "), place, F.lit("title="), code(F.col("severity")), F.lit("::"), "message").alias("text"))


def console_lines(diagnostics: DataFrame, verbosity: str = "normal") -> DataFrame:
    """``file:line:col: tag: message`` from a severity on: notes if verbose, warnings, or errors only if quiet."""
    least = {"verbose": 0, "normal": 2, "quiet": 3}[verbosity]
    place = F.when(F.col("path").isNotNull(), F.format_string("%s:%d:%d: ", "path", "line", "col")).otherwise("")
    rows = diagnostics.where(A.severity_rank(F.col("severity")) >= least)
    return rows.select("path", "pos", F.concat(place, shown_severity(F.col("severity")), F.lit(": "), "message").alias("text"))


def namespace_counts(strings: DataFrame) -> DataFrame:
    return strings.groupBy("namespace").agg(F.count("*").alias("strings")).orderBy("namespace")


def console_report(summary: DataFrame, strings: DataFrame, verbose: bool = False) -> list[str]:
    """Totals, then a line a namespace; every string too if verbose. The driver gets these lines only."""
    row = summary.first()
    lines = [f"Scanned {row.files} files: {row.strings} strings, {row.warnings} warnings, {row.errors} errors, {row.cache_hits} cached"]
    lines += [f"  {x['namespace']}: {x['strings']}" for x in namespace_counts(strings).collect()]
    if verbose:
        told = strings.select("path", "pos", F.format_string('  %s:%d:%d [%s] "%s" (%.2f)', "path", "line", "col", R.context_name(F.col("context")), "value", "confidence").alias("text"))
        lines += [x["text"] for x in told.orderBy("path", "pos").collect()]
    return lines


def exit_status(strings: int, warnings: int, errors: int, strict: bool = False, fail_on: str = "errors") -> int:
    """1 if strict and any string is left, or by what it shall fail on: errors, warnings (and errors), never."""
    if strict and strings:
        return 1
    return int({"errors": errors > 0, "warnings": errors + warnings > 0, "never": False}[fail_on])
