"""Scan and generate: a project's strings and assets become its generated files, with an exit status.

Accessors of the generated file that is already there stay if sources refer to them, also when their
literal is gone: generating again adds, it does not take away.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquat.operators import analysis as A
from loquat.plans import codegen, report, scan
from loquat.plans.config import Config
from loquat.sources import extract, readers


def preserved_accessors(spark: SparkSession, generated: str | Path, existing: DataFrame, root: str) -> DataFrame | None:
    """Accessors of a generated file (a path or URI) that references in ``existing`` name; none without such a file."""
    before = codegen.read_file(generated)
    if before is None:
        return None
    text = codegen.region(before)
    parsed = extract.accessors(spark.createDataFrame([(str(generated), text)], "path string, content string"), root)
    return A.preserved(parsed.select("namespace", "func_name", "escaped_value", "escaped_comment"), A.referenced_accessors(existing, root))


def run(spark: SparkSession, config: Config, base: str, cache_path: str | None = None, dry_run: bool = False, fail_on: str = "errors", common: bool = False) -> dict:
    """As ``scan.run``, and ``files``: (path, text) of what was or, if ``dry_run``, would be written; ``exit``: the status.

    ``common``: values of several namespaces are generated once, in a namespace of their own. Migration
    mode "strict" fails as long as strings are left."""
    out = scan.run(spark, config, base, cache_path, references_to=(config.output.enum_name,))
    target, written = codegen.beside(base, config.output.path), []
    strings = out["detected"]
    if common:
        shared = A.common_strings(strings).withColumn("namespace", F.lit("Common"))
        strings = A.without_common(strings).unionByName(shared)
    kept = preserved_accessors(spark, target, out["referenced"], config.output.enum_name)
    text = codegen.strings_file(codegen.string_accessors(strings, kept), config.output.enum_name, config.output.table_name)
    text, where = codegen.write_file(target, text, config.output.merge_strategy, dry_run)
    written.append((str(where), text))
    if config.assets.enabled:
        assets = readers.assets(spark, base)
        text = codegen.assets_file(assets, config.assets.enum_name, image_resource=config.assets.use_image_resource)
        text, where = codegen.write_file(codegen.beside(base, config.assets.path), text, "overwrite", dry_run)
        written.append((str(where), text))
    row = out["summary"].first()
    status = report.exit_status(row.strings, row.warnings, row.errors, config.migration == "strict", fail_on)
    return out | {"generated": written, "preserved": 0 if kept is None else kept.count(), "exit": status}
