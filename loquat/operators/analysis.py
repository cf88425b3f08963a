"""Groups over detected strings: namespaces, common and duplicate values, catalogs, assets, the result cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loquat.functions import strings as S
from loquat.operators import order
from loquat.plans import stage


def with_namespace(detected: DataFrame, strategy: str = "file", path: str = "path") -> DataFrame:
    """Column ``namespace`` by file name, directory and file name, or the latter for colliding file names only (auto)."""
    raw = S.namespace_of_file(F.col(path))
    if strategy == "file":
        return detected.withColumn("namespace", raw)
    if strategy == "directory":
        return detected.withColumn("namespace", S.directory_namespace(F.col(path), raw))
    if strategy != "auto":
        raise ValueError(strategy)
    # Colliding names come from a few short rows a file; strings themselves are not regrouped.
    names = detected.select(path).distinct().withColumn("_raw", raw).groupBy("_raw").agg((F.count("*") > 1).alias("_collides"))
    out = detected.withColumn("_raw", raw).join(names, "_raw")
    return out.withColumn("namespace", F.when(F.col("_collides"), S.directory_namespace(F.col(path), F.col("_raw"))).otherwise(F.col("_raw"))).drop("_raw", "_collides")


def namespace_collisions(paths: DataFrame, path: str = "path") -> DataFrame:
    """namespace, files (sorted paths), message of every file-derived name that several files share."""
    rows = paths.select(path).distinct().select(S.namespace_of_file(F.col(path)).alias("namespace"), F.col(path).alias("file"))
    groups = rows.groupBy("namespace").agg(F.sort_array(F.collect_list("file")).alias("files")).where(F.size("files") > 1)
    names = F.array_join(F.transform("files", S.file_name), ", ")
    return groups.withColumn("message", F.format_string('The namespace "%2$s" comes from %1$d files (%3$s); namespace_strategy: auto tells them apart', F.size("files"), "namespace", names))


def shared_values(strings: DataFrame) -> DataFrame:
    """value and its sorted namespaces, of values without interpolation in at least two namespaces."""
    pairs = strings.where(~F.col("has_interpolation")).select("value", "namespace").distinct()
    return pairs.groupBy("value").agg(F.sort_array(F.collect_list("namespace")).alias("namespaces")).where(F.size("namespaces") >= 2)


def _in_several(strings: DataFrame) -> DataFrame:
    """Values of ``shared_values`` alone: two numbers a value decide it, however many namespaces have it."""
    rows = strings.where(~F.col("has_interpolation")).groupBy("value").agg(F.min("namespace").alias("_a"), F.max("namespace").alias("_b"))
    return rows.where("_a < _b").select("value")


def common_strings(strings: DataFrame) -> DataFrame:
    """One representative row a shared value: the first by namespace and position. ``strings`` has namespace, path, pos."""
    shared = _in_several(strings)
    rows = strings.where(~F.col("has_interpolation")).join(shared, "value", "left_semi")
    columns = [c for c in strings.columns]
    first = rows.groupBy("value").agg(F.min_by(F.struct(*[c for c in columns if c != "value"]), F.struct("namespace", "path", "pos")).alias("r"))
    return first.select("value", "r.*").select(columns)


def without_common(strings: DataFrame) -> DataFrame:
    """Strings but shared values (interpolated ones of equal text included); namespaces left empty vanish by themselves."""
    return strings.join(_in_several(strings), "value", "left_anti").select(strings.columns)


def duplicate_values(strings: DataFrame) -> DataFrame:
    """value, n (occurrences), namespaces (how many), first_pos, last_pos of values in more than one namespace.

    Where they occur: ``occurrences``. Nothing grows with a value's occurrences but their number."""
    rows = strings.where(~F.col("has_interpolation"))
    counts = F.count("*").alias("n"), F.count_distinct("namespace").alias("namespaces"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    return rows.groupBy("value").agg(*counts).where("namespaces > 1")


def occurrences(strings: DataFrame, values: DataFrame) -> DataFrame:
    """The strings of some values, a row each."""
    return strings.where(~F.col("has_interpolation")).join(values.select("value"), "value", "left_semi").select(strings.columns)


def duplicate_catalog_values(catalog: DataFrame) -> DataFrame:
    """value (the key where there is no source value) and sorted keys, where several keys share it."""
    rows = catalog.select(F.coalesce("source_value", "key").alias("value"), "key")
    return rows.groupBy("value").agg(F.sort_array(F.collect_list("key")).alias("keys")).where(F.size("keys") > 1)


def missing_from_catalog(strings: DataFrame, catalog: DataFrame) -> DataFrame:
    """value, n (occurrences), namespaces (how many), and path, pos, line, col of the first occurrence, of detected values
    that are no catalog key."""
    rows = strings.where(~F.col("has_interpolation")).join(catalog.select(F.col("key").alias("value")), "value", "left_anti")
    first = F.min(F.struct(*(c for c in ("path", "pos", "line", "col") if c in strings.columns))).alias("first")
    return rows.groupBy("value").agg(F.count("*").alias("n"), F.count_distinct("namespace").alias("namespaces"), first).select("value", "n", "namespaces", "first.*")


def in_listing_order(rows: DataFrame, value: str = "value") -> DataFrame:
    """Rows with their ``place`` (from 1) in a listing by the lower-cased value, then the value."""
    return order.placed(rows, F.lower(F.col(value)), value).withColumn("place", F.col("place").cast("int"))


def files_in_order(files: DataFrame) -> DataFrame:
    """Files with their ``place`` (from 1): those that cannot be read first, then by path."""
    return order.placed(files, F.col("content").isNotNull(), "path")


def findings_in_order(findings: DataFrame) -> DataFrame:
    """Strings or diagnostics with their ``place``: what has no file first, then by path, then as they stand in the file.

    ``findings`` has path and pos, and ord and kind where it has them."""
    within = [c for c in ("pos", "ord", "line", "col", "kind", "message") if c in findings.columns]
    return order.placed(findings, F.coalesce("path", F.lit("")), *within)


def by_confidence(strings: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Strings of at least a confidence, with their ``place``: the surest first, equal ones by path and position."""
    rows = strings.where(F.col("confidence") >= F.lit(float(threshold)))
    return order.placed(rows, F.desc("confidence"), "path", "pos")


def orphaned_in_catalog(strings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog keys that no detected value equals."""
    return catalog.select("key").join(strings.where(~F.col("has_interpolation")).select(F.col("value").alias("key")), "key", "left_anti")


def missing_assets(references: DataFrame, assets: DataFrame) -> DataFrame:
    """References without an asset of their type and name, one row each."""
    return references.join(assets.select("type", F.col("full_name").alias("name")), ["type", "name"], "left_anti")


def split_suppressed(literals: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Column ``suppressed``: whether the index has the literal's location."""
    marked = index.select(*keys, F.lit(True).alias("suppressed")).distinct()
    return literals.join(marked, keys, "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))


def deduplicated_names(strings: DataFrame) -> DataFrame:
    """Strings with an ``accessor`` name; of equal names in a namespace the least decorated stays, then the earliest."""
    rows = strings.where(~F.col("has_interpolation"))
    rest = [c for c in rows.columns if c not in ("namespace", "accessor")]
    best = F.min_by(F.struct(*rest), F.struct(S.decorative_count(F.col("value")), "path", "pos"))
    return rows.groupBy("namespace", "accessor").agg(best.alias("_r")).select("namespace", "accessor", "_r.*").select(rows.columns)


def unique_identifiers(assets: DataFrame) -> DataFrame:
    """Column ``identifier`` of assets (type, full_name): unique within a directory; images go first.

    In order (images, then by full name) an asset takes its name, or else the first of name_2, name_3, ... that is free.
    Names are parts put together without the underscores between them, so the only underscore in one is in front: no
    name is another with a number, and the k-th asset of a name in a directory has number k. Ranks come from one sort of
    all rows, which deals the assets of one name over as many tasks as they fill."""
    parts = F.split("full_name", "/")
    rows = assets.select("type", "full_name", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("directory"), S.asset_identifier(F.element_at(parts, -1)).alias("base"))
    rows = order.ranked(rows, ["directory", "base"], [F.col("type") != "image", F.col("full_name")], name="k")
    identifier = F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("k").cast("string")))
    return rows.select("type", "full_name", "directory", identifier.alias("identifier"))


def cache_hits(files: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Cached rows of files whose path, hash and version agree."""
    return cache.where(F.col("version") == version).join(files.select("path", "hash"), ["path", "hash"], "left_semi")


def cache_misses(files: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    return files.join(cache.where(F.col("version") == version).select("path", "hash"), ["path", "hash"], "left_anti")


def stale_entries(files: DataFrame, cache: DataFrame) -> DataFrame:
    return cache.join(files.select("path"), "path", "left_anti")


def updated_cache(cache: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """Fresh entries replace those of their paths; entries of files that are gone are dropped."""
    kept = cache.join(files.select("path"), "path", "left_semi").join(fresh.select("path"), "path", "left_anti")
    return kept.unionByName(fresh)


def _told(rows: DataFrame, kind: str, severity: str, message) -> DataFrame:
    """kind, severity, message, and path, line, col, pos where the rows have them."""
    nowhere = (("path", "string"), ("line", "int"), ("col", "int"), ("pos", "int"))
    places = (F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in nowhere)
    return rows.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), message.alias("message"), *places)


def collision_diagnostics(collisions: DataFrame) -> DataFrame:
    """A warning for every namespace that several files share."""
    return _told(collisions, "collision", "warning", F.col("message"))


def missing_key_diagnostics(missing: DataFrame) -> DataFrame:
    """A warning at the first place of every value that no catalog has."""
    return _told(missing, "missing_key", "warning", F.format_string('"%s" is used, but no string catalog has it as a key', "value"))


def orphaned_key_diagnostics(orphaned: DataFrame) -> DataFrame:
    return _told(orphaned, "orphaned_key", "note", F.format_string('No source was found to use the catalog key "%s"', "key"))


def duplicate_value_diagnostics(groups: DataFrame) -> DataFrame:
    """A suggestion for every value that several catalog keys share."""
    return _told(groups, "duplicate_value", "suggestion", F.format_string('%2$d catalog keys share the value "%1$s": %3$s', "value", F.size("keys"), F.array_join("keys", ", ")))


def referenced_accessors(references: DataFrame, root: str) -> DataFrame:
    """Distinct "namespace.function" keys of references to the generated root."""
    rest = F.substring(F.col("expression"), len(root) + 2, 1 << 30)
    rows = references.where(F.startswith("expression", F.lit(f"{root}.")))
    return rows.select(F.array_join(F.slice(F.split(rest, r"\."), 1, 2), ".").alias("key")).where(F.col("key").contains(".")).distinct()


def preserved(accessors: DataFrame, referenced: DataFrame) -> DataFrame:
    return accessors.join(referenced, F.concat_ws(".", "namespace", "func_name") == F.col("key"), "left_semi")


def preserved_not_fresh(preserved: DataFrame, fresh: DataFrame) -> DataFrame:
    """Preserved accessors whose name no fresh one of the namespace has; the first of equal ones."""
    rest = preserved.join(fresh.select("namespace", F.col("accessor").alias("func_name")), ["namespace", "func_name"], "left_anti")
    return rest.groupBy("namespace", "func_name").agg(F.min(F.struct("escaped_value", "escaped_comment")).alias("a")).select("namespace", "func_name", "a.*")


def severity_counts(diagnostics: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("severity") == s)
    return diagnostics.agg(is_("error").alias("errors"), is_("warning").alias("warnings"), is_("suggestion").alias("suggestions"), is_("note").alias("notes"), (is_("error") > 0).alias("has_errors"))


SEVERITIES = ["note", "suggestion", "warning", "error"]


def severity_rank(severity):
    """Position of a severity; an unknown one is a note."""
    return F.greatest(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1, F.lit(0))
