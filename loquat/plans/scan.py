"""The scan: source tree to detected strings, diagnostics and a summary, incrementally if asked.

Files are read and parsed once: events and findings are written to the shared folder, and every analysis
derives from them. In incremental mode only files
whose hash or settings changed are parsed; results of the others are replayed from a store keyed by path
(``store``), of which only the buckets of changed files are rewritten. References to generated accessors are
an inverted table of the same store (accessor, path), kept up with it: who still refers to what is known without parsing.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loquat.functions import strings as S
from loquat.operators import analysis as A
from loquat.operators import detect as D
from loquat.operators import rules as R
from loquat.plans import stage
from loquat.plans.store import Store
from loquat.plans.config import Config
from loquat.sources import extract, readers

VERSION = "1"
_DIAGNOSTIC = "path string, line int, col int, pos int, kind string, severity string, message string"
_SCORE = "struct<base:double,factors:array<struct<reason:string,delta:double>>,final:double>"
_STRING = f"pos:int,ord:int,value:string,line:int,col:int,context:string,confidence:double,has_interpolation:boolean,type_name:string,property_name:string,function_name:string,score:{_SCORE}"
_REFERENCE = "pos:int,line:int,col:int,pattern:string,expression:string,kind:string"
CACHE = f"path string, hash string, version string, strings array<struct<{_STRING}>>, diagnostics array<struct<line:int,col:int,pos:int,kind:string,severity:string,message:string>>, existing array<struct<{_REFERENCE}>>"


#: References to generated accessors, by accessor ("namespace.function").
REFERENCES = "accessor string, root string, path string, pos int, line int, col int, pattern string, expression string, kind string"


@dataclass
class Scan:
    files: DataFrame
    detected: DataFrame
    diagnostics: DataFrame
    existing: DataFrame
    cache: DataFrame | None = None
    cache_hits: int = 0
    stale: int = 0
    events: DataFrame | None = None
    #: Files that were parsed, and references to generated roots; of scans that keep a store.
    parsed: int | None = None
    referenced: DataFrame | None = None


def fingerprint(config: Config, roots: tuple[str, ...] = (), filters: Sequence[S.Filter] = ()) -> str:
    """Version of cached results: unlike a bare version, settings that change results change it too, and so do the
    roots whose references are kept, and a caller's rules."""
    return f"{VERSION}:{hashlib.sha256(repr((dataclasses.astuple(config), *sorted(roots), *(f.key() for f in filters))).encode()).hexdigest()[:16]}"


def analyse(files: DataFrame, config: Config = Config(), extra_rules: list[tuple] = (), extra_assignment_rules: list[tuple] = (), filters: Sequence[S.Filter] = ()) -> Scan:
    """Strings, diagnostics and references of files (path, content), by the rules of the package and a caller's."""
    spark = files.sparkSession
    readable = files.where("content IS NOT NULL")
    events = stage.written(extract.events(readable), "events")
    found = D.candidates(events, R.call_rules(spark, extra_rules), R.assignment_rules(spark, extra_assignment_rules), config.string_discovery.static_constants)
    functions = list(config.existing_localization.exclude_arguments_of)
    suppressed = D.excluded_arguments(events, functions) if functions else None
    ignored = extract.ignored_lines(readable, config.ignore_marker)
    findings = stage.written(D.findings(found, config.minimum_confidence, ignored, suppressed, config.string_discovery.indirect_argument_hints, filters), "findings")
    diagnostics = D.diagnostics(findings, config.ignore_marker, filters)
    if config.accessibility_audit:
        audit = D.image_audit(events).join(ignored.withColumn("_i", F.lit(True)), ["path", "line"], "left")
        note = F.col("_i").isNotNull()
        audit = audit.withColumns({"severity": F.when(note, "note").otherwise(F.col("severity")), "message": F.when(note, f"Suppressed accessibility warning — {config.ignore_marker}").otherwise(F.col("message"))})
        diagnostics = diagnostics.unionByName(audit.select(diagnostics.columns))
    unread = readers.unreadable(files).select("path", *(F.lit(None).cast("int").alias(c) for c in ("line", "col", "pos")), F.lit("unreadable").alias("kind"), "severity", "message")
    existing = D.existing_references(events, list(config.existing_localization.patterns))
    return Scan(files, D.detected(findings), diagnostics.unionByName(unread), existing, events=events)


#: Positions in a file whose results are one row of the cache: a file of many events has several.
PER_ROW = 10_000


def _row_number():
    return F.floor(F.coalesce("pos", F.lit(0)) / PER_ROW).alias("_row")


def _nested(rows: DataFrame, name: str) -> DataFrame:
    """A row a path and range of positions with its rows as the cache's array of that name."""
    fields = next(f.dataType.elementType.fieldNames() for f in _parsed(CACHE) if f.name == name)
    return rows.groupBy("path", _row_number()).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def _parsed(schema: str):
    return T._parse_datatype_string(schema).fields


def cache_entries(files: DataFrame, scan: Scan, version: str) -> DataFrame:
    """The cache's rows of freshly analysed files."""
    entries = files.select("path", "hash", F.lit(version).alias("version")).distinct()
    results = (("strings", scan.detected), ("diagnostics", scan.diagnostics), ("existing", scan.existing))
    numbers = entries.select("path", F.lit(0).cast("long").alias("_row"))
    for _, rows in results:
        numbers = numbers.unionByName(rows.select("path", _row_number()))
    entries = entries.join(numbers.distinct(), "path")
    for name, rows in results:
        kind = next(f.dataType for f in _parsed(CACHE) if f.name == name)
        entries = entries.join(_nested(rows, name), ["path", "_row"], "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return entries.select(*(f.name for f in _parsed(CACHE)))


def _replayed(files: DataFrame, rows: DataFrame, like: Scan, **more) -> Scan:
    """Results from the cache's rows of a scan's files."""
    flat = lambda name: rows.select("path", F.inline(name)).select(getattr(like, {"strings": "detected"}.get(name, name)).columns)
    return Scan(files, flat("strings"), flat("diagnostics"), flat("existing"), **more)


def analyse_incrementally(files: DataFrame, config: Config, cache: DataFrame) -> Scan:
    """As ``analyse``; files that the cache knows with the same hash and settings are not parsed."""
    version = fingerprint(config)
    files = stage.written(files, "files")
    hits, misses = A.cache_hits(files, cache, version), A.cache_misses(files, cache, version)
    fresh = analyse(misses, config)
    entries = stage.written(cache_entries(misses, fresh, version), "entries")
    whole = A.updated_cache(cache, entries, files)
    rows = stage.written(hits.unionByName(entries).join(files.select("path").distinct(), "path", "left_semi"), "replayed")
    # References to generated accessors may be in any file, parsed again or not: only those of parsed ones are events.
    return _replayed(files, rows, fresh, cache=whole, cache_hits=hits.select("path").distinct().count(), stale=A.stale_entries(files, cache).select("path").distinct().count(), events=fresh.events)


def open_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, {"entries": CACHE, "references": REFERENCES}, {"references": ["accessor", "path", "pos"]})


def references_by_accessor(references: DataFrame, roots: list[str]) -> DataFrame:
    """References as rows of the inverted table: the accessor is what follows the root, two names at most."""
    out = references.where(F.lit(False)).select(F.lit("").alias("accessor"), F.lit("").alias("root"), *references.columns)
    for root in roots:
        rest = F.substring(F.col("expression"), len(root) + 2, F.lit(1 << 30))
        rows = references.where((F.col("expression") == root) | F.startswith("expression", F.lit(f"{root}.")))
        out = out.unionByName(rows.select(F.array_join(F.slice(F.split(rest, r"\."), 1, 2), ".").alias("accessor"), F.lit(root).alias("root"), *references.columns))
    return out


def analyse_with_store(files: DataFrame, config: Config, store: Store, roots: tuple[str, ...], filters: Sequence[S.Filter] = (), removed: DataFrame | None = None) -> tuple[Scan, str | None]:
    """As ``analyse``, from the store and for it; and what went wrong in publishing, which takes nothing from the results.

    Only changed files are parsed, also for references; only their buckets, and those of files that are gone, are written.
    ``files`` are all there are, and others gone; or, with ``removed`` (path), some that may have changed, and those that are gone."""
    spark, version = files.sparkSession, fingerprint(config, roots, filters)
    files = stage.written(files, "files")
    current = files.select("path", "hash").distinct()
    known = store.read("entries").select("path", "hash", "version").distinct()  # narrow: the results themselves stay where they are
    same = known.where(F.col("version") == version).select("path", "hash")
    misses = stage.written(files.join(same, ["path", "hash"], "left_anti"), "misses")
    if removed is None:
        stale = known.join(current, "path", "left_anti").select("path")
    else:
        stale = known.join(removed, "path", "left_semi").select("path")
    fresh = analyse(misses, config, filters=filters)
    entries = stage.written(cache_entries(misses.dropDuplicates(["path"]), fresh, version), "entries")
    referenced = stage.written(references_by_accessor(D.existing_references(fresh.events, list(roots)), list(roots)), "references")
    gone = stage.written(misses.select("path").unionByName(stale).distinct(), "gone")
    counts = {"stale": stale.count(), "parsed": misses.count()}
    hits = current.count() - misses.select("path").distinct().count()
    problem, rows, index = None, store.read("entries"), store.read("references")
    if not gone.isEmpty():
        kept = lambda old, new: old.join(gone, "path", "left_anti").unionByName(new)
        rows, index = kept(rows, entries), kept(index, referenced)
        try:
            paths = current if removed is None else known.select("path").unionByName(current.select("path")).distinct()
            store.update({"entries": entries, "references": referenced}, gone, paths.count())
            rows, index = store.read("entries"), store.read("references")
        except Exception as error:  # the results stand without it
            problem = f"Cache could not be written, the next scan will not profit: {str(error).splitlines()[0]}"
    index = index.where(F.col("root").isin(list(roots))).select("path", "pos", "line", "col", "pattern", "expression", "kind")
    return _replayed(files, rows, fresh, cache=rows, cache_hits=hits, referenced=index, events=fresh.events, **counts), problem


def run(spark: SparkSession, config: Config, base: str, cache_path: str | None = None, references_to: tuple[str, ...] = (), filters: Sequence[S.Filter] = ()) -> dict:
    """The whole scan of a project. Returns its DataFrames and a one-row summary under their names.

    ``references_to``: generated roots, references to which are collected too (``referenced``). Migration
    modes "incremental" and "strict" look for them as well: what was moved is told from what is left."""
    if config.migration not in ("audit", "incremental", "strict"):
        raise ValueError(f"unknown migration mode {config.migration}")
    roots = [r for r in {*references_to, *((config.output.enum_name,) if config.migration != "audit" else ())}]
    at = lambda p: p if p.startswith(("/", "file:")) or "://" in p else f"{base.rstrip('/')}/{p}"
    files, missing = readers.source_files(spark, [at(s) for s in config.sources], list(config.exclude))
    problems = [(f"Source path not found: {m}", "error", "missing_source") for m in missing]
    if config.incremental and cache_path:
        store = open_store(spark, cache_path)
        try:
            store.open()
        except Exception as problem:  # missing is usual; anything else is told
            problems.append((f"Cache unreadable, scanning everything: {str(problem).splitlines()[0]}", "warning", "cache"))
        # Generating needs references to the root, so they are kept by every scan of the project.
        scan, problem = analyse_with_store(files, config, store, tuple({config.output.enum_name, *roots}), filters)
        problems += [(problem, "warning", "cache")] if problem else []
        files = scan.files
    else:
        files = stage.written(files, "files")
        scan = analyse(files, config, filters=filters)
    detected = A.with_namespace(scan.detected, config.namespace_strategy)
    if scan.referenced is None:
        referenced = D.existing_references(scan.events, roots)
    else:  # kept for the project's root at least; asked for are these
        referenced = scan.referenced.where(F.col("pattern").isin(roots))
    collisions = A.namespace_collisions(scan.detected)
    extra = A.collision_diagnostics(collisions)
    try:
        catalog = readers.string_catalogs(spark, base)
        catalog.isEmpty()
    except Exception as problem:
        catalog = spark.createDataFrame([], readers.CATALOG)
        problems.append((f"String catalogs could not be read: {str(problem).splitlines()[0]}", "warning", "catalog"))
    counts = {"missing_catalog_keys": 0, "orphaned_catalog_keys": 0, "duplicate_catalog_groups": 0}
    if not catalog.isEmpty():
        catalog = stage.written(catalog, "catalog")
        absent, orphaned, groups = stage.written(A.missing_from_catalog(detected, catalog), "absent"), A.orphaned_in_catalog(detected, catalog), A.duplicate_catalog_values(catalog)
        counts = {"missing_catalog_keys": absent.count(), "orphaned_catalog_keys": orphaned.count(), "duplicate_catalog_groups": groups.count()}
        if config.string_catalog.validate_missing:
            extra = extra.unionByName(A.missing_key_diagnostics(absent))
        if config.string_catalog.validate_orphaned:
            extra = extra.unionByName(A.orphaned_key_diagnostics(orphaned))
        extra = extra.unionByName(A.duplicate_value_diagnostics(groups))
    if problems:
        extra = extra.unionByName(spark.createDataFrame([(*p, None, None, None, None) for p in problems], "message string, severity string, kind string, path string, line int, col int, pos int"))
    diagnostics = scan.diagnostics.unionByName(extra.select(scan.diagnostics.columns))
    return {"referenced": referenced, "files": files, "detected": detected, "diagnostics": diagnostics, "existing": scan.existing, "parsed": scan.parsed, "catalog": catalog, "summary": summary(files, detected, diagnostics, scan, config, counts)}


def _told(rows: DataFrame, what: str) -> DataFrame:
    """Rows as those that ``totals`` counts: what they are, their path, kind and severity."""
    column = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(F.lit(what).alias("what"), column("path").alias("path"), column("kind").alias("kind"), column("severity").alias("severity"))


def totals(files: DataFrame, detected: DataFrame, diagnostics: DataFrame, existing: DataFrame) -> DataFrame:
    """One row of totals, by one aggregation: short rows of all inputs are counted where they are read."""
    rows = _told(files, "file").unionByName(_told(detected, "string")).unionByName(_told(diagnostics, "diagnostic")).unionByName(_told(existing, "existing"))
    is_, told = lambda what: F.col("what") == what, F.col("what") == "diagnostic"
    of = lambda condition: F.count_if(told & condition)
    severities = {f"{s}s": of(F.col("severity") == s) for s in ("error", "warning", "suggestion", "note")}
    counts = {"files": F.count_if(is_("file")), "strings": F.count_if(is_("string")), "namespaces": F.count_distinct(F.when(is_("string"), F.col("path")))} | severities
    counts |= {"has_errors": of(F.col("severity") == "error") > 0, "suppressed": of(F.col("kind") == "suppressed"), "accessibility_warnings": of((F.col("kind") == "accessibility") & (F.col("severity") == "warning")), "existing_localized": F.count_if(is_("existing"))}
    return rows.agg(*(c.alias(n) for n, c in counts.items()))


def summary(files: DataFrame, detected: DataFrame, diagnostics: DataFrame, scan: Scan, config: Config, counts: dict[str, int]) -> DataFrame:
    """One row of totals, with what was counted otherwise."""
    fixed = {"cache_hits": F.lit(scan.cache_hits), "stale_entries_removed": F.lit(scan.stale), "migration_mode": F.lit(config.migration)} | {k: F.lit(v) for k, v in counts.items()}
    return totals(files, detected, diagnostics, scan.existing).withColumns(fixed)


class UnreadableSource(OSError):
    pass


def facade(spark: SparkSession, directory: str, minimum: float = 0.0, strict: bool = False) -> dict:
    """Strings of a whole directory with common values promoted and assets checked; no exclusions, no cache.

    Packages are looked into, hidden files are not. A directory that is not there is an error; so is a file that is not
    UTF-8 if ``strict``, else it is told. ``totals``: one row of counts. An asset that no catalog has is a warning at its reference."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(directory)
    files = stage.written(readers.files(spark, directory, packages=True), "files")
    bad = readers.unreadable(files).orderBy("path").first() if strict else None
    if bad is not None:
        raise UnreadableSource(bad["message"])
    scan = analyse(files, Config(minimum_confidence=minimum))
    detected = A.with_namespace(scan.detected)
    common = A.common_strings(detected).withColumn("namespace", F.lit("Common"))
    strings = A.without_common(detected).unionByName(common)
    known = readers.assets(spark, directory)
    references = D.asset_references(scan.events).join(detected.select("path").distinct(), "path", "left_semi")
    missing = A.missing_assets(references, known)
    diagnostics = scan.diagnostics.unionByName(D.missing_asset_diagnostics(missing).select(scan.diagnostics.columns))
    rows = _told(detected, "string").unionByName(_told(missing, "missing")).unionByName(_told(scan.diagnostics, "diagnostic"))
    rows = rows.unionByName(strings.select(F.lit("namespace").alias("what"), F.col("namespace").alias("path"), *(F.lit(None).cast("string").alias(c) for c in ("kind", "severity"))))
    counts = {"strings": F.count_if(F.col("what") == "string"), "namespaces": F.count_distinct(F.when(F.col("what") == "namespace", F.col("path"))), "warnings": F.count_if(F.col("severity") == "warning"), "missing_assets": F.count_if(F.col("what") == "missing")}
    one = rows.agg(*(c.alias(n) for n, c in counts.items()))
    return {"strings": strings, "assets": known, "missing_assets": missing, "diagnostics": diagnostics, "totals": one}


def accessor_names(strings: DataFrame) -> DataFrame:
    return strings.withColumn("accessor", S.property_name(F.col("value"), R.context_suffix(F.col("context"))))
