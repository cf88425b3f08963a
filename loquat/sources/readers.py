"""Readers: source trees, string catalogs, asset catalogs, configuration, the result cache.

Source and catalog contents are read by Spark's binary reader. Directory-shaped asset catalogs are
listed from the paths of their ``Contents.json`` and content files, in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquat.functions.paths import is_excluded
from loquat.functions.strings import full_asset_name

CATALOG_JSON = "sourceLanguage string, strings map<string,struct<comment:string,localizations:map<string,struct<stringUnit:struct<state:string,value:string>>>>>"
CATALOG = "key string, comment string, source_value string, translation_count int"


def _plain_path(path):
    return F.regexp_replace(path, r"^file:(//)?(?=/)", "")


def _relative(path, base: str):
    prefix = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def _visible(path, packages: bool = False):
    """No component below the base begins with a dot, and none is a package, unless these are wanted."""
    shown = ~path.rlike(r"(^|/)\.[^/]")
    return shown if packages else shown & ~path.rlike(r"\.(app|bundle|framework|xcodeproj|xcworkspace|playground|xcassets)/")


def files(spark: SparkSession, directory: str, suffix: str = ".swift", exclude: list[str] = (), packages: bool = False) -> DataFrame:
    """path, rel_path, content (text or null), hash, of every visible file below a directory, exclusions applied.

    Files that are hidden or excluded are listed, but not read: the condition is one on the files' metadata, which Spark
    applies to its listing. A file that is not UTF-8 has null content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(directory)
    base = directory.removeprefix("file://")
    # Percent-encoded there, where a plus sign is one.
    listed = _relative(_plain_path(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))), base)
    raw = raw.where(_visible(listed, packages) & ~is_excluded(listed, list(exclude)))
    kept = raw.withColumn("path", _plain_path("path")).withColumn("rel_path", _relative(F.col("path"), base))
    text = F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8"))
    return kept.select("path", "rel_path", text.alias("content"), F.sha2("content", 256).alias("hash"))


def source_files(spark: SparkSession, sources: list[str], exclude: list[str] = (), suffix: str = ".swift") -> tuple[DataFrame, list[str]]:
    """Files of several sources, and the sources that do not exist. A single file is taken without exclusions.

    Overlapping sources give a file more than once."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out, missing = None, []
    for source in sources:
        path = jvm.org.apache.hadoop.fs.Path(source)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            missing.append(source)
            continue
        single = fs.getFileStatus(path).isFile()
        if single and not source.endswith(suffix):
            continue
        part = files(spark, source, suffix, () if single else exclude)
        out = part if out is None else out.unionByName(part)
    empty = spark.createDataFrame([], "path string, rel_path string, content string, hash string")
    return (empty if out is None else out), missing


def unreadable(files: DataFrame) -> DataFrame:
    return files.where("content IS NULL").select("path", F.lit("error").alias("severity"), F.concat(F.lit("Cannot read file: "), "path").alias("message"))


def string_catalogs(spark: SparkSession, directory: str) -> DataFrame:
    """key, comment, source_value, translation_count of all string catalogs below a directory; the last path's entry counts."""
    return merge_catalogs(parse_catalogs(files(spark, directory, ".xcstrings")))


def parse_catalogs(files: DataFrame) -> DataFrame:
    """path and entries of each catalog text. A malformed one fails the read."""
    parsed = files.select("path", F.from_json("content", CATALOG_JSON, {"mode": "FAILFAST"}).alias("c"))
    rows = parsed.select("path", F.col("c.sourceLanguage").alias("lang"), F.explode("c.strings").alias("key", "entry"))
    localizations = F.col("entry.localizations")
    value = F.coalesce(F.try_element_at(localizations, F.col("lang"))["stringUnit"]["value"], F.when(localizations.isNull(), F.col("key")))
    return rows.select("path", "key", F.col("entry.comment").alias("comment"), value.alias("source_value"), F.coalesce(F.map_size(localizations) if hasattr(F, "map_size") else F.size(F.map_keys(localizations)), F.lit(0)).cast("int").alias("translation_count"))


def merge_catalogs(entries: DataFrame) -> DataFrame:
    """One entry a key: that of the last path."""
    last = entries.groupBy("key").agg(F.max_by(F.struct("comment", "source_value", "translation_count"), "path").alias("e"))
    return last.select("key", "e.*")


def assets(spark: SparkSession, directory: str) -> DataFrame:
    """type (image, color), full_name of every asset of the catalogs below a directory."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "Contents.json").load(directory)
    return assets_of(raw.select(_relative(_plain_path("path"), directory.removeprefix("file://")).alias("path"), F.decode("content", "UTF-8").alias("content")))


def assets_of(contents: DataFrame) -> DataFrame:
    """Assets from ``Contents.json`` files (path, content).

    A set's name is prefixed by the names of those groups above it, inside its catalog, that provide a
    namespace; directories inside a set are not looked into."""
    inside = contents.where(F.col("path").rlike(r"(^|/)[^/]*\.xcassets/.+") & _shown("path"))
    catalog = F.regexp_extract("path", r"^(.*?\.xcassets)/", 1)
    parts = F.split(F.substring(F.col("path"), F.length(catalog) + 2, F.lit(1 << 30)), "/")
    rows = inside.select(catalog.alias("catalog"), F.slice(parts, F.lit(1), F.size(parts) - 1).alias("dirs"), F.get_json_object("content", "$.properties.provides-namespace").alias("ns"))
    groups = rows.where(F.col("ns") == "true").select("catalog", F.array_join("dirs", "/").alias("group"))
    kind = F.regexp_extract(F.try_element_at("dirs", F.lit(-1)), r"\.(imageset|colorset)$", 1)
    above = F.slice("dirs", F.lit(1), F.greatest(F.size("dirs") - 1, F.lit(0)))  # a catalog describes itself, too
    sets = rows.where(F.size("dirs") > 0).withColumn("kind", kind).where((F.col("kind") != "") & ~F.exists(above, lambda d: d.rlike(r"\.(imageset|colorset|appiconset|launchimage|complicationset|dataset|symbolset|stickerpack)$")))
    sets = sets.select("catalog", F.array_join("dirs", "/").alias("set"), F.when(F.col("kind") == "imageset", "image").otherwise("color").alias("type"), F.regexp_replace(F.try_element_at("dirs", F.lit(-1)), r"\.[^.]*$", "").alias("stem"), above.alias("above"))
    prefix = sets.select("catalog", "set", F.posexplode("above").alias("i", "name"), F.col("above").alias("a")).select("catalog", "set", "i", "name", F.array_join(F.slice("a", F.lit(1), F.col("i") + 1), "/").alias("group"))
    named = prefix.join(groups, ["catalog", "group"], "left_semi").groupBy("catalog", "set").agg(F.array_sort(F.collect_list(F.struct("i", "name"))).alias("names"))
    namespace = F.concat_ws("/", F.transform("names", lambda x: x["name"]))
    return sets.join(named, ["catalog", "set"], "left").select("type", full_asset_name(F.col("stem"), namespace).alias("full_name")).distinct()


def _shown(path: str):
    return ~F.col(path).rlike(r"(^|/)\.[^/]")


def read_cache(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, str | None]:
    """The result cache and a warning, if it is there but cannot be read (then it is empty)."""
    try:
        cache = spark.read.schema(schema).parquet(path)
        cache.isEmpty()
        return cache, None
    except Exception as problem:  # missing is usual; anything else is told
        text = str(problem)
        return spark.createDataFrame([], schema), None if "PATH_NOT_FOUND" in text else f"Cache unreadable, scanning everything: {text.splitlines()[0]}"


def language_count(catalog: DataFrame) -> DataFrame:
    """Languages of a catalog: the most translations of any entry (one row)."""
    return catalog.agg(F.coalesce(F.max("translation_count"), F.lit(0)).alias("languages"))


def asset_counts(assets: DataFrame) -> DataFrame:
    """Images, colors and all assets (one row)."""
    of = lambda kind: F.count_if(F.col("type") == kind)
    return assets.distinct().agg(of("image").alias("images"), of("color").alias("colors"), F.count("*").alias("total"))


def nearby_catalogs(start: str, suffix: str = ".xcassets", home: str | None = None) -> list[str]:
    """Catalogs right inside a directory or, failing that, one of its two parents; not above the home directory.

    Driver-side: three directory listings."""
    import os

    current, home = os.path.realpath(start), os.path.realpath(home or os.path.expanduser("~"))
    for _ in range(3):
        found = sorted(os.path.join(current, x) for x in os.listdir(current) if x.endswith(suffix)) if os.path.isdir(current) else []
        if found or current in (home, os.path.dirname(current)):
            return found
        current = os.path.dirname(current)
    return []


def single_file(spark: SparkSession, path: str) -> DataFrame:
    """One source file, by whatever name; a missing one is an error."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(_plain_path("path").alias("path"), _plain_path("path").alias("rel_path"), F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8")).alias("content"), F.sha2("content", 256).alias("hash"))
