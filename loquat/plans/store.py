"""A table store keyed by path, copied on write by bucket.

Rows lie in buckets by a hash of their path. A version is a small manifest: which generation each bucket of each
table is of. An update rewrites only buckets that hold a path that changed or is gone, as a new generation beside
the old, and then publishes a manifest; what is being read is never written over, and a reader sees one version
whole. The last two versions are kept, bucket directories that neither names go.

Which buckets change is found from narrow columns (path, hash); unchanged rows are neither read nor shuffled.
A bucket takes about ``PER_BUCKET`` paths; where the files have become eight times as many, all are dealt anew. The manifest
has a row a bucket and table, which the driver reads: a few thousand numbers, whatever the rows.

Two writers at once: the second to publish its manifest fails, and its generation is left unnamed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER_BUCKET = 2000
MOST_BUCKETS = 4096
MANIFEST = "buckets int, table string, bucket int, generation string"


@dataclass
class Version:
    """What a manifest says: directory of each bucket's generation, by table. Number -1: nothing was published yet."""

    number: int = -1
    buckets: int = 0
    places: dict[str, dict[int, str]] = field(default_factory=dict)


class Store:
    """Tables below ``path``. ``schemas``: by table name, with a column ``path``; ``order``: columns rows of a bucket are sorted by."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], order: dict[str, list[str]] | None = None):
        self.spark, self.path, self.schemas, self.order = spark, path.rstrip("/"), schemas, order or {}
        self.version = Version()
        self.rewritten: dict[str, int] = {}

    # Files by Hadoop's own interface: any store that Spark reads.

    def _at(self, name: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, name: str = "") -> list[str]:
        fs, at = self._at(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[str]:
        return [x for x in self._names() if x.startswith("version-")]

    def open(self) -> Store:
        """The newest version that was written whole. What cannot be read is an error."""
        names = self.versions()
        whole = [x for x in names if "_SUCCESS" in self._names(x)]
        if names:
            self.version = self._manifest((whole or names)[-1])
        return self

    def _manifest(self, name: str) -> Version:
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/{name}").collect()
        out = Version(int(name.split("-")[-1]), max((r["buckets"] for r in rows), default=0))
        for r in rows:
            if r["table"] is not None:
                out.places.setdefault(r["table"], {})[r["bucket"]] = r["generation"]
        return out

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of a table as of this version; of some buckets only, where given."""
        places = self.version.places.get(table, {})
        chosen = places if buckets is None else {b: places[b] for b in buckets if b in places}
        if not chosen:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*(f"{self.path}/{table}/{g}/bucket={b}" for b, g in sorted(chosen.items())))

    @staticmethod
    def bucket(n: int):
        return F.pmod(F.xxhash64("path"), F.lit(n)).cast("int")

    def update(self, fresh: dict[str, DataFrame], gone: DataFrame, paths: int) -> Store:
        """Publish a version in which rows of the paths in ``gone`` are replaced by ``fresh`` rows.

        Every path of ``fresh`` is in ``gone``. ``paths``: how many there are in all, for the number of buckets."""
        old = self.version
        wanted = max(1, min(MOST_BUCKETS, math.ceil(paths / PER_BUCKET)))
        anew = old.buckets == 0 or (paths > 8 * PER_BUCKET * old.buckets and wanted > old.buckets)
        n = wanted if anew else old.buckets
        gone = gone.select("path").distinct()
        changed = None if anew else sorted(r["b"] for r in gone.select(self.bucket(n).alias("b")).distinct().collect())
        generation = f"generation-{old.number + 1:08d}-{uuid.uuid4().hex[:8]}"
        new = Version(old.number + 1, n)
        for table, schema in self.schemas.items():
            kept = self.read(table, changed).join(gone, "path", "left_anti")
            rows = kept.unionByName(fresh[table]).withColumn("bucket", self.bucket(n))
            tasks = max(1, min(n if changed is None else len(changed), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
            rows = rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", *self.order.get(table, ["path"]))
            rows.write.partitionBy("bucket").parquet(f"{self.path}/{table}/{generation}")
            places = {} if anew else dict(old.places.get(table, {}))
            for b in changed or ():
                places.pop(b, None)
            written = {int(x.split("=")[1]): generation for x in self._names(f"{table}/{generation}") if x.startswith("bucket=")}
            new.places[table] = places | written
            self.rewritten[table] = len(written)
        rows = [(n, t, b, g) for t, places in new.places.items() for b, g in places.items()] or [(n, None, None, None)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.path}/version-{new.number:08d}")
        self._sweep(old, new)
        self.version = new
        return self

    def _sweep(self, old: Version, new: Version) -> None:
        """Older versions, and bucket directories that only they name."""
        named = {(t, g, b) for v in (old, new) for t, places in v.places.items() for b, g in places.items()}
        for name in self.versions():
            number = int(name.split("-")[-1])
            if number < old.number:
                earlier = self._manifest(name)
                for t, places in earlier.places.items():
                    for b, g in places.items():
                        if (t, g, b) not in named:
                            fs, at = self._at(f"{t}/{g}/bucket={b}")
                            fs.delete(at, True)
                fs, at = self._at(name)
                fs.delete(at, True)
