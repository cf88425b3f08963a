"""Near-duplicate groups by b-bit MinHash, confirmed on full shingle sets.

Documents link if the Jaccard similarity of their sets of ``size``-word shingles reaches the threshold;
a document's group is everything it can reach.

1. One pass gives each document its set's digest, ``bands`` band keys of ``rows`` minima each, and a
   signature that keeps the low ``BITS`` bits of every minimum, packed in 64-bit words.
2. Equal sets are one node, however many copies there are; nodes are numbered.
3. Nodes sharing a band key meet. In a few rounds each node meets one hub of its buckets at a time (stars,
   never all pairs), in another component than its own. The estimated similarity (share of equal low bits, corrected for chance) discards
   pairs five standard deviations below the threshold; the rest is confirmed on full sets.
4. Confirmed links give components. Buckets that still hold several components are gone through in
   full, in tiles of bounded size, for pairs across components only, each against full sets. So a link is
   found whenever its pair shares a bucket: 1 - (1 - t^rows)^bands, over 0.999996 at t = 0.8.

Sets travel only for pairs to confirm. Nothing of all documents comes to the driver.

Defined cases: null or empty text (or white space only) has an empty set and links with nothing; with
fewer words than ``size``, the whole sequence is the one shingle; null ids are never the smallest, and
a group of null ids only has a null component; rows are judged one by one, so repeated rows come out
as often as they came in and repeated ids with different texts may differ; other columns pass through (see
``columns`` for names that clash).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loquat.llm import storage
from loquat.llm.columns import Carried
from loquat.llm.components import components
from loquat.llm.text import Words, encode, lean, mix, multipliers

BANDS, ROWS, BITS = 32, 5, 4
#: Nodes of a bucket that one task compares with as many others.
TILE = 4096
#: Shingles of a bucket's part, likewise.
TILE_SHINGLES = 2_000_000
#: Rounds of stars before what is left is gone through in full.
STARS = 2


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    words = Words.of([encode(x) for x in texts], lower=True)
    length = np.minimum(words.counts, size)
    per_text = np.where(words.counts > 0, words.counts - length + 1, 0)
    start = np.arange(per_text.sum()) + np.repeat(words.first - (np.cumsum(per_text) - per_text), per_text)
    hashes = words.runs(start, np.repeat(length, per_text), 21)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(per_text)[:-1])] if len(texts) else []


def minima(sets: np.ndarray, ks: np.ndarray) -> np.ndarray:
    """The least hash of a set under each multiplier (32-bit multiply of a mixed 32-bit key)."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(ks), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(out, np.multiply.outer(ks, x[i : i + 4096]).min(axis=1), out=out)
    return out


def signature(least: np.ndarray) -> np.ndarray:
    """Low bits of the minima, packed: 16 values of 4 bits in a 64-bit word."""
    low = mix(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    low = np.r_[low, np.zeros(-len(low) % per, np.uint64)].reshape(-1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def estimate(a: np.ndarray, b: np.ndarray, values: int) -> np.ndarray:
    """Collision-corrected similarity of packed signatures, from a count of differing values."""
    x = a ^ b
    x = x | (x >> np.uint64(1))
    x = (x | (x >> np.uint64(2))) & np.uint64(0x1111111111111111)
    same = 1 - np.bitwise_count(x).sum(axis=-1) / values
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def floor_estimate(threshold: float, values: int, deviations: float = 5.0) -> float:
    """Estimates below this are discarded: the threshold less five standard deviations."""
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    return threshold - deviations * (p * (1 - p) / values) ** 0.5 / (1 - chance)


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``df``'s columns, ``_n_shingles``, ``_component`` (least id in reach), ``_group`` (a number a group of linked
    texts; null without words), ``_kept`` (id = component).

    ``percent``: linked if 100 * intersection >= percent * union."""
    carried = Carried(df)
    df, text, doc_id = carried.df, carried(text), carried(doc_id)
    added = [("_node", T.BinaryType()), ("_n_shingles", T.LongType())]
    node_schema = T.StructType([df.schema[doc_id], *(T.StructField(n, t) for n, t in [*added, ("_bands", T.ArrayType(T.LongType())), ("_sig", T.BinaryType())])])
    marked = storage.materialise(df.select(doc_id, text).mapInArrow(lean(_signatures(text, size, bands, rows)), node_schema), "signatures")
    nodes = marked.where("_n_shingles > 0").groupBy(F.col("_node").alias("digest")).agg(F.min(doc_id).alias("id"), F.any_value("_bands").alias("bands"), F.any_value("_sig").alias("sig"), F.any_value("_n_shingles").alias("n_shingles"))
    nodes = storage.materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = _roots(df.select(doc_id, text), nodes, text, doc_id, size, percent / 100, percent, bands * rows)
    ids = storage.materialise(nodes.select("node", "digest", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    least = ids.groupBy("root").agg(F.min("id").alias("_component"))
    component = ids.join(least, "root").select(F.col("digest").alias("_node"), "_component", F.col("root").alias("_group"))
    # The digest is a function of the text, so rows get it anew instead of carrying their text through joins.
    with_node = df.mapInArrow(lean(_signatures(text, size, 0, 0, keep=True)), T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added)]))
    out = with_node.join(component, "_node", "left").drop("_node")
    component_or_self = F.when(F.col("_n_shingles") > 0, F.col("_component")).otherwise(F.col(doc_id))
    out = out.withColumn("_component", component_or_self).withColumn("_kept", F.col(doc_id).eqNullSafe(F.col("_component")))
    return carried.back(out, "_n_shingles", "_component", "_group", "_kept")


def _roots(docs: DataFrame, nodes: DataFrame, text: str, doc_id: str, size: int, threshold: float, percent: int, values: int) -> DataFrame:
    """node, root (the same number for all nodes of a group) of the nodes with a link."""
    low = floor_estimate(threshold, values)
    buckets = nodes.select("node", F.posexplode("bands").alias("number", "band"))
    several = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = storage.materialise(buckets.join(several, "band"), "buckets")
    # How many others a node meets: the middle of a group of near copies meets most.
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    shared = storage.materialise(shared.join(degree, "node"), "buckets")
    sketches = nodes.select("node", "sig", "bands", F.col("n_shingles").alias("members"))
    links, tried, roots = None, None, None
    for left in range(STARS - 1, -1, -1):
        # In every bucket the node of most meetings is the hub. A node of another component meets one hub,
        # that of most of its buckets: a tight group becomes a star.
        member = shared.withColumn("root", F.col("node")) if roots is None else shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        hubs = member.groupBy("band").agg(F.max(F.struct("degree", "node", "root")).alias("hub"))
        meets = member.join(hubs, "band").where("root <> hub.root").groupBy("node", F.col("hub.node").alias("hub")).agg(F.count("*").alias("n"))
        pairs = meets.groupBy("node").agg(F.max(F.struct("n", "hub")).alias("best")).select(F.greatest("node", "best.hub").alias("a"), F.least("node", "best.hub").alias("b")).distinct()
        pairs = storage.materialise(_promising(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), sketches, low, percent, values), "star")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = storage.materialise(_confirmed(pairs, docs, nodes, text, doc_id, size, percent), "links")
        links = found if links is None else links.unionByName(found)
        # Until the last round, two steps of least neighbours: a star has one root then, and finer roots only cost tries.
        roots = storage.materialise(_nearest(links, 2) if left else components(links), "roots")
    # Buckets with several components left: every pair across them, until the components are one.
    member = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("n", "degree")
    open_buckets = member.join(sketches.select("node", "members"), "node").groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.greatest(F.count("*") / TILE, F.sum("members") / TILE_SHINGLES).alias("load")).where("x <> y").select("band", "load")
    member = storage.materialise(member.join(open_buckets, "band"), "open")
    sets = _full_sets(member.select("node").distinct(), docs, nodes, text, doc_id, size)
    rows = member.join(sketches, "node").join(sets, "node")
    across = storage.materialise(_tiles(rows, low, percent, values), "links")
    if across.isEmpty():
        return roots
    # Groups that these links join are few nodes of a graph of groups.
    root_of = lambda c: F.coalesce(f"r{c}", c).alias(c)
    ends = across.join(roots.selectExpr("node AS a", "root AS ra"), "a", "left").join(roots.selectExpr("node AS b", "root AS rb"), "b", "left").select(root_of("a"), root_of("b"))
    joined = storage.materialise(components(ends), "components").selectExpr("node AS root", "root AS top")
    alone = joined.join(roots.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("node"), "top")
    return roots.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(alone.withColumnRenamed("top", "root"))


def _nearest(links: DataFrame, steps: int) -> DataFrame:
    """node, root: the least node within some steps."""
    around = links.unionByName(links.selectExpr("b AS a", "a AS b"))
    out = around.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root"))
    for _ in range(steps - 1):
        step = around.join(out.selectExpr("node AS b", "root AS r"), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        out = out.join(step, "node").select("node", F.least("root", "r").alias("root"))
    return out


def _similar_size(x, y, percent: int):
    """Sets of these sizes can reach the threshold."""
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def _promising(pairs: DataFrame, sketches: DataFrame, low: float, percent: int, values: int) -> DataFrame:
    side = lambda c: sketches.select(F.col("node").alias(c), F.col("sig").alias(f"s{c}"), F.col("members").alias(f"n{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.stack([np.frombuffer(s, np.uint64) for s in batch.column(c).to_pylist()]) for c in ("sa", "sb"))
                near = (estimate(x, y, values) >= low) & _similar_size(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return both.mapInArrow(lean(run), "a long, b long")


def _tiles(members: DataFrame, low: float, percent: int, values: int) -> DataFrame:
    """Confirmed links that join the components of each bucket: every pair across components whose estimate
    allows a link is held against full sets, best estimates first, while its components are still apart.

    A pair is looked at in the first bucket it shares only. Large buckets go in tiles of bounded rows and
    shingles, so that no task holds more than two parts of one; only links that join something come out."""
    part = members.withColumn("parts", F.greatest(F.ceil("load"), F.lit(1)).cast("int")).withColumn("part", F.pmod(F.hash("node"), "parts"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    part = part.withColumn("tile", F.explode(tiles)).select("band", "tile.i", "tile.j", "number", "part", "node", "root", "sig", "bands", "members", "set")

    def run(table: pa.Table) -> pa.Table:
        node, root, side = (table[c].to_numpy() for c in ("node", "root", "part"))
        sig = np.stack([np.frombuffer(s, np.uint64) for s in table["sig"].to_pylist()])
        sets = [np.frombuffer(s, np.uint64) for s in table["set"].to_pylist()]
        keys, size = np.array(table["bands"].to_pylist(), np.int64), table["members"].to_numpy()
        _, component = np.unique(root, return_inverse=True)
        i, j, number = (table[c][0].as_py() for c in ("i", "j", "number"))
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        a, b = [], []
        for at, k in enumerate(left):
            others = right[at + 1 :] if i == j else right
            others = others[(component[others] != component[k]) & _similar_size(size[others], size[k], percent)]
            guess = estimate(sig[others], sig[k], values)
            near = (guess >= low) & ~(keys[others, :number] == keys[k, :number]).any(1)
            for m in others[near][np.argsort(-guess[near], kind="stable")]:
                if component[m] != component[k] and _linked(sets[k], sets[m], percent):
                    component[component == component[m]] = component[k]
                    a.append(max(node[k], node[m]))
                    b.append(min(node[k], node[m]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return part.groupBy("band", "i", "j").applyInArrow(run, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _full_sets(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, text: str, doc_id: str, size: int) -> DataFrame:
    """node, set (sorted 64-bit hashes) of the wanted nodes, from the text of one document of each."""
    wanted = nodes.select("node", "digest", "id").join(wanted, "node")
    # Null ids equal each other here; a row of another text under the same id is told by its digest.
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    found = wanted.join(rows, F.col("id").eqNullSafe(F.col("_id"))).select("node", "digest", "_text").mapInArrow(lean(_sets(size)), "node long, set binary")
    return storage.materialise(found.dropDuplicates(["node"]), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, text: str, doc_id: str, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _full_sets(ends, docs, nodes, text, doc_id, size)
    both = pairs.join(sets.selectExpr("node AS a", "set AS sa"), "a").join(sets.selectExpr("node AS b", "set AS sb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = zip(batch.column("sa"), batch.column("sb"), strict=True)
            keep = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in ends]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(lean(run), "a long, b long")


def _digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                sets = shingle_sets(batch.column("_text").to_pylist(), size)
                own = [(n, x.tobytes()) for n, d, x in zip(batch.column("node").to_pylist(), batch.column("digest").to_pylist(), sets, strict=True) if _digest(x) == d]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in own], pa.int64()), pa.array([x for _, x in own], pa.binary())], names=["node", "set"])

    return run


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key a band, of the band's minima and its number."""
    key = multipliers(bands, 32)
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least.reshape(bands, rows)[:, r])
    return key.view(np.int64)


def _signatures(text: str, size: int, bands: int, rows: int, keep: bool = False):
    """Digest and set size of each row; without ``keep``, the id, band keys and signature too."""
    ks = multipliers(bands * rows, 31).astype(np.uint32) | np.uint32(1) if bands else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                sets = shingle_sets(batch.column(text).to_pylist(), size)
                tail = [pa.array([_digest(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64())]
                if keep:
                    yield pa.RecordBatch.from_arrays([*batch.columns, *tail], names=[*batch.schema.names, "_node", "_n_shingles"])
                    continue
                least = [minima(x, ks) for x in sets]
                keys = pa.array([band_keys(x, bands, rows) for x in least], pa.list_(pa.int64()))
                sig = pa.array([signature(x).tobytes() for x in least], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), *tail, keys, sig], names=[batch.schema.names[0], "_node", "_n_shingles", "_bands", "_sig"])

    return run
