"""SimHash near-duplicate detection with pivot distance tables.

1. Fingerprints (narrow): 64-bit majority vote over XXH64 of the 4-word shingles.
2. Equal fingerprints collapse to one node, the fingerprint itself; a group of copies is one row.
3. Candidates: two fingerprints within ``RADIUS`` bits agree on at least 3 of 7 bit blocks, so
   each node is routed to the C(7,3)=35 block triples. Keys met by one node only go no further.
4. Within a key, nodes carry their Hamming distances to many reference fingerprints (pivots).
   They are ordered by the first distance; pairs outside ``RADIUS`` there are never formed, pairs
   whose largest coordinate difference exceeds ``RADIUS`` are discarded (triangle inequality), and
   the survivors are verified on the fingerprints. A task returns a spanning forest, not all links.
   Keys with more than ``TILE`` nodes are dealt to one task per pair of tiles.
5. Components: alternating large-star and small-star rounds, written to the shared folder; a
   component is named by its smallest doc_id.

Null or empty text has fingerprint zero and links like any other. A null doc_id takes part,
but is never a representative while its group has an id. Repeated rows link to each other.
Texts may be of any length; an empty table gives an empty result. Internal columns take names
that the table does not use.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.llm.texts import single_spaced
from filelake.session import materialize, ship, unused

RADIUS = 4
SHINGLE = 4
BLOCKS = (10, 9, 9, 9, 9, 9, 9)
TILE = 32_768
PIVOTS = np.random.default_rng(20_240_601).integers(0, 1 << 63, 24, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    raw = single_spaced(text or "").strip(" ").encode("utf-8").lower()
    if not raw:
        return 0
    buf = np.frombuffer(raw, np.uint8)
    space = np.flatnonzero(buf == 32)
    if len(space) < width:
        hashes = [xxhash.xxh64_intdigest(raw, 42)]
    else:
        starts = [0, *(space[: len(space) + 1 - width] + 1).tolist()]
        ends = [*space[width - 1 :].tolist(), len(raw)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(raw[a:b], 42) for a, b in zip(starts, ends, strict=True)]
    n, votes = len(hashes), np.zeros(64, np.int64)
    bits = np.array(hashes, np.uint64).view(np.uint8).reshape(n, 8)
    for k in range(0, n, 255):  # sums of 255 ones fit a byte
        votes += np.unpackbits(bits[k : k + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def _sign(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` and a long column with the fingerprint's 64 bits."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([_sign(fingerprint(t)) for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], [*batch.schema.names, name])

    ship(docs.sparkSession)
    schema = docs.select("*", F.lit(0).cast("long").alias(name)).schema
    for f in schema.fields:
        f.nullable = True
    return docs.mapInArrow(run, schema)


def _block_keys(fp: str) -> list:
    """One key for each choice of three blocks: the choice's number above the blocks' bits."""
    at, pieces = 0, []
    for width in BLOCKS:
        pieces.append((F.shiftrightunsigned(F.col(fp), at).bitwiseAND(F.lit((1 << width) - 1)), width))
        at += width
    keys = []
    for k, triple in enumerate(combinations(range(len(BLOCKS)), 3)):
        key = F.lit(k).cast("long")
        for b in triple:
            key = F.shiftleft(key, pieces[b][1]).bitwiseOR(pieces[b][0])
        keys.append(key)
    return keys


class _Forest:
    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self.find(i), self.find(j)
            if i != j:
                self.root[max(i, j)] = min(i, j)
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up


def link_groups(key: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (index, index) of all pairs with equal ``key`` within ``radius``."""
    first = np.bitwise_count(fps ^ PIVOTS[0]).astype(np.int16)
    order = np.lexsort((first, key))
    key, fps, first = key[order], fps[order], first[order]
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, 1:]).astype(np.int8)
    forest = _Forest(len(fps))
    at, step = np.arange(len(fps)), 1
    while True:
        at = at[at + step < len(fps)]
        there = at + step
        at = at[(key[at] == key[there]) & (first[there] - first[at] <= radius)]
        if not len(at):
            break
        there = at + step
        new = forest.root[at] != forest.root[there]
        a, b = at[new], there[new]
        for p in range(0, table.shape[1], 4):
            if not len(a):
                break
            ok = (np.abs(table[a, p : p + 4] - table[b, p : p + 4]) <= radius).all(axis=1)
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        if ok.any():
            forest.link(a[ok], b[ok])
        step += 1
    child = np.flatnonzero(forest.root != np.arange(len(fps)))
    return order[child], order[forest.root[child]]


def _linker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive in key order; runs of whole keys are linked together."""
    hold: list[np.ndarray] = []
    size = 0

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.append(0, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])))
        a, b = link_groups(group, rows[:, 2].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(rows[a, 3]), pa.array(rows[b, 3])], ["a", "b"])

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "tile", "fp", "node")], axis=1).astype(np.int64)
        hold.append(rows)
        size += len(rows)
        if size > 60_000:
            rows = np.concatenate(hold)
            cut = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1]))
            if len(cut):
                yield solve(rows[: cut[-1] + 1])
                hold = [rows[cut[-1] + 1 :]]
                size = len(hold[0])
            else:
                hold = [rows]
    if size:
        yield solve(np.concatenate(hold))


def _merged(df: DataFrame) -> DataFrame:
    """For joins of sides that grow with the table. Spark's guess of their size does not know of exploded keys and compressed
    files; by it millions of keys were broadcast, through the driver's memory."""
    return df.hint("merge")


def links(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """Distinct spanning links (a, b) between nodes (fp, node) with different fingerprints within the radius."""
    keyed = nodes.select("fp", "node", F.explode(F.array(*_block_keys("fp"))).alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    met = keyed.join(_merged(shared), "key")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = met.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("key", (F.shiftleft(low.cast("long"), 32) + high).alias("tile"), "fp", "node")
    placed = dealt.repartition("key", "tile").sortWithinPartitions("key", "tile")
    return placed.mapInArrow(_linker, "a long, b long").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b). Large-star and small-star in turn."""
    def oriented(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now = materialize(oriented(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(_merged(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = oriented(large.union(least.select("u", F.col("m").alias("v"))))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_merged(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = materialize(oriented(small), "edges")
        size = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(size) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(size)


def near_groups(prints: DataFrame) -> DataFrame:
    """``fp, component, first``: the least doc_id (null if there is none) and the least uid among all that are linked with a fingerprint of ``prints`` (doc_id, fp, uid)."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("own"), F.min("uid").alias("uid")), "nodes")
    roots = components(links(nodes.select("fp", F.col("fp").alias("node"))))
    roots = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = materialize(nodes.join(_merged(roots), F.col("fp") == F.col("node")).select("fp", "root", "own", "uid"), "linked")
    best = linked.groupBy("root").agg(F.min("own").alias("least"), F.min("uid").alias("first"))
    found = nodes.join(_merged(linked.select("fp", "root").join(_merged(best), "root").drop("root")), "fp", "left")
    # written, so that a join with it deals both sides and Spark can split the rows of one hot fingerprint
    return materialize(found.select("fp", F.coalesce("least", "own").alias("component"), F.coalesce("first", "uid").alias("first")), "groups")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = materialize(with_fingerprint(docs, "fp").select("doc_id", "fp"), "prints")
    found = prints.join(_merged(near_groups(prints.withColumn("uid", F.lit(0).cast("long")))), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group stays: the one with the smallest id (rows repeating an id are one document), any one row if all ids are null."""
    fp, uid, component, first = unused(docs.columns, "_fp", "_uid", "_component", "_first")
    rows = materialize(with_fingerprint(docs, fp, text_col).withColumn(uid, F.monotonically_increasing_id()), "rows")
    groups = near_groups(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.col(uid).alias("uid")))
    found = rows.join(_merged(groups.select(F.col("fp").alias(fp), F.col("component").alias(component), F.col("first").alias(first))), fp)
    stays = F.when(F.col(component).isNull(), F.col(uid) == F.col(first)).otherwise(F.col(id_col) == F.col(component))
    return found.where(stays).select(*docs.columns)
