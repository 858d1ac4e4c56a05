"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Vectors are cut into blocks; the index of a block cuts the postings of each component into
segments of equal quantised magnitude. A segment's impact on a pack of queries is its largest
magnitude times the pack's largest component. The pack processes segments by descending
quantised impact, those of equal impact in one product, adding to one accumulator per query and row.
A query stops only on proof: the postings it has not met add at most the product of the row's norm in them
and the query's norm in their components (Cauchy-Schwarz), so a row whose upper bound lies
below the k-th best lower bound is no member. The possible members are rescored exactly.

A stated query set meets all rows in tiles (query block x vector block); each tile returns
its k best per query, a window picks the k best of all. Vectors that are null or hold null or
non-finite components take no part, nor do rows without an id. Only vectors of equal length
meet. Rows repeating the query's id are its own; a query id that repeats asks once (its
smallest vector). Ties go to the smaller id; repeated candidate rows each count. Scores outside
the range of a long are given as its nearest bound. An empty table gives no rows; only id and vector
are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filelake.session import materialize, ship, shuffle_partitions

BLOCK = 8192
QUERIES = 256
#: Magnitudes of a component, and impacts of a pack of queries, are quantised to so many levels.
SEGMENTS = 16
LEVELS = 12
#: Queries that walk the segments of a block together.
TOGETHER = 64
#: Bounds are tried once this share of the squared norms is left, and hold where no more than this share of rows may be members.
PROBE, FEW = 1 / 8, 1 / 8
LIMIT = (1 << 63) - 1


class BlockIndex:
    """Postings of one block in segments: one component, one quantised magnitude. Zeros have no posting."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.dense = np.ascontiguousarray(rows, np.float64)
        self.norms = (self.dense**2).sum(axis=1)
        size = np.abs(self.dense)
        most = size.max(axis=0, initial=0)
        self.reach = int(most.max(initial=0))
        level = np.ceil(size * (SEGMENTS / np.maximum(most, 1))).astype(np.int64)
        key = np.where(level > 0, np.arange(rows.shape[1]) * SEGMENTS + SEGMENTS - level, rows.shape[1] * SEGMENTS).ravel()
        order = np.argsort(key, kind="stable")[: np.count_nonzero(level)]
        cut = np.flatnonzero(np.diff(key[order], prepend=-1))
        #: Positions (row-major) of all postings, segment after segment, and their values.
        self.at, self.value = order, self.dense.ravel()[order]
        self.part, self.begin, self.end = key[order][cut] // SEGMENTS, cut, np.append(cut[1:], len(order))
        self.most = np.maximum.reduceat(np.abs(self.value), cut) if len(cut) else np.zeros(0)
        #: Postings and rows that queries had to look at.
        self.met = self.rescored = 0

    def tiers(self, weight: np.ndarray) -> list[np.ndarray]:
        """Segments by descending quantised impact on queries of no more than ``weight`` in each component."""
        impact = weight[self.part] * self.most
        level = np.ceil(impact * (LEVELS / max(1.0, impact.max(initial=0)))).astype(int)
        order = np.argsort(-level, kind="stable")[: np.count_nonzero(level)]
        return np.split(order, np.flatnonzero(np.diff(level[order])) + 1) if len(order) else []

    def top(self, qids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query, score, id) of the k best rows of each query but its own."""
        out, reach = [], np.maximum(np.abs(queries.astype(np.float64)).max(axis=1, initial=0), self.reach)
        exact = reach * reach * max(1, queries.shape[1]) < 1 << 53
        for n in np.flatnonzero(~exact):  # plain integers
            who = np.flatnonzero(self.ids != qids[n])
            out += self._best(qids[n], who, self.rows[who].astype(object) @ queries[n].astype(object), k)
        for begin in range(0, len(qids), TOGETHER):
            own = np.flatnonzero(exact[begin : begin + TOGETHER]) + begin
            if len(own):
                out += self._tiered(qids[own], queries[own].astype(np.float64), k)
        return out

    def _tiered(self, qids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        n, out = len(self.ids), []
        score, left = np.zeros((len(x), n)), self.norms.copy()
        rest = np.repeat((x * x).sum(axis=1)[:, None], n, axis=1)
        score[self.ids == qids[:, None]] = -np.inf
        tiers = self.tiers(np.abs(x).max(axis=0, initial=0))
        for tier in tiers:
            spans = [slice(b, e) for b, e in zip(self.begin[tier].tolist(), self.end[tier].tolist(), strict=True)]
            at, plane, seen = np.concatenate([self.at[s] for s in spans]), np.zeros(self.dense.shape), np.zeros(self.dense.shape)
            plane.ravel()[at] = np.concatenate([self.value[s] for s in spans])
            seen.ravel()[at] = 1
            score += x @ plane.T
            rest -= (x * x) @ seen.T
            left -= (plane * plane).sum(axis=1)
            self.met += len(at) * len(x)
            if n <= k + 1 or left.sum() > PROBE * self.norms.sum() or tier is tiers[-1]:
                continue
            slack = np.sqrt(rest * left) * (1 + 1e-9)
            need = np.partition(score - slack, n - k, axis=1)[:, n - k]
            slack += score
            possible = slack >= need[:, None]
            done = np.count_nonzero(possible, axis=1) <= max(k, FEW * n)
            for i in np.flatnonzero(done):
                who = np.flatnonzero(possible[i] & (score[i] > -np.inf))
                self.rescored += len(who)
                out += self._best(qids[i], who, (self.dense[who] @ x[i]).astype(np.int64), k)
            qids, x, score, rest = qids[~done], x[~done], score[~done], rest[~done]
            if not len(x):
                return out
        for i in range(len(x)):  # every posting was met: the scores are whole
            need = np.partition(score[i], n - k)[n - k] if n > k else -np.inf
            who = np.flatnonzero((score[i] >= need) & (score[i] > -np.inf))
            out += self._best(qids[i], who, score[i][who].astype(np.int64), k)
        return out

    def _best(self, qid: int, who: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        order = sorted(range(len(who)), key=lambda i: (-score[i], self.ids[who[i]]))[:k] if score.dtype == object else np.lexsort((self.ids[who], -score))[:k]
        return [(int(qid), max(-LIMIT, min(LIMIT, int(score[i]))), int(self.ids[who[i]])) for i in order]


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """``id, dim, v``: usable vectors with each component as floor(scale * x)."""
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.size(x).alias("dim"), F.transform(x, lambda c: F.floor(F.lit(scale) * c)).alias("v"))


def _packed(name: str):
    """Rows of one (dim, block) after the other become one row with ids and vectors, in 32 bits where they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows = None, [], []

        def close() -> pa.RecordBatch:
            x, w = np.array(ids, np.int64), np.array(rows, np.int64).reshape(len(ids), at[0])
            ids.clear(), rows.clear()
            if w.max(initial=0) < 1 << 31 and w.min(initial=0) >= -1 << 31:
                w = w.astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([x.tobytes()]), pa.array([w.tobytes()])], ["dim", name, f"{name}_ids", f"{name}_rows"])

        for batch in batches:
            for key in zip(*(batch.column(c).to_pylist() for c in ("dim", "part", "id", "v")), strict=True):
                if key[:2] != at and ids:
                    yield close()
                at = key[:2]
                ids.append(key[2]), rows.append(key[3])
        if ids:
            yield close()

    return run


def _unpacked(ids: bytes, rows: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(ids, np.int64)
    kind = np.int64 if len(rows) == 8 * len(x) * dim else np.int32
    return x, np.frombuffer(rows, kind).reshape(len(x), dim).astype(np.int64)


def _blocks(rows: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
    n = -(-rows.count() // size) or 1
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")).repartition("dim", "part").sortWithinPartitions("dim", "part", "id")
    packed = dealt.mapInArrow(_packed(name), f"dim int, {name} int, {name}_ids binary, {name}_rows binary")
    return materialize(packed, name), n


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every query row against every vector row.

    A block of vectors is indexed once and the packs of queries come to it, so what is copied is the smaller
    side: each pack to each block. Where there are fewer blocks than tasks, a block goes to several lanes.
    """
    spark = ship(vectors.sparkSession)
    asked = quantised(queries, id_col, vec_col, scale).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("s")).select("id", "s.dim", "s.v")
    index, n_blocks = _blocks(quantised(vectors, id_col, vec_col, scale), "block", BLOCK)
    packs, _ = _blocks(asked, "pack", QUERIES)
    lanes = max(1, shuffle_partitions(spark) // n_blocks)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    homes = index.select("dim", "block", every(lanes).alias("lane"), F.lit(0).alias("kind"), F.col("block_ids").alias("ids"), F.col("block_rows").alias("rows"))
    guests = packs.select("dim", every(n_blocks).alias("block"), F.pmod(F.col("pack"), F.lit(lanes)).cast("int").alias("lane"), F.lit(1).alias("kind"), F.col("pack_ids").alias("ids"), F.col("pack_rows").alias("rows"))
    met = homes.unionByName(guests).repartition("dim", "block", "lane").sortWithinPartitions("dim", "block", "lane", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                dim, block, lane, kind, ids, rows = (batch.column(c)[n].as_py() for c in ("dim", "block", "lane", "kind", "ids", "rows"))
                if kind == 0:
                    at, index = (dim, block, lane), BlockIndex(*_unpacked(ids, rows, dim))
                elif at == (dim, block, lane):  # else no vector of that length is in the block
                    out = index.top(*_unpacked(ids, rows, dim), k)
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], ["query_id", "score", "vec_id"])

    found = met.mapInArrow(search, "query_id long, score long, vec_id long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
