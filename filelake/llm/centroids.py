"""Centroid clustering of integer vectors: exact assignments from fast float32 products.

Each block of rows is multiplied with all centroids in float32. A product of n components is off by
no more than gamma |x| |c| with gamma = (n + 2) u / (1 - (n + 2) u), u = 2**-24, in whatever order it
was summed, so every squared distance has an interval that holds its true value (the steps in
doubles behind it widen it, too). Centroids whose interval lies above the smallest upper end are
out. Rows with one centroid left are assigned; of the others the distances that are left are
computed in integers, and the smallest, then the lowest number, wins.

A round sums components by centroid in each task, then over all tasks; only k centroids of fixed
width reach the driver. The quantised rows are written once and read in each round.

Kept are vectors of exactly ``dim`` components, none null or non-finite. Components beyond the range
of a long count as its nearest bound, and so do distances and inertias. A row without an id is
assigned like any other, but is no starting centroid. Rows that repeat an id each count; of equal
hashes the smaller vector comes first. With fewer rows than ``k`` there are as many centroids as
rows with an id; without any the result is empty. Equal centroids: the lowest number takes all.
Only id and vector are read, so further columns of any name do no harm. Rows are never dealt by
vector or centroid, so copies of one vector and large clusters gather in no task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.session import materialize, ship

ROWS = 16_384
LIMIT = (1 << 63) - 1


def quantised(vectors: DataFrame, dim: int, scale: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: kept vectors with each component as floor(scale * x)."""
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.where((F.size(x) == dim) & ~bad)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c)).alias("v"))


def _exact(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, in integers of any size."""
    if max(np.abs(rows.astype(np.float64)).max(initial=0), np.abs(centres.astype(np.float64)).max(initial=0)) ** 2 * 4 * max(1, rows.shape[1]) < 1 << 62:
        apart = rows - centres
        return np.einsum("ij,ij->i", apart, apart)
    apart = rows.astype(object) - centres.astype(object)
    return (apart * apart).sum(axis=1)


class Screen:
    """The centroids of one round, ready to assign blocks of rows."""

    def __init__(self, centres: np.ndarray) -> None:
        self.centres = centres
        wide = centres.astype(np.float64)
        self.squares = np.einsum("ij,ij->i", wide, wide)
        self.lengths = np.sqrt(self.squares)
        self.float = centres.astype(np.float32)
        n = centres.shape[1] + 2
        self.gamma = n * 2.0**-24 / (1 - n * 2.0**-24) * (1 + 1e-6)
        self.reach = float(np.abs(wide).max(initial=0))

    def shortlist(self, rows: np.ndarray) -> np.ndarray:
        """Which centroids may be nearest to each row: none that is gets lost."""
        wide = rows.astype(np.float64)
        if max(float(np.abs(wide).max(initial=0)), self.reach) > 1e15:  # float32 products could overflow
            return np.ones((len(rows), len(self.centres)), bool)
        product = (rows.astype(np.float32) @ self.float.T).astype(np.float64)
        lengths = np.sqrt(np.einsum("ij,ij->i", wide, wide))
        middle = self.squares - 2 * product  # the squared distance without the row's own square
        off = 2 * self.gamma * lengths[:, None] * self.lengths + (self.squares + 2 * np.abs(product)) * (2.0**-53 * 4 * (rows.shape[1] + 4))
        return middle - off <= (middle + off).min(axis=1)[:, None]

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each row, ties to the lowest."""
        possible = self.shortlist(rows)
        nearest = possible.argmax(axis=1)
        open_ = np.flatnonzero(possible.sum(axis=1) > 1)
        if len(open_):
            at, c = np.nonzero(possible[open_])
            apart = _exact(rows[open_[at]], self.centres[c])
            order = np.lexsort((c, apart, at)) if apart.dtype != object else np.array(sorted(range(len(at)), key=lambda k: (at[k], apart[k], c[k])))
            first = np.append(0, np.flatnonzero(np.diff(at[order])) + 1)
            nearest[open_] = c[order][first]
        return nearest


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column(part.schema.get_field_index("v")).flatten().to_numpy().reshape(part.num_rows, dim)


def _sums(rows: DataFrame, centres: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """(sum, count) of each component of each centroid that has rows: k times dim numbers."""
    dim, screen = centres.shape[1], Screen(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape, object)
        for _, block in _blocks(batches, dim):
            near = screen.assign(block)
            order = np.argsort(near, kind="stable")
            first = np.append(0, np.flatnonzero(np.diff(near[order])) + 1)
            small = np.abs(block.astype(np.float64)).max(initial=0) < 1 << 47  # sums of 2**14 of them fit
            total[near[order][first]] += np.add.reduceat(block[order] if small else block[order].astype(object), first, axis=0)
            count += np.bincount(near, minlength=len(centres))
        own = np.flatnonzero(count)
        keys = np.repeat(own, dim)
        cells = [str(s) for c in own for s in total[c]]
        columns = [pa.array(keys.astype(np.int32)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(own))), pa.array(cells, pa.string()), pa.array(np.repeat(count[own], dim))]
        yield pa.RecordBatch.from_arrays(columns, ["c", "k", "total", "n"])

    part = rows.select("v").mapInArrow(run, "c int, k int, total string, n long")
    found = part.groupBy("c", "k").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    return {(r.c, r.k): (int(r.total), r.n) for r in found.collect()}


class Clustering(NamedTuple):
    """``rows``: vec_id, v, cluster, distance; ``centres``: k rows of integers."""

    rows: DataFrame
    centres: np.ndarray


def cluster(kept: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> Clustering:
    """Lloyd's rounds over ``vec_id, v`` (long, array<long> of one length), from the k rows with the smallest sha256 of ``seed:vec_id``."""
    spark = ship(kept.sparkSession)
    kept = materialize(kept, "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.where("vec_id is not null").select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    centres = np.array([r.v for r in starts], np.int64)
    if not len(centres):
        return Clustering(spark.createDataFrame([], "vec_id long, v array<long>, cluster int, distance long"), np.zeros((0, 0), np.int64))
    for _ in range(rounds):
        for (c, at), (total, n) in _sums(kept, centres).items():
            centres[c, at] = total // n
    screen, dim = Screen(centres), centres.shape[1]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in _blocks(batches, dim):
            near = screen.assign(block)
            apart = _exact(block, centres[near])
            apart = apart if apart.dtype != object else np.array([min(LIMIT, int(x)) for x in apart], np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(apart)], ["vec_id", "v", "cluster", "distance"])

    return Clustering(kept.select("vec_id", "v").mapInArrow(last, "vec_id long, v array<long>, cluster int, distance long"), centres)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centres = cluster(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 64, 256.0))
    rows = materialize(rows.select("vec_id", "cluster", "distance"), "assigned")
    bounded = lambda x: F.least(x, F.lit(LIMIT).cast("decimal(38,0)")).cast("long")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    inertia = {r.cluster: int(r.own) for r in sums.collect()}  # a row for each centroid
    names = [(c, hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest(), min(LIMIT, inertia.get(c, 0))) for c, x in enumerate(centres)]
    named = spark.createDataFrame(names, "cluster int, centroid_sha256 string, cluster_inertia long")
    found = rows.join(F.broadcast(named), "cluster")  # a row for each centroid
    total = bounded(F.lit(sum(inertia.values())).cast("decimal(38,0)"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5) -> str:
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS m FROM (SELECT * FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('2:' || vec_id), v LIMIT {k})
)"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT vec_id, v, c, CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r}
  ) GROUP BY vec_id, v
)""")
        if r < rounds:
            steps.append(f"""s{r} AS (
  SELECT c, k, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM a{r}) GROUP BY c, k
), c{r + 1} AS MATERIALIZED (
  SELECT c, coalesce(w, m) AS m FROM c{r} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY k) AS w FROM s{r} GROUP BY c) USING (c)
)""")
    return ", ".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)
"""


OP11_SQL = _sql()
