"""Approximate nearest neighbours by additive quantisation.

1. Codebooks: for each vector length, ``BOOKS`` full-dimensional codebooks of up to 256 words, fitted
   by a task on a sample of about ``SAMPLE`` distinct vectors chosen by hash: k-means on the residuals
   of the books before, then sweeps that encode the sample anew and move each word to the mean of
   what the other books leave of its vectors.
2. Index: every distinct vector is written as one word of each book, found by beam search over the
   full residuals, beside the squared norm of the sum of its words. Rows lie in blocks that hold
   ids, vectors, codes, norms and codebooks.
3. Search: a query's products with all words are a lookup table; norm minus twice the sum of looked-up
   products orders a block's rows. The best ``RERANK`` of a full block (that share of any
   block, and ``LEAST`` at least) are compared with the query exactly, in doubles, on the original vectors.

The shortlist is a share of each block, so recall does not change with the size of the table; the
README has the measured recall. Of equal vectors only the ``k + 1`` smallest ids are indexed, which
loses nothing: ties go to the smaller id, and only one of them can be the query's own.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without
an id. Only vectors of equal length meet. A row repeating id and vector counts once; rows with the
query's id are its own; a query id that repeats asks once (its smallest vector). A table of fewer than
``k`` others gives them all, an empty one no rows. Distances beyond the range of a double are infinite.
Only id and vector are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filelake.session import materialize, ship, shuffle_partitions

BOOKS, WORDS = 16, 256
SAMPLE = 16_384
BEAM = 4
BLOCK, QUERIES = 8192, 128
RERANK, LEAST = 384, 64
STEPS, SWEEPS = 8, 2
#: So many lengths of vectors at most are broadcast with their sampling rates, and so many sets of codebooks (of about a megabyte each).
LENGTHS, SALTS, SETS = 10_000, 1024, 16


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, dim, v``: finite vectors other than zero, as doubles."""
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    some = F.exists(x, lambda c: c != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.size(x).alias("dim"), x.alias("v"))


def _clustered(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means in float32; a word that loses all its rows starts again at a row far from its word."""
    words = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(STEPS):
        apart = (words**2).sum(1) - 2 * (x @ words.T)
        near = apart.argmin(1)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(count)
        words[full] = np.add.reduceat(x[order], np.cumsum(count[full]) - count[full], axis=0) / count[full, None]
        if len(full) < k:
            far = np.argsort(-(apart[np.arange(len(x)), near] + (x**2).sum(1)), kind="stable")[: k - len(full)]
            words[np.flatnonzero(count == 0)[: len(far)]] = x[far]
    return words


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared norms of the sums of words): beam search, book after book, over full residuals."""
    codes, norms = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.float32)
    squares = (books**2).sum(2)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        n = len(part)
        rest, lost = part[:, None, :], (part**2).sum(1)[:, None]
        taken = np.zeros((n, 1, 0), np.uint8)
        for m, book in enumerate(books):
            width = rest.shape[1]
            cost = (lost[:, :, None] + squares[m] - 2 * (rest.reshape(n * width, -1) @ book.T).reshape(n, width, -1)).reshape(n, -1)
            keep = min(beam, cost.shape[1])
            best = np.argpartition(cost, keep - 1, axis=1)[:, :keep] if keep < cost.shape[1] else np.tile(np.arange(keep), (n, 1))
            lost = np.take_along_axis(cost, best, 1)
            which, word = best // len(book), best % len(book)
            rest = np.take_along_axis(rest, which[:, :, None], 1) - book[word]
            taken = np.concatenate([np.take_along_axis(taken, which[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        first = lost.argmin(1)
        rows = np.arange(n)
        codes[at : at + n] = taken[rows, first]
        norms[at : at + n] = ((part - rest[rows, first]) ** 2).sum(1)
    return codes, norms


def fit(x: np.ndarray, books: int = BOOKS) -> np.ndarray:
    """(books, words, dim) in float32. The same sample gives the same codebooks."""
    rng, k = np.random.default_rng(13), min(WORDS, len(x))
    rest, found = x.astype(np.float32), []
    for _ in range(books):
        words = _clustered(rest, k, rng)
        rest = rest - words[((words**2).sum(1) - 2 * (rest @ words.T)).argmin(1)]
        found.append(words)
    out = np.stack(found)
    for _ in range(SWEEPS):
        codes, _ = encode(x, out)
        rest = x - sum(out[m][codes[:, m]] for m in range(books))
        for m in range(books):
            rest += out[m][codes[:, m]]
            count = np.bincount(codes[:, m], minlength=k)
            order, full = np.argsort(codes[:, m], kind="stable"), np.flatnonzero(count)
            out[m][full] = np.add.reduceat(rest[order], np.cumsum(count[full]) - count[full], axis=0) / count[full, None]
            rest -= out[m][codes[:, m]]
    return out


def _scaled(x: np.ndarray, scale: float) -> np.ndarray:
    """For coding only: into the range in which float32 squares are finite."""
    return np.clip(x / scale, -1e15, 1e15).astype(np.float32)


class Block:
    """Indexed rows of one length; all that a search needs."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, books: np.ndarray, scale: float, codes: np.ndarray, norms: np.ndarray) -> None:
        self.ids, self.rows, self.books, self.scale, self.norms = ids, rows, books, scale, norms
        self.codes = codes.T.astype(np.intp)

    def top(self, asked: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, distance, id): for each query the k nearest of its shortlist."""
        n, out = len(self.ids), []
        short = max(LEAST, k + 1, -(-RERANK * n // BLOCK))
        table = np.einsum("qd,mkd->mqk", _scaled(queries, self.scale), self.books, optimize=True)
        score = np.tile(self.norms, (len(queries), 1))
        for m, codes in enumerate(self.codes):
            score -= 2 * np.take(table[m], codes, axis=1)
        for j, q in enumerate(asked):
            who = np.flatnonzero(self.ids != q)
            if len(who) > short:
                who = who[np.argpartition(score[j, who], short - 1)[:short]]
            apart = np.sqrt(((self.rows[who].astype(np.float64) - queries[j]) ** 2).sum(1))
            order = np.lexsort((self.ids[who], apart))[:k]
            out.append((np.full(len(order), q), apart[order], self.ids[who[order]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _narrow(w: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        small = w.astype(np.float32)
    return small.tobytes() if np.array_equal(small, w) else w.tobytes()


def _matrix(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64 if len(raw) == 8 * n * dim else np.float32).reshape(n, dim)


def _packs(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Rows (id, dim, v) as ``dim, part, ids, rows``: about ``size`` of one length in each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vs = None, [], []

        def close() -> pa.RecordBatch:
            w = np.concatenate(vs).reshape(-1, at[0])
            raw = [pa.array([x]) for x in (np.concatenate(ids).astype(np.int64).tobytes(), _narrow(w))]
            ids.clear(), vs.clear()
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), *raw], ["dim", "part", "ids", "rows"])

        for batch in batches:
            dim, part, own = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("dim", "part", "id"))
            v = batch.column(batch.schema.get_field_index("v"))
            cut = np.flatnonzero((dim[1:] != dim[:-1]) | (part[1:] != part[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(dim)], strict=True):
                key = (int(dim[a]), int(part[a])) if b > a else at
                if key != at and ids:
                    yield close()
                at = key
                if b > a:
                    ids.append(own[a:b]), vs.append(v.slice(a, b - a).flatten().to_numpy(zero_copy_only=False))
        if ids:
            yield close()

    n = -(-rows.count() // size) or 1
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")).repartition(shuffle_partitions(rows.sparkSession), "dim", "part").sortWithinPartitions("dim", "part", "v", "id")
    return dealt.select("dim", "part", "id", "v").mapInArrow(run, "dim int, part int, ids binary, rows binary"), n


def codebooks(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``dim, scale, books``: for each length, fitted on about ``sample`` of the distinct vectors (all, if fewer)."""
    one = rows.where("rank = 1").select("dim", "v")
    rate = materialize(one.groupBy("dim").agg((F.lit(float(sample)) / F.count("*")).alias("rate")), "rates")
    lot = F.xxhash64("v", F.lit("sample"))
    if rate.count() <= LENGTHS:  # the sample is drawn where the rows lie
        met = one.join(F.broadcast(rate), "dim")
    else:  # a length that most rows share is dealt over many tasks
        met = one.withColumn("salt", F.pmod(lot, F.lit(SALTS))).join(rate.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["dim", "salt"])
    chosen = met.where(F.pmod(lot, F.lit(1 << 30)) < F.col("rate") * (1 << 30)).select("dim", "v")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        x = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        x = x[np.lexsort(x.T[::-1])]
        scale = float(np.median(np.abs(x).max(axis=1))) or 1.0
        return pa.table({"dim": pa.array([dim], pa.int32()), "scale": [scale], "books": [fit(_scaled(x, scale)).tobytes()]})

    return chosen.groupBy("dim").applyInArrow(run, "dim int, scale double, books binary")


INDEX = "dim int, block int, scale double, ids binary, rows binary, books binary, codes binary, norms binary"


def build_index(rows: DataFrame) -> tuple[DataFrame, int]:
    """(blocks of INDEX, how many of a length at most)."""
    fitted = materialize(codebooks(rows), "codebooks")
    packs, n = _packs(rows.select("id", "dim", "v"), BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dim, ids = r["dim"], np.frombuffer(r["ids"], np.int64)
                x = _matrix(r["rows"], len(ids), dim)
                books = np.frombuffer(r["books"], np.float32).reshape(BOOKS, -1, dim)
                fresh = np.append(True, (x[1:] != x[:-1]).any(axis=1))  # equal vectors lie side by side
                codes, norms = encode(_scaled(x[fresh], r["scale"]), books)
                back = np.cumsum(fresh) - 1
                made = r | {"block": r["part"], "codes": codes[back].tobytes(), "norms": norms[back].tobytes()}
                yield pa.RecordBatch.from_pylist([{f: made[f] for f in kind.names}], kind)

    kind = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("scale", pa.float64()), *[(c, pa.binary()) for c in ("ids", "rows", "books", "codes", "norms")]])
    if fitted.count() <= SETS:  # else blocks of one length are dealt over many tasks
        both = packs.join(F.broadcast(fitted), "dim")
    else:
        salts = min(n, shuffle_partitions(rows.sparkSession))
        both = packs.withColumn("salt", F.pmod("part", F.lit(salts))).join(fitted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["dim", "salt"]).drop("salt")
    return materialize(both.mapInArrow(run, INDEX), "index"), n


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for each query row, score being the Euclidean distance.

    Every block meets every pack of queries of its length; where there are fewer blocks than tasks, the packs
    of a block are dealt over several lanes.
    """
    spark = ship(vectors.sparkSession)
    rows = usable(vectors, id_col, vec_col).distinct()
    twins = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    rows = materialize(rows.withColumn("rank", twins).where(F.col("rank") <= k + 1), "vectors")
    index, n_blocks = build_index(rows)
    asked = usable(queries, id_col, vec_col).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("s")).select("id", "s.dim", "s.v")
    packs = materialize(_packs(asked, QUERIES)[0], "packs")
    lanes = max(1, shuffle_partitions(spark) // n_blocks)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    homes = index.select("*", every(lanes).alias("lane"), F.lit(0).alias("kind"))
    guests = packs.select("dim", every(n_blocks).alias("block"), "ids", "rows", F.pmod(F.col("part"), F.lit(lanes)).cast("int").alias("lane"), F.lit(1).alias("kind"))
    met = homes.unionByName(guests, allowMissingColumns=True).repartition(shuffle_partitions(spark), "dim", "block", "lane").sortWithinPartitions("dim", "block", "lane", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, home = None, None
        for batch in batches:
            for r in batch.to_pylist():
                ids, key = np.frombuffer(r["ids"], np.int64), (r["dim"], r["block"], r["lane"])
                x = _matrix(r["rows"], len(ids), r["dim"])
                if r["kind"] == 0:
                    books = np.frombuffer(r["books"], np.float32).reshape(BOOKS, -1, r["dim"])
                    at, home = key, Block(ids, x, books, r["scale"], np.frombuffer(r["codes"], np.uint8).reshape(len(ids), BOOKS), np.frombuffer(r["norms"], np.float32))
                elif key == at:  # else no vector of that length is in the block
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in home.top(ids, x.astype(np.float64), k)], ["query_id", "score", "vec_id"])

    found = met.mapInArrow(search, "query_id long, score double, vec_id long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)
