"""Exact deduplication with an extendible-hash index on shared files.

1. ``tag`` (narrow): every row gets a row id, the SHA-256 of its normalised text and a
   64-bit index key. Equal texts of one Arrow batch collapse to one *entry*, so a text
   that a third of all rows share reaches its owner once per batch, not once per row.
2. ``Directory``: a histogram over the leading 16 key bits (65,536 counts at most) drives the
   classic extendible-hash splits: a bucket over capacity splits, the directory doubles. A slot
   that is still over capacity opens a page of its own with ``STEP`` more bits, on demand, until
   its entries part or it holds one key, whose entries chain.
3. Owner tasks: the buckets in key order are cut into runs of about equal entries, one run
   for each owner, so an owner holds one contiguous key range and the directory decides which.
   It processes its range in key order. Entries of equal key form a chain; a chain is resolved
   by comparing text bytes, never by hash alone.
4. Index entries are written to the shared folder and joined back to the rows by entry id.

Null text counts as empty. A null doc_id sorts after every id. Of rows that share both the
text and the smallest doc_id exactly one (the first read) is kept. Texts may be of any length.
An empty table gives an empty result. Internal columns take names that the table does not use.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelake.llm.texts import single_spaced
from filelake.session import materialize, ship, shuffle_partitions, unused

DEPTH = 16  # bits of the first directory page
STEP = 8  # bits of each further page
CAPACITY = 20_000  # entries of a bucket; more where 4 / 2**DEPTH of all entries is more, so that uniform keys fit the first page


def split_page(histogram: dict[int, int], bits: int, capacity: int) -> list[tuple[int, int, int]]:
    """Buckets as (prefix, local depth, entries), in key order, after all splits that a page's ``histogram`` (by its ``bits``) asks for."""
    out: list[tuple[int, int, int]] = []
    items = sorted(histogram.items())

    def split(prefix: int, d: int, part: list[tuple[int, int]]) -> None:
        n = sum(n for _, n in part)
        if d == bits or n <= capacity:
            out.append((prefix, d, n))
            return
        half = ((prefix << 1) | 1) << (bits - d - 1)
        split(prefix << 1, d + 1, [x for x in part if x[0] < half])
        split((prefix << 1) | 1, d + 1, [x for x in part if x[0] >= half])

    split(0, 0, items)
    return out


class Directory:
    """Buckets in key order. ``first``: the smallest unsigned key of each; ``entries`` of each; ``owners``: the owner of each."""

    def __init__(self, capacity: int, owners: int) -> None:
        self.capacity, self.n_owners = capacity, owners
        self.buckets: dict[int, tuple[int, int]] = {}  # smallest key: (depth, entries)

    def page(self, prefix: int, above: int, bits: int, histogram: dict[int, int]) -> list[int]:
        """Fill the page below a prefix of ``above`` bits; returns the prefixes that are still over capacity."""
        depth, full = above + bits, []
        for p, d, n in split_page(histogram, bits, self.capacity):
            self.buckets[(prefix << bits | p << (bits - d)) << (64 - depth)] = (above + d, n)
            if d == bits and n > self.capacity and depth < 64:
                full.append(prefix << bits | p)
        return full

    def close(self) -> None:
        self.first = sorted(self.buckets)
        self.entries = [self.buckets[k][1] for k in self.first]
        total, before, self.owners = max(1, sum(self.entries)), 0, []
        for n in self.entries:
            self.owners.append(min(self.n_owners - 1, (before + n // 2) * self.n_owners // total))
            before += n

    def bucket(self, key: int) -> int:
        return bisect_right(self.first, key) - 1


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits)


def build_directory(keys: DataFrame, key: str, capacity: int, owners: int) -> Directory:
    """Histograms by prefix, one level of pages after the other; a level counts only below the slots that are still over capacity."""
    spark = keys.sparkSession
    counts = {r[0]: r[1] for r in keys.groupBy(_prefix(F.col(key), DEPTH)).count().collect()}  # 2**DEPTH rows at most
    found = Directory(max(capacity, -(-4 * sum(counts.values()) >> DEPTH)) if capacity == CAPACITY else capacity, owners)
    full, depth = found.page(0, 0, DEPTH, counts), DEPTH
    while full:  # each slot holds more than the capacity, so there are few
        names = unused([key], "_slot", "_next")
        below = keys.withColumn(names[0], _prefix(F.col(key), depth)).join(F.broadcast(spark.createDataFrame([(p,) for p in full], f"{names[0]} long")), names[0])
        rows = below.groupBy(names[0], _prefix(F.col(key), depth + STEP).bitwiseAND((1 << STEP) - 1).alias(names[1])).count().collect()  # 2**STEP a full slot
        pages: dict[int, dict[int, int]] = {}
        for p, x, n in rows:
            pages.setdefault(p, {})[x] = n
        full = [f for p, page in pages.items() for f in found.page(p, depth, STEP, page)]
        depth += STEP
    found.close()
    return found


#: Columns that tagging adds to a row, and their types.
_TAGS = {"uid": "long", "entry": "long", "key": "long", "sha": "string", "min_id": "long", "min_uid": "long", "n": "long"}
_OWN = ["bucket", "key", "entry", "min_id", "min_uid", "n", "text"]
_ENTRIES = "entry long, keep_id long, keep_uid long, size long, bucket int, key long, chain int"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tagger(id_at: int, text_at: int, carry: bool, names: list[str]):
    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            ids, texts = batch.column(id_at).to_pylist(), batch.column(text_at).to_pylist()
            first: dict[str, list] = {}
            uid, entry, key, sha, own = [], [], [], [], []
            for i, (doc, text) in enumerate(zip(ids, texts, strict=True)):
                norm, u = single_spaced(text or ""), base + seq + i
                order = (doc is None, doc or 0, u)
                e = first.get(norm)
                if e is None:
                    raw = norm.encode("utf-8")
                    e = first[norm] = [u, _signed(xxhash.xxh64_intdigest(raw, 7)), hashlib.sha256(raw).hexdigest(), order, 0, i]
                elif order < e[3]:
                    e[3] = order
                e[4] += 1
                uid.append(u), entry.append(e[0]), key.append(e[1]), sha.append(e[2]), own.append(None)
            for e in first.values():
                own[e[5]] = e
            seq += len(ids)
            tags = [
                pa.array(uid, pa.int64()), pa.array(entry, pa.int64()), pa.array(key, pa.int64()), pa.array(sha, pa.string()),
                pa.array([None if e is None or e[3][0] else e[3][1] for e in own], pa.int64()),
                pa.array([e and e[3][2] for e in own], pa.int64()), pa.array([e and e[4] for e in own], pa.int64()),
            ]
            if carry:
                yield pa.RecordBatch.from_arrays([*batch.columns, *tags], names)
            else:
                kept = pa.array([None if e is None else (t or "") for e, t in zip(own, texts, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(id_at), kept, *tags], names)

    return tag


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one key range in key order. Resolve the chain of each key by comparing bytes."""
    out: list[tuple] = []
    chain: dict[str, list] = {}
    at: tuple | None = None

    def close() -> None:
        for k, members in enumerate(chain.values()):
            low = min((m[1] is None, m[1] or 0, m[2]) for m in members)
            size = sum(m[3] for m in members)
            out.extend((m[0], None if low[0] else low[1], low[2], size, at[0], at[1], k) for m in members)
        chain.clear()

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int32()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["entry", "keep_id", "keep_uid", "size", "bucket", "key", "chain"])
        out.clear()
        return batch

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in _OWN), strict=True):
            if row[:2] != at:
                if at is not None:
                    close()
                at = row[:2]
            chain.setdefault(single_spaced(row[6] or ""), []).append(row[2:6])
        if len(out) > 5000:
            yield flush()
    if at is not None:
        close()
    yield flush()


def place_entries(entries: DataFrame, found: Directory) -> DataFrame:
    """``entries`` (``_OWN`` without bucket) with bucket and owner, dealt to their owners, in key order.

    A key finds its slot in the first page (one broadcast row for each slot, 2**DEPTH at most); where that
    slot was split further, the bounds of its buckets come along and the last one at or below the key is its bucket.
    """
    spark = entries.sparkSession
    slots: dict[int, list[int]] = {}
    for b, key in enumerate(found.first):
        end = found.first[b + 1] if b + 1 < len(found.first) else 1 << 64
        for slot in range(key >> 64 - DEPTH, (end - 1 >> 64 - DEPTH) + 1):
            slots.setdefault(slot, []).append(b)
    rows = [(slot, own[0], [_signed(found.first[b] ^ 1 << 63) for b in own[1:]]) for slot, own in slots.items()]
    pages = spark.createDataFrame(rows, "_slot int, _bucket int, _bounds array<long>")  # all bounds together: one for each bucket
    order = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order as signed
    passed = F.size(F.filter("_bounds", lambda x: x <= order))
    met = entries.join(F.broadcast(pages), _prefix(F.col("key"), DEPTH).cast("int") == F.col("_slot")).withColumn("bucket", (F.col("_bucket") + passed).cast("int"))
    owners = spark.createDataFrame(list(enumerate(found.owners)), "bucket int, owner int")  # one row for each bucket
    dealt = met.join(F.broadcast(owners), "bucket").repartitionById(found.n_owners, "owner")
    return dealt.sortWithinPartitions(order, "bucket").select(*_OWN)


def _index(src: DataFrame, id_col: str, text_col: str, carry: bool, capacity: int) -> tuple[DataFrame, dict[str, str]]:
    """Rows of ``src`` with uid, sha, keep_id, keep_uid and size, under the names that are returned."""
    spark: SparkSession = ship(src.sparkSession)
    names = dict(zip([*_TAGS, "keep_id", "keep_uid", "size"], unused(src.columns, *[f"_{t}" for t in _TAGS], "_keep_id", "_keep_uid", "_size"), strict=True))
    tags = [T.StructField(names[t], T.LongType() if k == "long" else T.StringType()) for t, k in _TAGS.items()]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in src.schema.fields], *tags])
    run = _tagger(src.columns.index(id_col), src.columns.index(text_col), carry, schema.names)
    rows = materialize(src.mapInArrow(run, schema), "rows")
    entries = rows.where(F.col(names["n"]).isNotNull()).select(*[F.col(names[t]).alias(t) for t in ("key", "entry", "min_id", "min_uid", "n")], F.col(text_col).alias("text"))
    found = build_directory(entries.select("key"), "key", capacity, shuffle_partitions(spark))
    index = materialize(place_entries(entries, found).mapInArrow(_own, _ENTRIES), "index")
    index = index.select(*[F.col(t).alias(names[t]) for t in ("entry", "keep_id", "keep_uid", "size")])
    return rows.drop(*[names[t] for t in ("min_id", "min_uid", "n", "key")], *([] if carry else [text_col])).join(index, names["entry"]), names


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: ``_uid, id, _sha, _keep_id, _keep_uid, _size``."""
    return _index(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)), id_col, text_col, False, capacity)[0]


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    rows, names = _index(docs, id_col, text_col, True, CAPACITY)
    return rows.where(F.col(names["uid"]) == F.col(names["keep_uid"])).select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select(
        "doc_id", F.col("_keep_id").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_uid") == F.col("_keep_uid")).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


OP2_SQL = """
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM t
"""
