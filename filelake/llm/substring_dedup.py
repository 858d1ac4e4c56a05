"""Substring deduplication by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the smallest hash
among its ``MER``-word runs. Consecutive windows with one minimiser form a super-k-mer, which
travels as one packed string (dictionary-coded words) to the bucket of its minimiser, so equal
windows always meet there. In the bucket, windows are sorted; those of equal hash are compared
word by word, and every window whose words also start in a document with a smaller id is
reported. Windows already decided inside one scan chunk do not travel: a passage that a third
of all rows share reaches its bucket once per chunk.

The reported windows come back as packed word ranges and meet the texts, which travel as
compressed Arrow blocks, in the part of their document.
Null text has no words. Texts may be of any length; an empty table gives an empty result. Rows
travel as whole blocks, so columns of any name do no harm. A null doc_id sorts after every id. Rows that repeat a doc_id are not
smaller than each other, so they never remove each other's words. The largest long is ordered
like a null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.llm.texts import words
from filelake.session import ship, shuffle_partitions

WINDOW = 13
MER = 3
CHUNK = 4_000_000  # words that one scan chunk packs together
SHARE = 64 << 20
SLICE = 1 << 20  # windows of a bucket that are judged together
LAST = (1 << 63) - 1
_ROLL = np.random.default_rng(13).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "bucket int, part int, blob binary"


def _poly(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for a in range(0, len(at), SLICE):
        part = at[a : a + SLICE].astype(np.int64)
        for j in range(width):
            out[a : a + SLICE] += h[part + j] * _ROLL[j]
    out ^= out >> np.uint64(29)
    return out


def _window_hashes(codes: np.ndarray, w: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows that begin at ``w[at]``; ``codes``: the hash of each word number. Few are expanded at once."""
    out = np.empty(len(at), np.uint64)
    for a in range(0, len(at), SLICE):
        part = at[a : a + SLICE].astype(np.int64)
        begin = int(part[0])  # ascending
        out[a : a + SLICE] = _poly(codes[w[begin : int(part[-1]) + width]], part - begin, width)
    return out


def _seen_before(k: np.ndarray, w: np.ndarray, at: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """For each window (hash ``k``, first word at ``w[at]``): do its words also start in a smaller document here?"""
    out = np.zeros(len(k), bool)
    order = np.argsort(k)
    ks = k[order]
    same = ks[1:] == ks[:-1]
    sub = order[np.append(same, False) | np.append(False, same)]
    while len(sub):
        sub = sub[np.lexsort((doc[sub], k[sub]))]
        head = np.append(True, k[sub[1:]] != k[sub[:-1]])
        rep = sub[np.flatnonzero(head)[np.cumsum(head) - 1]]
        equal = np.ones(len(sub), bool)
        for j in range(width):
            equal &= w[at[sub] + j] == w[at[rep] + j]
        out[sub[equal & (doc[sub] > doc[rep])]] = True
        sub = sub[~equal]  # words that only share the hash are judged among themselves
    return out


def _ranges(start: np.ndarray, doc: np.ndarray, mark: np.ndarray, width: int) -> list[tuple[int, int, bytes]]:
    """(doc, mark, packed [from, to) word ranges) of windows sorted into runs."""
    if not len(start):
        return []
    order = np.lexsort((start, mark, doc))
    start, doc, mark = start[order], doc[order], mark[order]
    new_doc = np.append(True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]))
    cut = np.flatnonzero(new_doc | np.append(True, start[1:] > start[:-1] + 1))
    last = np.append(cut[1:], len(start)) - 1
    pair = np.stack([start[cut], start[last] + width], axis=1).astype("<u4")
    first = np.flatnonzero(new_doc[cut])
    bound = [*first.tolist(), len(cut)]
    return [(int(doc[cut[a]]), int(mark[cut[a]]), pair[a:b].tobytes()) for a, b in zip(bound, bound[1:], strict=False)]


def _planes(x: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes()


def _from_planes(raw: bytes, n: int, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(f"<u{size}").ravel().astype(np.int64)


class _Chunk:
    """Documents of one scan chunk as word numbers."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.parts: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.docs: list[int] = []
        self.marks: list[int] = []
        self.n = 0

    def add(self, doc: int | None, text: str, width: int) -> None:
        found = words(text)
        if len(found) < width:
            return
        self.parts.append(np.fromiter(map(self.codes.__getitem__, found), np.int32, len(found)))
        self.sizes.append(len(found))
        self.docs.append(LAST if doc is None else doc)
        self.marks.append(_mark(text))
        self.n += len(found)

    def pack(self, buckets: int, parts: int, width: int, mer: int) -> Iterator[tuple]:
        if not self.n:
            return
        vocab = list(self.codes)
        hashes = np.array([xxhash.xxh64_intdigest(x.encode("utf-8"), 3) for x in vocab], np.uint64)
        w, sizes = np.concatenate(self.parts), np.array(self.sizes)
        self.parts.clear()
        docs, marks, ends = np.array(self.docs), np.array(self.marks), np.cumsum(sizes)
        begins, n = ends - sizes, len(w)
        d = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        h = hashes[w]
        at = np.flatnonzero(np.arange(n) + width <= ends[d])
        m = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        m[: n - mer + 1] = (_poly(h, np.arange(n - mer + 1), mer) * _MIX) ^ np.uint64(0x5BF0_3635_D0C4_9A11)
        low, span, runs = m, 1, width - mer + 1
        while span * 2 <= runs:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        least = np.minimum(low[at], low[at + runs - span])
        del m, low
        done = _seen_before(_poly(h, at, width), w, at, docs[d[at]], width)
        del h
        gone, found = at[done], []
        for doc, mark, raw in _ranges(gone - begins[d[gone]], docs[d[gone]], marks[d[gone]], width):
            found.append((doc, mark, raw))
        for part, blob in _range_blobs(found, parts):
            yield (part % buckets, part, blob)
        at, least = at[~done], least[~done]
        if not len(at):
            return
        cut = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (least[1:] != least[:-1])))
        s, count = at[cut], np.diff(np.append(cut, len(at)))
        bucket = ((least[cut] * _MIX) >> np.uint64(33)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        s, count, bucket = s[order], count[order], bucket[order]
        bound = np.flatnonzero(np.append(True, np.diff(bucket) != 0)).tolist()
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for a, b in zip(bound, [*bound[1:], len(s)], strict=True):
            size = count[a:b] + width - 1
            flat = np.repeat(s[a:b] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            seen, code = np.unique(w[flat], return_inverse=True)
            whose, own = np.unique(d[s[a:b]], return_inverse=True)
            wide = 2 if len(seen) <= 1 << 16 else 4
            fields = [
                "\n".join([vocab[i] for i in seen.tolist()]).encode("utf-8"), _planes(code, wide), docs[whose].tobytes(), marks[whose].tobytes(),
                _planes(own, 4), _planes(s[a:b] - begins[d[s[a:b]]], 4), _planes(count[a:b], 4),
            ]
            yield (int(bucket[a]), None, squeeze(struct.pack("<8I", wide, *map(len, fields)) + b"".join(fields)))


def _part(doc: int, mark: int, parts: int) -> int:
    """Where the text of a document and the ranges found for it meet."""
    return zlib.crc32(struct.pack("<qq", doc, mark)) % parts


def _range_blobs(found: list[tuple[int, int, bytes]], parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, packed ranges of many documents)."""
    by: dict[int, list] = defaultdict(list)
    for row in found:
        by[_part(row[0], row[1], parts)].append(row)
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for part, rows in by.items():
        doc, mark, raw = zip(*rows, strict=True)
        head = np.array([doc, mark, [len(r) for r in raw]], np.int64)
        yield part, squeeze(struct.pack("<I", len(rows)) + head.tobytes() + b"".join(raw))


def _read_ranges(blob: bytes, into: dict[tuple[int, int], list[bytes]]) -> None:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    head = np.frombuffer(raw, np.int64, 3 * n, 4).reshape(3, n)
    at = 4 + 24 * n
    for doc, mark, size in head.T.tolist():
        into[doc, mark].append(raw[at : at + size])
        at += size


def _mark(text: str) -> int:
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(text.encode("utf-8"), 42)))[0]


def _batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "part": pa.int32(), "blob": pa.binary(), "docs": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names)


def _packer(buckets: int, parts: int, width: int, mer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for row in chunk.pack(buckets, parts, width, mer):
                rows.append(row)
                size += len(row[2])
                if size > 8_000_000:
                    yield _batch_of(rows, ["bucket", "part", "blob"])
                    rows, size = [], 0
            if rows:
                yield _batch_of(rows, ["bucket", "part", "blob"])

        chunk = _Chunk()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    chunk.add(doc, text, width)
                if chunk.n >= CHUNK:
                    yield from out(chunk)
                    chunk = _Chunk()
        yield from out(chunk)

    return run


def _judge(parts: int, width: int):
    """Rows of one bucket after the other: packed super-k-mers are unpacked and sorted; decided ranges pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        at, blobs, found = None, [], []

        def solve() -> None:
            known: dict[str, int] = defaultdict()
            known.default_factory = known.__len__
            got = [[], [], [], [], []]
            for blob in blobs:
                raw = expand(blob)
                wide, *sizes = struct.unpack_from("<8I", raw)
                where, fields = 32, []
                for size in sizes:
                    fields.append(raw[where : where + size])
                    where += size
                names = fields[0].decode("utf-8").split("\n")
                to = np.fromiter(map(known.__getitem__, names), np.int32, len(names))
                got[0].append(to[_from_planes(fields[1], sizes[1] // wide, wide)])
                own = _from_planes(fields[4], sizes[4] // 4, 4)
                got[1].append(np.frombuffer(fields[2], np.int64)[own])
                got[2].append(np.frombuffer(fields[3], np.int64)[own])
                got[3].append(_from_planes(fields[5], sizes[5] // 4, 4))
                got[4].append(_from_planes(fields[6], sizes[6] // 4, 4))
            blobs.clear()
            w, doc, mark, start, count = map(np.concatenate, got)
            got.clear()
            codes = np.array([xxhash.xxh64_intdigest(x.encode("utf-8"), 3) for x in known], np.uint64)
            known.clear()
            run = np.repeat(np.arange(len(count), dtype=np.int32), count)  # of each window
            ahead = np.cumsum(count) - count
            first = np.arange(len(run), dtype=np.int32) + (np.arange(len(count)) * (width - 1)).astype(np.int32)[run]
            hashes = _window_hashes(codes, w, first, width)
            slices = -(-len(run) // SLICE)
            own = (hashes % np.uint64(slices)).astype(np.uint16)  # equal windows are judged in one slice
            hit = np.zeros(len(run), bool)
            for k in range(slices):
                some = np.flatnonzero(own == k)
                hit[some] = _seen_before(hashes[some], w, first[some], doc[run[some]], width)
            hit = np.flatnonzero(hit)
            run = run[hit]
            found.extend(_ranges((start - ahead)[run] + hit, doc[run], mark[run], width))
            pa.default_memory_pool().release_unused()

        for batch in batches:
            passed = []
            for bucket, part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part is not None:
                    passed.append((part, blob.as_py()))
                    continue
                if bucket != at and blobs:
                    solve()
                at = bucket
                blobs.append(blob.as_buffer())  # no copy
            if len(found) > 500_000:
                passed += _range_blobs(found, parts)
                found.clear()
            if passed:
                yield _batch_of(passed, ["part", "blob"])
        if blobs:
            solve()
        if found:
            yield _batch_of(list(_range_blobs(found, parts)), ["part", "blob"])

    return run


def shares(docs: DataFrame) -> int:
    """Buckets, and parts: one for each task of a shuffle, more where a bucket would exceed ``SHARE`` bytes of text, since each is held in memory."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-total // SHARE))


def repeated_ranges(docs: DataFrame, parts: int, window: int = WINDOW, mer: int = MER) -> DataFrame:
    """``part, blob``: packed word ranges to remove, of many documents (id, XXH64 of text) a row."""
    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_packer(parts, parts, window, mer), SCHEMA)
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_judge(parts, window), "part int, blob binary")


def _ship_rows(id_at: int, text_at: int, parts: int):
    """Documents as compressed Arrow blocks, one for each part and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))
        for batch in batches:
            ids, texts = batch.column(id_at).to_pylist(), batch.column(text_at).to_pylist()
            own = np.array([_part(LAST if d is None else d, _mark(t or ""), parts) for d, t in zip(ids, texts, strict=True)], np.int64)
            order = np.argsort(own, kind="stable")
            bound = np.flatnonzero(np.append(True, np.diff(own[order]) != 0)).tolist() if len(own) else []
            rows, size = [], 0
            for a, b in zip(bound, [*bound[1:], len(own)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as w:
                    w.write_batch(batch.take(pa.array(order[a:b])))
                rows.append((int(own[order[a]]), True, sink.getvalue().to_pybytes()))
                size += len(rows[-1][2])
                if size > 8_000_000:
                    yield _batch_of(rows, ["part", "docs", "blob"])
                    rows, size = [], 0
            if rows:
                yield _batch_of(rows, ["part", "docs", "blob"])

    return run


def apply_ranges(docs: DataFrame, handle, schema, window: int = WINDOW, mer: int = MER) -> DataFrame:
    """``handle(batch, ranges)`` over batches of ``docs`` with the word ranges of each row (None: nothing repeats)."""
    ship(docs.sparkSession)
    parts = shares(docs)
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    rows = docs.mapInArrow(_ship_rows(id_at, text_at, parts), "part int, docs boolean, blob binary")
    found = repeated_ranges(docs, parts, window, mer).select("part", F.lit(False).alias("docs"), "blob")
    met = found.union(rows).repartition("part").sortWithinPartitions("part", "docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ranges = None, defaultdict(list)
        for batch in batches:
            for part, is_docs, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                blob = blob.as_buffer()  # no copy
                if part != at:
                    at = part
                    ranges.clear()
                if not is_docs:
                    _read_ranges(blob, ranges)
                    continue
                for block in pa.ipc.open_stream(blob):
                    keys = zip(block.column(id_at).to_pylist(), block.column(text_at).to_pylist(), strict=True)
                    yield handle(block, [ranges.get((LAST if d is None else d, _mark(t or ""))) for d, t in keys])

    return met.mapInArrow(run, schema)


def keep_mask(n: int, ranges: list[bytes] | None) -> np.ndarray:
    keep = np.ones(n + 1, np.int32)
    edge = np.zeros(n + 1, np.int32)
    for raw in ranges or ():
        pairs = np.frombuffer(raw, "<u4").reshape(-1, 2)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 1], -1)
    return (keep[:n] > 0) & (np.cumsum(edge[:n]) == 0)


def remove_repeats(docs: DataFrame, window: int = WINDOW, mer: int = MER) -> DataFrame:
    """The columns of ``docs``; a text that loses words becomes its kept words joined by one space (``n_chars`` follows)."""
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def handle(batch: pa.RecordBatch, cuts: list) -> pa.RecordBatch:
        texts, cols = batch.column(text_at).to_pylist(), list(batch.columns)
        for i, cut in enumerate(cuts):
            if cut:
                found = words(texts[i])
                texts[i] = " ".join([x for x, k in zip(found, keep_mask(len(found), cut).tolist(), strict=True) if k])
        cols[text_at] = pa.array(texts, cols[text_at].type)
        if chars_at is not None:
            old = cols[chars_at].to_pylist()
            cols[chars_at] = pa.array([len(t) if c else o for t, c, o in zip(texts, cuts, old, strict=True)], cols[chars_at].type)
        return pa.RecordBatch.from_arrays(cols, names)

    return apply_ranges(docs, handle, docs.schema, window, mer)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def handle(batch: pa.RecordBatch, cuts: list) -> pa.RecordBatch:
        n, removed, sha = [], [], []
        for text, cut in zip(batch.column(1).to_pylist(), cuts, strict=True):
            found = words(text or "")
            n.append(len(found))
            if cut:
                found = [x for x, k in zip(found, keep_mask(len(found), cut).tolist(), strict=True) if k]
            removed.append(n[-1] - len(found))
            sha.append(hashlib.sha256(" ".join(found).encode("utf-8")).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return apply_ranges(docs, handle, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d
), windows AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY sha256(array_to_string(w[i:i + 12], ' '))) AS first_doc FROM starts
), covered AS (
  SELECT DISTINCT doc_id, i + j AS i FROM windows, range(0, 13) AS r(j) WHERE first_doc < doc_id
), kept AS (
  SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN covered USING (doc_id, i)
), texts AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM kept GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(texts.text, '')) AS kept_sha256
FROM d LEFT JOIN texts ON d.doc_id = texts.doc_id
"""
