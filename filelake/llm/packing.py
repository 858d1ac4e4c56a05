"""Hierarchical multi-length packing into context-size tiers of up to ``WINDOW`` tokens.

Every document is its token ids plus one end id. Full windows are cut off first; the rest of
each document is routed to the tier (context size ``WINDOW``, a half, a quarter, an eighth)
that is just long enough. Each tier packs its own pieces into sequences of its own size, the
longest first; a gap is filled from the shorter tiers, each time with the longest whole piece
that fits, and what stays open with the start of a piece of the tier itself (of a shorter one if
it has none), whose rest goes back to the tier of its length. So every sequence is full. Only
the last pieces of a packing task may not fill one; they are laid in a row and cut at powers of
two, which need no padding either. ``tier_report`` counts sequences, pieces and padding by tier.

Packing is local to a scan task and runs every ``HOLD`` buffered pieces, so there is no
shuffle, memory is bounded and a lost task repeats exactly. The sequences of a tier are dealt
to step groups of ``STEP`` tokens in a snake over attention cost (sum of squared piece lengths).

Null text is empty: its document is the end id alone. Repeated rows are packed each, a null id
stays null, an empty table gives no rows, texts of any length are encoded whole. Only id and
text are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.llm.bpe import JOINS, Vocabulary, load
from filelake.llm.texts import ChunkCache, chunks, groups, joined
from filelake.session import ship

WINDOW = 1024
HOLD = 8192
STEP = 8 * WINDOW  # tokens of a step group
CACHE = 300_000
END = b"\0\0\0\0"
GROUP = 8_000_000  # bytes of text that are encoded together
TOGETHER = 20_000  # chunks that one call of the library encodes
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class IdBytes:
    """Little-endian 32-bit ids of texts; the chunks of a group of texts that are new are encoded together."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.known = ChunkCache(self.led, CACHE)

    def alone(self, text: str) -> bytes:
        v = self.vocab
        return array("I", v.encode_odd(text) if v.odd(text) else v.plain(text)).tobytes()

    def led(self, new: list[str]) -> list[bytes]:
        """Ids of each chunk with a space before it. A space can only begin a token, so tokens that begin with one cut the ids
        of many chunks in a row into chunks; chunks that begin with other white space or hold odd characters are encoded alone."""
        v = self.vocab
        rare = v.any_odd(" ".join(new))
        plain = [c for c in new if c and not c[0].isspace() and not (rare and v.odd(c))]
        out = {c: self.alone(" " + c) for c in set(new).difference(plain)} if len(plain) < len(new) else {}
        for k in range(0, len(plain), TOGETHER):
            part = plain[k : k + TOGETHER]
            ids = np.array(v.plain(" " + " ".join(part)), "<u4")
            cut = np.flatnonzero(v.spaces[ids]).tolist()
            raw = ids.tobytes()
            if len(cut) == len(part):
                out.update(zip(part, [raw[4 * x : 4 * y] for x, y in zip(cut, [*cut[1:], len(ids)], strict=True)], strict=True))
            else:
                out.update((c, self.alone(" " + c)) for c in part)
        return [out[c] for c in new]

    def encode(self, texts: pa.Array) -> Iterator[memoryview | bytes]:
        """Ids of each text. The first chunk of a text has no space before it; a text where ``JOINS`` matches is encoded whole."""
        for group in groups(texts, GROUP):
            whole = pc.match_substring_regex(group, JOINS).to_numpy(zero_copy_only=False)
            names, codes, bound = chunks(pc.if_else(pa.array(whole), "", group))
            heads, own = np.unique(codes[bound[:-1]], return_inverse=True)
            codes[bound[:-1]] = len(names) + own
            values = self.known(names) + [self.alone(names[h]) for h in heads.tolist()]
            data, at = joined(values, pa.large_binary(), codes, bound)
            for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                yield self.alone(group[k].as_py()) if whole[k] else data[a:b]


class Packer:
    """Packs pieces (length, order, doc index, start) of one task; tiers are sorted by length."""

    def __init__(self, window: int = WINDOW) -> None:
        self.least = max(1, window // 8)
        self.tiers: dict[int, list[tuple]] = {}
        while window >= self.least:
            self.tiers[window] = []
            window >>= 1
        self.order = 0
        self.held = 0

    def add(self, doc: int, start: int, length: int) -> None:
        """Route a piece to the shortest tier that holds it."""
        self.order += 1
        insort(self.tiers[max(self.least, 1 << (length - 1).bit_length())], (length, self.order, doc, start))
        self.held += 1

    def _fill(self, room: int, tiers: list[int]) -> tuple | None:
        """The longest piece of ``tiers`` that fits into ``room``."""
        for size in tiers:
            at = bisect_left(self.tiers[size], (room + 1,))
            if at:
                return self.tiers[size].pop(at - 1)
        return None

    def windows(self, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        """Full sequences of (doc, start, length), tier after tier; with ``last`` also what is left, cut at powers of two."""
        left: list[tuple] = []
        for size in list(self.tiers):
            own = self.tiers[size]
            shorter = [s for s in self.tiers if s < size] or [size]
            while own:
                pieces, room = [own.pop()], size
                room -= pieces[0][0]
                while room and (got := self._fill(room, shorter)):
                    pieces.append(got)
                    room -= got[0]
                if room:
                    source = own or next((self.tiers[s] for s in reversed(shorter) if self.tiers[s]), None)
                    if not source:
                        left += pieces
                        break
                    length, _, doc, start = source.pop(0)
                    pieces.append((room, 0, doc, start))
                    self.add(doc, start + room, length - room)
                yield [(doc, start, length) for length, _, doc, start in pieces]
        self.held = 0
        if last:
            yield from _binary([(doc, start, length) for length, _, doc, start in left], sum(p[0] for p in left))
        else:
            for length, _, doc, start in left:
                self.add(doc, start, length)


def _binary(pieces: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    """Cut pieces in a row at powers of two, of ``WINDOW`` at most: no padding at all."""
    queue = deque(pieces)
    while total:
        room, out = min(WINDOW, 1 << (total.bit_length() - 1)), []
        total -= room
        while room:
            doc, start, length = queue.popleft()
            part = min(room, length)
            out.append((doc, start, part))
            room -= part
            if length > part:
                queue.appendleft((doc, start + part, length - part))
        yield out


def step_groups(found: list[list[int]], first: int) -> list[int]:
    """Step group of each sequence (lengths of its pieces): the sequences of a tier are dealt in a snake over falling cost."""
    tiers: dict[int, list[int]] = {}
    for i, lengths in enumerate(found):
        tiers.setdefault(1 << (sum(lengths) - 1).bit_length(), []).append(i)
    out = [0] * len(found)
    for size, members in sorted(tiers.items()):
        n = -(-len(members) * size // STEP)
        for place, i in enumerate(sorted(members, key=lambda i: (-sum(x * x for x in found[i]), i))):
            lap, at = divmod(place, n)
            out[i] = first + (at if lap % 2 == 0 else n - 1 - at)
        first += n
    return out


_IDS: dict[str, IdBytes] = {}


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; ``sequence_id`` and ``step_group`` are unique over all tasks. ``window``: a power of two up to ``WINDOW``."""
    if window & (window - 1) or not 0 < window <= WINDOW:
        raise ValueError(f"window must be a power of two up to {WINDOW}")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _IDS.get(path)
        if ids is None:
            ids = _IDS[path] = IdBytes(load(path))
        base = TaskContext.get().partitionId() << 36
        sequence, group, docs_seen = 0, 0, 0
        packer, tails = Packer(window), {}

        def emit(found: list[tuple[list, tuple | None]]) -> pa.RecordBatch:
            nonlocal sequence, group
            steps = step_groups([[p[2] for p in pieces] for pieces, _ in found], group)
            group = max(steps, default=group - 1) + 1
            rows = []
            for (pieces, own), step in zip(found, steps, strict=True):
                offset, total = 0, sum([p[2] for p in pieces])
                for doc, start, length in pieces:
                    doc_id, raw, begin, tokens = own or tails[doc]
                    at = (start - begin) * 4
                    rows.append((doc_id, start, length, zlib.crc32(raw[at : at + length * 4]), tokens, base + sequence, offset, 1 << (total - 1).bit_length(), base + step))
                    offset += length
                sequence += 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])

        for batch in batches:
            found: list = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), ids.encode(batch.column(1)), strict=True):
                raw = b"".join((raw, END))
                tokens = len(raw) // 4
                full = tokens - tokens % window
                whole = (doc_id, memoryview(raw), 0, tokens)
                found += [([(-1, k, window)], whole) for k in range(0, full, window)]
                if tokens > full:
                    tails[docs_seen] = (doc_id, raw[full * 4 :], full, tokens)
                    packer.add(docs_seen, full, tokens - full)
                    docs_seen += 1
                if packer.held >= HOLD or len(found) >= HOLD:
                    found += [(w, None) for w in packer.windows(False)]
                    yield emit(found)
                    found = []
                    held = {p[2] for tier in packer.tiers.values() for p in tier}
                    tails = {d: t for d, t in tails.items() if d in held}
            if found:
                yield emit(found)
        yield emit([(w, None) for w in packer.windows(True)])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, SCHEMA)


def tier_report(pieces: DataFrame) -> DataFrame:
    """By tier: sequences, tokens, padding tokens, pieces, pieces that are not whole documents, step groups."""
    own = pieces.groupBy("tier", "sequence_id").agg(
        F.sum("length").alias("tokens"), F.count("*").alias("pieces"), F.count_if(F.col("length") < F.col("doc_tokens")).alias("cut"), F.min("step_group").alias("step_group"),
    )
    return own.groupBy("tier").agg(
        F.count("*").alias("sequences"), F.sum("tokens").alias("tokens"), F.sum(F.col("tier") - F.col("tokens")).alias("padding"),
        F.sum("pieces").alias("pieces"), F.sum("cut").alias("cut_pieces"), F.approx_count_distinct("step_group").alias("step_groups"),
    )


def op10_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or public_tokenizers.path("byte_bpe_50k.json"))
