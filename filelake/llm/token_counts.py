"""Token counts by whole-token shortcut.

Offline, on the driver, every vocabulary string is merged alone; those that end as one
token are *whole* (bounded by the vocabulary, sent as one broadcast). A pre-token among
them counts one without any merging; only the rest are merged, and remembered. Chunks
(texts cut at single spaces) remember the count of their pre-tokens.

Null text counts as empty (0 bytes, 0 tokens). Repeated rows each give a row, a null id stays
null, an empty table gives no rows, texts of any length are counted whole. Only id and text
are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.llm.bpe import JOINS, Vocabulary, load
from filelake.llm.texts import ChunkCache, chunks, groups
from filelake.session import ship

CACHE = 400_000
GROUP = 8_000_000  # bytes of text that are counted together


@lru_cache(maxsize=4)
def proved(path: str) -> frozenset[str]:
    return load(path).whole_tokens()


class Counts:
    """Tokens of each chunk, summed over pre-tokens: whole ones count one, the rest are merged."""

    def __init__(self, vocab: Vocabulary, whole: frozenset[str]) -> None:
        self.vocab, self.whole = vocab, whole
        self.merged: dict[str, int] = {}
        self.known = ChunkCache(self.led, CACHE)

    def tokens(self, text: str, rare: bool = True) -> int:
        """Tokens of a text that stands alone; ``rare``: it may hold odd characters."""
        v, n = self.vocab, 0
        if rare and v.odd(text):
            return len(v.encode_odd(text))
        for piece in v.pieces(text):
            if piece in self.whole:
                n += 1
                continue
            m = self.merged.get(piece)
            if m is None:
                m = len(v.merge_piece(piece))
                if len(piece) < 200:
                    self.merged[piece] = m
            n += m
        return n

    def led(self, new: list[str]) -> list[int]:
        """Tokens of each chunk with a space before it."""
        if len(self.merged) > CACHE:
            self.merged.clear()
        rare = self.vocab.any_odd(" ".join(new))
        return [self.tokens(" " + c, rare) for c in new]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text. The first chunk of a text has no space before it; a text where ``JOINS`` matches is counted whole."""
        out = [np.zeros(0, np.int64)]
        for group in groups(texts, GROUP):
            whole = pc.match_substring_regex(group, JOINS).to_numpy(zero_copy_only=False)
            names, codes, bound = chunks(pc.if_else(pa.array(whole), "", group))
            heads, own = np.unique(codes[bound[:-1]], return_inverse=True)
            codes[bound[:-1]] = len(names) + own
            n = np.array([*self.known(names), *(self.tokens(names[h]) for h in heads.tolist())], np.int64)
            total = np.diff(np.append(0, np.cumsum(n[codes]))[bound])
            for k in np.flatnonzero(whole).tolist():
                total[k] = self.tokens(group[k].as_py())
            out.append(total)
        return np.concatenate(out)


_COUNTS: dict[str, Counts] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = ship(docs.sparkSession)
    whole = spark.sparkContext.broadcast(proved(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _COUNTS.get(path)
        if counts is None:
            counts = _COUNTS[path] = Counts(load(path), whole.value)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(counts.count(texts))], [id_col, "n_bytes", "n_tokens"])

    src = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return src.mapInArrow(run, f"{id_col} long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or public_tokenizers.path("byte_bpe_50k.json"))
