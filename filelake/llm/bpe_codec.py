"""BPE encoding and decoding over a pair occurrence index.

A task takes its texts in groups of about ``GROUP`` bytes, gathers the chunks (texts cut
at spaces and line ends) not yet in the worker's cache and encodes their pre-tokens all at
once (``PairIndex``); texts are then put together from cached chunks. Whole texts only, of any
length; a text longer than a group is a group of its own. A cache beyond ``CACHE`` chunks
keeps those met in more than one group, which bounds memory and changes no result.

Null text counts as empty (no ids, empty decoding). Repeated rows each give a row, a null id
stays null, an empty table gives no rows. Only id and text are read, so further columns of
any name do no harm.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.llm.bpe import PairIndex, Vocabulary, load
from filelake.llm.texts import ChunkCache, chunks, groups, joined
from filelake.session import ship

CACHE = 400_000
GROUP = 8_000_000  # bytes of text


class Codec:
    """Encodes texts; decodes ids. Only for vocabularies that drop white space (``words``)."""

    def __init__(self, vocab: Vocabulary) -> None:
        if not vocab.words:
            raise ValueError("white space must not be part of a token")
        self.vocab = vocab
        self.index = PairIndex(vocab)
        self.known = ChunkCache(self.encode_chunks, CACHE)
        self.shown = [f" {i}" for i in range(len(vocab.tokens))], [f" {t}" for t in vocab.tokens]

    def _show(self, ids: list[int]) -> tuple[str, str, int]:
        number, token = self.shown
        return "".join([number[i] for i in ids]), "".join([token[i] for i in ids]), len(ids)

    def encode_chunks(self, new: list[str]) -> list[tuple[str, str, int]]:
        """Ids and tokens of each chunk, each with a space before it, and their number: all pre-tokens go through the pair index together."""
        v, plain, out = self.vocab, new, {}
        if v.any_odd(" ".join(new)):
            plain = [c for c in new if not v.odd(c)]
            out = {c: self._show(v.encode_odd(c)) for c in set(new).difference(plain)}
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        rows: list[list[int]] = [[]]
        for piece in v.pieces_of(plain):
            if piece == " ":
                rows.append([])
            else:
                rows[-1].append(number[piece])
        shown = [self._show(ids) for ids in self.index.encode(list(number))]
        for c, row in zip(plain, rows, strict=False):
            if len(row) == 1:
                out[c] = shown[row[0]]
            else:
                found = [shown[p] for p in row]
                out[c] = "".join([f[0] for f in found]), "".join([f[1] for f in found]), sum([f[2] for f in found])
        return [out[c] for c in new]

    def code(self, texts: pa.Array) -> Iterator[tuple[int, memoryview, memoryview]]:
        """(number of ids, ids joined by one space, decoded text) of each text. No decoder is named in the file: tokens are joined by one space."""
        for group in groups(texts, GROUP):
            names, codes, bound = chunks(pc.replace_substring(group, "\n", " "))
            found = self.known(names)
            ids, at = joined([f[0] for f in found], pa.large_string(), codes, bound)
            decoded, to = joined([f[1] for f in found], pa.large_string(), codes, bound)
            total = np.append(0, np.cumsum(np.array([f[2] for f in found], np.int64)[codes]))[bound]
            for n, a, b, c, d in zip(np.diff(total).tolist(), at, at[1:], to, to[1:], strict=False):
                yield n, ids[min(a + 1, b) : b], decoded[min(c + 1, d) : d]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.vocab.tokens.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(load(path))
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids array<int>, decoded``: the operator's real output. Null text: no ids, empty decoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids, decoded = [], []
            for _, a, d in c.code(batch.column(1)):
                ids.append(list(map(int, bytes(a).split())))
                decoded.append(str(d, "utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], [id_col, "ids", "decoded"])

    src = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    ship(docs.sparkSession)
    return src.mapInArrow(run, f"{id_col} long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and of the decoded text, without moving either out of the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, a, d = [], [], []
            for count, ids, decoded in c.code(batch.column(1)):
                n.append(count)
                a.append(hashlib.sha256(ids).hexdigest())
                d.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ship(docs.sparkSession)
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_codec(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or public_tokenizers.path("word_bpe_49k.json"))
