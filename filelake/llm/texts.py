"""Text primitives shared by the operators: ASCII white space, words, chunks of many texts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_OTHER = "\t\n\x0b\x0c\r"


def single_spaced(text: str) -> str:
    """Each run of ``[\\x20\\x09-\\x0D]`` becomes one space; other white space is left alone."""
    for ch in _OTHER:
        if ch in text:
            text = text.replace(ch, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def words(text: str) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    for ch in _OTHER:
        if ch in text:
            text = text.replace(ch, " ")
    parts = text.split(" ")
    return [w for w in parts if w] if "" in parts else parts


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.encode("utf-8").lower().decode("utf-8")


def groups(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Runs of whole texts of about ``size`` bytes, null as empty; a longer text is a run of its own."""
    texts = pc.fill_null(texts, "")
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right")))
        yield texts.slice(at, end - at)
        at = end


def chunks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at single spaces: (distinct chunks, number of each chunk in order, where each text begins and ends among them)."""
    parts = pc.split_pattern(texts, " ")
    bound = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), bound - bound[0]


def joined(values: list, kind: pa.DataType, codes: np.ndarray, bound: np.ndarray) -> tuple[memoryview, list[int]]:
    """The values of all chunks in a row as one buffer, and where each text begins and ends in it; ``kind``: large string or binary."""
    taken = pc.take(pa.array(values, kind), pa.array(codes))
    _, offsets, data = taken.buffers()
    place = np.frombuffer(offsets, np.int64, len(codes) + 1)
    return memoryview(data) if data is not None else memoryview(b""), place[bound].tolist()


class ChunkCache:
    """Values of distinct chunks; new ones are worked out together. Beyond ``limit`` entries those met in more than one group stay."""

    def __init__(self, work: Callable[[list[str]], list], limit: int) -> None:
        self.work, self.limit = work, limit
        self.known: dict = {}
        self.again: set[str] = set()

    def __call__(self, names: list[str]) -> list:
        known = self.known
        new = [c for c in names if c not in known]
        if len(known) + len(new) > self.limit:
            names_ = self.again.union(names)
            self.known = known = {c: v for c, v in known.items() if c in names_}
            self.again = set()
        else:
            self.again.update(known.keys() & names)
        known.update(zip(new, self.work(new), strict=True))
        return [known[c] for c in names]
