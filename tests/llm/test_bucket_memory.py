"""A bucket of substring deduplication is judged in slices: same ranges, and memory that stays near the packed words."""

import tracemalloc

import numpy as np
import pytest

from filelake.llm import substring_dedup as S


def bucket(words: int, vocab: int, docs: int):
    rnd = np.random.default_rng(5)
    names = np.array([f"w{k}" for k in range(vocab)])
    chunks = []
    for base in (0, docs):  # two chunks, so that copies meet in the bucket
        chunk = S._Chunk()
        for d in range(docs):
            text = names[np.random.default_rng(d if d % 3 == 0 else rnd.integers(1 << 40)).integers(0, vocab, words // docs // 2)]
            chunk.add(base + d, " ".join(text.tolist()), S.WINDOW)
        chunks += chunk.pack(1, 1, S.WINDOW, S.MER)
    return S._batch_of(chunks, ["bucket", "part", "blob"])


def judged(batch) -> dict:
    found: dict = S.defaultdict(list)
    for out in S._judge(1, S.WINDOW)(iter([batch])):
        for blob in out.column("blob").to_pylist():
            S._read_ranges(blob, found)
    return {k: b"".join(v) for k, v in found.items()}


def test_slices_find_the_same_ranges(monkeypatch):
    batch = bucket(60_000, 400, 30)
    whole = judged(batch)
    monkeypatch.setattr(S, "SLICE", 700, raising=True)
    assert judged(batch) == whole and len(whole) >= 10


@pytest.mark.parametrize("words", [3_000_000])
def test_memory_of_a_bucket_follows_its_words(words):
    batch = bucket(words, 3000, 60)
    tracemalloc.start()
    judged(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 * words, peak / words
