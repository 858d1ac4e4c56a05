"""The index from pairs to their positions: same ids as one merge at a time, and work only where a pair stands."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filelake.llm import bpe


@pytest.fixture(scope="module")
def vocab():
    return bpe.load(public_tokenizers.path("word_bpe_49k.json"))


def test_runs_ties_and_empty_pieces_equal_single_merges(vocab):
    rnd = random.Random(4)
    words = ["", "0", "\u4e2d\u6587", "aaab" * 9, *["a" * n for n in range(60)], *["ab" * n for n in range(110)], *["\u00e9" * n + "ss" for n in range(30)]]
    words += ["".join(rnd.choice("aehlot") for _ in range(rnd.randint(1, 120))) for _ in range(500)]
    index = bpe.PairIndex(vocab)
    assert index.encode(words) == [vocab.merge_piece(w) for w in words]
    assert index.encode([]) == [] and index.encode(["", ""]) == [[], []]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcdeinorst'1\u00e9", max_size=40), max_size=30))
def test_any_pieces_equal_single_merges(words):
    v = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    assert bpe.PairIndex(v).encode(words) == [v.merge_piece(w) for w in words]


@pytest.mark.parametrize("growth", [1.0, 1.05, 4.0])
def test_windows_of_any_width_give_the_same_ids(vocab, monkeypatch, growth):
    monkeypatch.setattr(bpe.PairIndex, "GROWTH", growth)
    words = ["".join(random.Random(n).choice("aehlotrs") for _ in range(30)) for n in range(200)]
    index = bpe.PairIndex(vocab)
    assert index.encode(words) == [vocab.merge_piece(w) for w in words]
    assert (index.window[1:] >= index.window[:-1]).all()
    assert growth > 1 or index.window.tolist() == list(range(len(vocab.ranks) + 1))  # one pair a window: ranks in strict order


def test_a_merge_touches_its_positions_and_their_neighbours_only(vocab):
    """Pre-tokens that share no pair with the others add nothing to the work of these."""
    few, many = bpe.PairIndex(vocab), bpe.PairIndex(vocab)
    words = ["the", "there", "other"]
    still = [w for w in ("zq", "qz", "jq", "qj", "vq", "xj") if len(vocab.merge_piece(w)) == 2]
    assert still
    few.encode(words)
    many.encode(words + still * 1000)
    assert few.touched == many.touched and few.merged == many.merged
    assert few.merged == sum(len(w) - len(vocab.merge_piece(w)) for w in words)
    assert few.touched <= 3 * few.merged + sum(len(w) - 1 for w in words)
