"""Segments of the impact index: their order, and the proof that ends a query early."""

import numpy as np
import pytest

from filelake.llm.impact_search import LEVELS, SEGMENTS, BlockIndex


def brute(ids, rows, qid, q, k):
    score = rows @ q
    found = sorted((-int(s), int(i)) for s, i in zip(score, ids, strict=True) if i != qid)
    return [(int(qid), -s, i) for s, i in found[:k]]


def test_segments_hold_every_posting_once_by_quantised_magnitude():
    rows = np.random.default_rng(1).integers(-40, 40, (300, 7))
    rows[:, 3] = 0
    index = BlockIndex(np.arange(300), rows)
    assert sorted(index.at.tolist()) == np.flatnonzero(rows.ravel()).tolist()
    for part, begin, end, most in zip(index.part, index.begin, index.end, index.most, strict=True):
        at = index.at[begin:end]
        size, top = np.abs(rows.ravel()[at]), np.abs(rows[:, part]).max()
        assert (at % 7 == part).all() and size.max() == most
        assert len(set(np.ceil(size * (SEGMENTS / top)))) == 1
    assert len(index.part) == len(set(zip(index.part, np.ceil(index.most * SEGMENTS / np.abs(rows).max(axis=0)[index.part]), strict=True)))


def test_tiers_fall_in_impact_and_cover_every_segment():
    rng = np.random.default_rng(2)
    index, weight = BlockIndex(np.arange(500), rng.integers(-99, 99, (500, 9))), np.abs(rng.integers(-9, 9, 9)).astype(float)
    tiers = index.tiers(weight)
    top = [(weight[index.part[t]] * index.most[t]).max() for t in tiers]
    assert len(tiers) <= LEVELS and top == sorted(top, reverse=True)
    assert sorted(np.concatenate(tiers).tolist()) == np.flatnonzero(weight[index.part] > 0).tolist()


@pytest.mark.parametrize("many", [1, 5, 6, 7, 900])
def test_blocks_of_every_size_equal_brute_force(many):
    rng = np.random.default_rng(many)
    ids, rows = rng.integers(0, max(2, many // 2), many), rng.integers(-3, 4, (many, 6))
    queries = np.concatenate([rows[:70], np.zeros((1, 6), int), rng.integers(-3, 4, (3, 6))])
    qids = np.append(ids[:70], [-1, -2, -3, -4])
    got = {}
    for q, s, i in BlockIndex(ids, rows).top(np.arange(len(qids)) + 10**6, queries, 5):
        got.setdefault(q, []).append((q, s, i))
    for n in range(len(qids)):
        assert got.get(n + 10**6, []) == brute(ids, rows, n + 10**6, queries[n], 5)
    for q, x in zip(qids, queries, strict=True):
        assert BlockIndex(ids, rows).top(np.array([q]), x[None], 5) == brute(ids, rows, q, x, 5)


def test_queries_stop_on_proof_before_the_last_posting():
    """Close neighbours among many rows: the low segments are never met and few rows are rescored."""
    rng = np.random.default_rng(3)
    rows = rng.normal(0, 80, (4000, 32)).astype(np.int64)
    rows[1::20] = rows[::20] + rng.integers(-9, 9, (200, 32))
    index, asked = BlockIndex(np.arange(4000), rows), np.arange(0, 4000, 20)
    got = index.top(asked, rows[asked], 1)
    assert sorted(got) == sorted(x for n in asked for x in brute(np.arange(4000), rows, n, rows[n], 1))
    assert index.met < 0.85 * len(asked) * len(index.at) and index.rescored < 0.05 * len(asked) * 4000
