"""Nearest neighbours: exact distances, recall against brute force, encoding against a plain beam search, odd inputs."""

import math
import random

import numpy as np
import pytest

from filelake.llm import additive_search as A


def slow(rows: list[tuple], asked: list[int], k: int) -> dict[int, list[tuple]]:
    good = sorted({(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for q in asked:
        mine = min((v for i, v in good if i == q), key=lambda v: (len(v), v), default=None)
        if mine is not None:
            found = [(math.sqrt(sum((a - b) ** 2 for a, b in zip(v, mine, strict=True))), i) for i, v in good if i != q and len(v) == len(mine)]
            out[q] = sorted(found)[:k]
    return out


def recall(got: list, want: dict, k: int) -> float:
    found: dict = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(want[q]) + 1)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
    assert set(found) == {q for q, w in want.items() if w}
    return sum(len({r[2] for r in found[q]} & {i for _, i in w}) for q, w in want.items() if w) / sum(len(w) for w in want.values())


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(3000, 16)).astype(np.float32)
    out = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    return out + [(4000 + k, out[0][1]) for k in range(60)] + [(0, out[5][1]), (0, out[5][1]), (100, out[7][1])]


def test_query_has_exact_scores_and_recall(spark, rows, tmp_path):
    odd = [(5000, None), (5100, []), (5200, [0.0] * 16), (5300, [math.nan] * 16), (5400, [1.0] * 15 + [None]), (5500, [math.inf] * 16), (None, rows[1][1]), (5600, [1.0, 2.0]), (5601, [1.0, 2.5]), (5700, [3.0])]
    every = rows + odd
    spark.createDataFrame(every, "vec_id long, embedding array<double>").selectExpr("*", "'odd' as rank", "1 as dim", "2 as id", "3 as v").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = A.op13_additive_search(spark, str(tmp_path))
    got = df.collect()
    assert df.columns == ["query_id", "rank", "vec_id", "score"] and [f.dataType.simpleString() for f in df.schema] == ["bigint", "int", "bigint", "double"]
    want = slow(every, sorted({i for i, _ in every if i is not None and i % 100 == 0}), 10)
    assert recall(got, want, 10) >= 0.95
    at: dict = {}
    for i, v in every:
        if i is not None:
            at.setdefault(i, []).append(v)
    for r in got:
        mine = min(at[r.query_id])
        assert any(len(v or []) == len(mine) and r.score == math.sqrt(float(((np.array(v, float) - np.array(mine, float)) ** 2).sum())) for v in at[r.vec_id])
    zero = sorted((r.rank, r.vec_id) for r in got if r.query_id == 4000)
    assert zero == [(k + 1, i) for k, i in enumerate([0, *range(4001, 4010)])]  # of many copies the smallest ids
    assert [(r.vec_id, r.score) for r in got if r.query_id == 5600] == [(5601, 0.5)] and not [r for r in got if r.query_id == 5700]


@pytest.mark.parametrize("lengths", [0, 100])
def test_blocks_do_not_change_the_result_much(spark, rows, monkeypatch, lengths):
    monkeypatch.setattr(A, "LENGTHS", lengths)
    monkeypatch.setattr(A, "SETS", lengths)
    monkeypatch.setattr(A, "SAMPLE", 1000)
    monkeypatch.setattr(A, "BLOCK", 500)
    monkeypatch.setattr(A, "RERANK", 100)
    df = spark.createDataFrame(rows, "i long, e array<float>")
    got = A.nearest(df, df.where("i % 200 = 0"), 5, "i", "e").collect()
    want = slow([(i, np.array(v, np.float32).tolist()) for i, v in rows], sorted({i for i, _ in rows if i % 200 == 0}), 5)
    assert recall(got, want, 5) >= 0.95


def test_beam_search_and_norms():
    rnd = np.random.default_rng(2)
    books, x = rnd.normal(size=(3, 5, 4)).astype(np.float32), rnd.normal(size=(40, 4)).astype(np.float32)
    codes, norms = A.encode(x, books, beam=2)
    for v, c, n in zip(x, codes, norms, strict=True):
        paths = [((), v)]
        for book in books:
            longer = [((*p, w), r - word) for p, r in paths for w, word in enumerate(book)]
            paths = sorted(longer, key=lambda p: float((p[1] ** 2).sum()))[:2]
        got, best = sum(books[m][c[m]] for m in range(3)), v - paths[0][1]
        assert np.allclose(got, best, atol=1e-5) and np.isclose(n, (got**2).sum(), rtol=1e-4)
    wide = A.encode(x, books, beam=125)[0]
    every = np.array([books[0][a] + books[1][b] + books[2][c] for a in range(5) for b in range(5) for c in range(5)])
    assert np.allclose([((v - sum(books[m][c[m]] for m in range(3))) ** 2).sum() for v, c in zip(x, wide, strict=True)], ((x[:, None] - every) ** 2).sum(2).min(1), atol=1e-4)


def test_sweeps_lower_the_error():
    x = np.random.default_rng(3).normal(size=(2000, 8)).astype(np.float32)
    books = A.fit(x, 4)
    codes, _ = A.encode(x, books)
    error = ((x - sum(books[m][codes[:, m]] for m in range(4))) ** 2).sum() / (x**2).sum()
    assert error < 0.05 and np.array_equal(books, A.fit(x, 4))


def test_empty_and_huge(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert A.nearest(df, df, 3).count() == 0
    rnd = random.Random(1)
    df = spark.createDataFrame([(k, [rnd.gauss(0, 1) * 10 ** rnd.choice([0, 30, 150]) for _ in range(4)]) for k in range(50)] + [(99, [1e308, -1e308, 0.0, 0.0]), (98, [-1e308, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = A.nearest(df, df, 60).collect()
    assert len(got) == 52 * 51 and all(not math.isnan(r.score) for r in got)
