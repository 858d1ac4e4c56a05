"""Clustering against plain integers, and the screening's intervals against exact distances."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from filelake.llm import centroids


def slow(rows: list[tuple], k: int, rounds: int, dim: int) -> list[tuple]:
    kept = [(i, [max(-centroids.LIMIT - 1, min(centroids.LIMIT, math.floor(256 * x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    c = [v[:] for _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), n) for n, m in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for n, vs in own.items():
            c[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *near(v)) for i, v in kept] if c else []
    bound = lambda x: min(centroids.LIMIT, x)
    each = lambda n: sum(bound(d) for _, d, m in found if m == n)
    return [(i, n, bound(d), bound(each(n)), bound(sum(bound(x[1]) for x in found)), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in found]


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_shortlists_lose_no_nearest_centroid(seed):
    rnd = np.random.default_rng(seed)
    reach = [3, 200, 1 << 24, 1 << 40][seed]
    c = rnd.integers(-reach, reach, (40, 16))
    c[7] = c[3]
    x = np.concatenate([rnd.integers(-reach, reach, (500, 16)), (c[:20] + c[20:]) // 2, c])
    apart = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(r, m, strict=True)) for m in c] for r in x], object)
    screen = centroids.Screen(c)
    assert screen.assign(x).tolist() == [min(range(40), key=lambda n: (d[n], n)) for d in apart]
    possible = screen.shortlist(x)
    assert all(possible[r][d == d.min()].all() for r, d in enumerate(apart)) and possible.sum() < x.shape[0] * (40 if seed == 0 else 3)


def vectors(dim: int = 64) -> list[tuple]:
    rnd = random.Random(4)
    near = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    out = [(k, [x + rnd.gauss(0, 0.2) for x in rnd.choice(near)]) for k in range(300)]
    out += [(300 + k, near[0]) for k in range(40)] + [(7, near[1]), (7, near[1]), (None, near[2])]
    return out + [(900, None), (901, []), (902, [1.0] * (dim - 1)), (903, [1.0] * (dim - 1) + [None]), (904, [math.nan] * dim), (905, [math.inf] * dim), (906, [-0.0] * dim)]


@pytest.mark.parametrize("extra", ["plain", "huge", "few"])
def test_query_equals_plain_integers(spark, tmp_path, extra):
    rows = vectors()
    rows = rows[:5] + rows[340:] if extra == "few" else rows + [(950, [1e30] * 64), (951, [-1e17] * 64)] if extra == "huge" else rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.selectExpr("*", "'odd' as cluster", "1 as c", "2 as v").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = centroids.op11_centroids(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(slow(rows, 40, 5, 64), key=repr)


def test_empty(spark, tmp_path):
    spark.createDataFrame([(None, [0.5] * 64), (1, [2.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert centroids.op11_centroids(spark, str(tmp_path)).count() == 0
