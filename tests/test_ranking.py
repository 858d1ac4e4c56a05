"""Running values and row frames: groups in one task and groups over many tasks give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from filelake.operators import placement, ranking, reports, series


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = [(g, k, rnd.choice([None, rnd.randrange(-50, 50)])) for g, n in (("hot", 900), ("a", 1), ("b", 40), (None, 60), ("c", 300)) for k in range(n)]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "g string, t long, v long").repartition(5).persist()


def slow(rows, behind):
    by: dict = {}
    for r in sorted(rows.collect(), key=lambda r: r.t):
        by.setdefault(r.g, []).append(r)
    out = set()
    for g, own in by.items():
        total, top, low, last = 0, None, None, None
        for k, r in enumerate(own):
            if r.v is not None:
                total, top, low, last = total + r.v, r.v if top is None else max(top, r.v), r.v if low is None else min(low, r.v), r.v
            near = [x.v for x in own[max(0, k - behind) : k + 1] if x.v is not None]
            out.add((g, r.t, r.v, total, k + 1, top, low, last, round(sum(near) / len(near), 9) if near else None, own[k - 1].v if k else None))
    return out


@pytest.mark.parametrize(("whole", "behind"), [(0, 1), (0, 400), (1000, 30)])
def test_both_ways_equal_a_slow_loop(spark, rows, monkeypatch, whole, behind):
    monkeypatch.setattr(ranking, "WHOLE", whole)
    monkeypatch.setattr(ranking, "shuffle_partitions", lambda s: 9)
    order = [F.col("t")]
    got = ranking.prefix(rows, ["g"], order, {"total": ("sum", F.col("v")), "n": ("sum", F.lit(1)), "top": ("max", F.col("v")), "low": ("min", F.col("v")), "last": ("last", F.col("v"))})
    got = ranking.frames(got, ["g"], order, behind, lambda w: {"avg": F.round(F.avg("v").over(w.rowsBetween(-behind, 0)), 9), "lag": F.lag("v").over(w)})
    assert {tuple(r) for r in got.collect()} == slow(rows, behind)
    assert ranking.large(rows, ["g"]) == (whole == 0) and not ranking.large(rows.limit(0), ["g"])


def test_a_hot_group_spans_tasks(spark, rows, monkeypatch):
    monkeypatch.setattr(ranking, "shuffle_partitions", lambda s: 9)
    parts = ranking._dealt(rows, ["g"], [F.col("t")]).where("g = 'hot'").select("_part").distinct().count()
    assert parts >= 5


@pytest.mark.parametrize("whole", [0, 1000])
def test_series_and_reports_over_ranges(spark, rows, monkeypatch, whole):
    monkeypatch.setattr(ranking, "WHOLE", whole)
    named = rows.where("g is not null and v is not null").withColumn("us", F.col("t") * 1_000_000)
    plain = {r.g: sorted(x.t for x in named.where(F.col("g") == r.g).collect()) for r in named.select("g").distinct().collect()}
    last = series.latest(named, "g", ["t"], 25).collect()
    assert {g: sorted(r.t for r in last if r.g == g) for g in plain} == {g: ts[-25:] for g, ts in plain.items()}
    kept = reports.capped(named, 10, ["g"], ["t"]).collect()
    assert {(r.g, r["rank"], r.t, r.total, r.truncated) for r in kept} == {(g, k + 1, t, len(ts), len(ts) > 10) for g, ts in plain.items() for k, t in enumerate(ts[:10])}
    rate = series.delta_rate(named, "g", ["t"], "v", F.col("us")).where("g = 'hot'").orderBy("t").collect()
    assert all(b.rate == (max(0, b.v - a.v) / (b.t - a.t) if b.v > a.v else 0) for a, b in zip(rate, rate[1:], strict=False)) and rate[0].rate == 0
    held = spark.createDataFrame([("d", "x.jpg")] + [("d", f"x({n}).jpg") for n in range(1, 200) if n % 7], "dir string, name string")
    new = spark.createDataFrame([("d", "x.jpg", f"p{k:03d}") for k in range(40)], "dir string, name string, path string")
    names = [r.final_name for r in placement.place(new, held).orderBy("path").collect()]
    free = [n for n in range(1, 400) if n % 7 == 0 or n > 199]
    assert names == [f"x({n}).jpg" for n in free[:40]]
