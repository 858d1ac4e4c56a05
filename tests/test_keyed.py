"""The keyed, versioned tables: merges touch their buckets only, writers do not lose rows, old schemas open."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from filelake.operators import claims
from filelake.operators.keyed import KeyedTable
from filelake.operators.stores import CACHE, OWNERS, CacheTable, OwnerTable, clear

KV = "k string, v long"


def upsert(old, new):
    return old.join(new, "k", "left_anti").unionByName(new)


def kv(spark, **rows):
    return spark.createDataFrame(list(rows.items()), KV)


def test_merge_touches_only_its_buckets(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", "k", KV, buckets=16)
    assert t.read().count() == 0 and t.versions() == [] and t.merge(kv(spark).limit(0), upsert) == 0
    assert t.merge(spark.range(200).select(F.format_string("k%d", "id").alias("k"), F.col("id").alias("v")), upsert) == 1
    before = t.manifest()
    assert t.merge(kv(spark, k3=-3, new=1), upsert) == 2
    after = t.manifest()
    changed = {b for b in after["parts"] if after["parts"][b] != before["parts"].get(b)}
    assert len(before["parts"]) == 16 and 1 <= len(changed) <= 2
    got = {r.k: r.v for r in t.read().collect()}
    assert len(got) == 201 and got["k3"] == -3 and got["k4"] == 4 and got["new"] == 1
    assert {r.k: r.v for r in t.read(1).collect()}["k3"] == 3  # an older version stays as it was
    assert t.delete(kv(spark, k3=0, none=0)) == 3 and t.read().where("k = 'k3'").count() == 0 and t.read().count() == 200
    assert t.rebucket(5) == 4 and t.manifest()["buckets"] == 5 and t.read().count() == 200
    assert t.clear() == 5 and t.read().count() == 0 and t.merge(kv(spark, a=1), upsert) == 6
    assert t.vacuum(keep=1, hours=0) >= 3 and t.versions() == [6] and [tuple(r) for r in t.read().collect()] == [("a", 1)]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    rows = [spark.createDataFrame([("same", f"p{k}", f"d{k}", 1), (f"own{k}", f"p{k}", f"d{k}", 1)], OWNERS) for k in range(4)]
    failed = []

    def write(k: int) -> None:
        try:
            OwnerTable(spark, f"{tmp_path}/o", buckets=2).commit(rows[k])
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    table = OwnerTable(spark, f"{tmp_path}/o")
    got = {r.sha256: (r.canonical, r.destination_path) for r in table.read().collect()}
    assert not failed and table.versions() == [1, 2, 3, 4] and set(got) == {"same", "own0", "own1", "own2", "own3"}
    assert got["same"][0][1:] == got["same"][1][1:]  # one of the claimants, with its own destination
    assert table.read().count() == 5


def test_a_failed_merge_leaves_the_table_alone(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", "k", KV, buckets=2)
    t.merge(kv(spark, a=1), upsert)
    with pytest.raises(Exception, match="broken"):
        t.merge(kv(spark, b=2), lambda old, new: upsert(old, new).withColumn("v", F.raise_error(F.lit("broken")).cast("long")))
    assert [tuple(r) for r in t.read().collect()] == [("a", 1)] and t.versions() == [1]
    assert t.vacuum(hours=0) <= 1 and [tuple(r) for r in t.read().collect()] == [("a", 1)]


def test_old_schemas_open_with_their_rows(spark, tmp_path):
    old = KeyedTable(spark, f"{tmp_path}/o", "sha256", "sha256 string, canonical string", buckets=2)
    old.merge(spark.createDataFrame([("h1", "a"), ("h2", "b")], "sha256 string, canonical string"), lambda o, n: n)
    owners = OwnerTable(spark, f"{tmp_path}/o")
    assert sorted(map(tuple, owners.read().collect())) == [("h1", "a", None, None), ("h2", "b", None, None)]
    owners.commit(spark.createDataFrame([("h1", "a", "d/a", 5), ("h2", "other", "d/x", 6), ("h3", "c", "d/c", 7)], OWNERS))
    assert sorted(map(tuple, owners.read().collect())) == [("h1", "a", "d/a", 5), ("h2", "b", None, None), ("h3", "c", "d/c", 7)]
    assert {p[1] for p in owners.manifest()["parts"].values()} == {2} and json.loads(next(iter(owners.manifest()["parts"].values()))[2])["type"] == "struct"
    first = "path string, size long, mtime timestamp, sha256 string"
    legacy = KeyedTable(spark, f"{tmp_path}/c", "path", first, buckets=2)
    stamp = "2024-01-01 00:00:00"
    rows = spark.createDataFrame([(f"img{k}", 1000 * k, f"hash-{k % 2}") for k in range(1, 4)], "path string, size long, sha256 string").withColumn("mtime", F.to_timestamp(F.lit(stamp)))
    legacy.merge(rows, lambda o, n: n)
    cache = CacheTable(spark, f"{tmp_path}/c")
    assert [(r.path, r.size, r.partial_sha256, r.mime) for r in cache.read().orderBy("path").collect()] == [(f"img{k}", 1000 * k, None, None) for k in range(1, 4)]
    fresh = OwnerTable(spark, f"{tmp_path}/n", buckets=2)
    fresh.commit(spark.createDataFrame([("hash-0", "zz", "d", 1)], OWNERS))
    fresh.backfill(cache.read())  # insert or ignore
    assert sorted((r.sha256, r.canonical, r.destination_path) for r in fresh.read().collect()) == [("hash-0", "zz", "d"), ("hash-1", "img1", None)]
    cache.upsert(spark.createDataFrame([("img2", 5, None, "x", "y", "image/jpeg", None)], CACHE))
    assert cache.read().where("path = 'img2'").first().size == 5 and cache.read().count() == 3
    cache.delete(spark.createDataFrame([("img1",)], "path string"))
    assert cache.read().count() == 2 and clear(fresh, cache) and fresh.read().count() == cache.read().count() == 0


def test_owner_updates(spark):
    owners = spark.createDataFrame([("h1", "a", "d/a", 1), ("h2", "b", None, None), ("h4", None, "d/n", 9)], OWNERS)
    new = spark.createDataFrame([("h1", "a", "d/a(1)", 2), ("h1", "x", "d/x", 3), ("h2", "b", "d/b", 4), ("h3", "q", "d/q", 5), ("h3", "p", "d/p", 6), ("h4", None, "d/m", 8)], OWNERS)
    got = sorted(map(tuple, claims.commit_claims(owners, new).collect()))
    assert got == [("h1", "a", "d/a(1)", 2), ("h2", "b", "d/b", 4), ("h3", "p", "d/p", 6), ("h4", None, "d/m", 8)]
    assert sorted(map(tuple, claims.commit_claims(owners, new.limit(0)).collect())) == sorted(map(tuple, owners.collect()))
