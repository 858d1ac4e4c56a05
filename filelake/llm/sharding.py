"""Sharding by size-tiered compaction with versioned manifests.

Arrivals are appended as small immutable Parquet shards; a manifest version lists the live
shards and the schema. ``compact`` groups live shards into size tiers (each tier ``FANOUT`` times
the last); a tier with at least ``FANOUT`` shards is merged into files of at most the target
size: each merge is a job of one task that reads its shards and writes one file, and
many merges run side by side. A new manifest is written beside the old and renamed to its
version number, which fails if that version exists: a reader sees the old list or the new one,
and a lost or repeated task leaves only files that no manifest names. ``vacuum`` deletes those
that no retained version names and that are old enough to be no append in flight. All storage
goes through Hadoop's file API.

Null columns, repeated rows, texts of any length and columns of any name are stored as they are.
An empty arrival sets the schema and adds no shard; a store without rows reads as an empty table
(without columns, if nothing ever arrived). All arrivals of one store have one schema.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelake.session import scratch, unused

TARGET = 64 << 20
FANOUT = 4
ROUND = 256  # merges of one commit, which bounds the size of a plan
FLOOR = 256 << 10  # shards up to this size are tier 0
SIDE_BY_SIDE = 32  # merges that the driver submits at once
KEEP = 10  # versions that vacuum retains
AGE = 7 * 24 * 3600.0  # seconds after which a file that no version names is no append in flight


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target, fanout
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def _list(self, folder: str) -> list:
        where = self._path(f"{self.path}/{folder}")
        return list(self._fs.listStatus(where)) if self._fs.exists(where) else []

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._list("manifests")]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The live shards of a version (the latest one by default)."""
        versions = self.versions()
        if version is None and not versions:
            return {"version": 0, "schema": None, "shards": []}
        v = versions[-1] if version is None else version
        if v not in versions:
            raise ValueError(f"version {v} is not kept")
        stream = self._fs.open(self._path(f"{self.path}/manifests/v{v:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: dict, shards: list[dict], schema: str | None = None) -> dict:
        """Atomic: the rename of the temporary manifest to its version number, which never replaces one, is the commit."""
        out = {"version": base["version"] + 1, "schema": base["schema"] or schema, "shards": shards}
        draft = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}.draft")
        final = self._path(f"{self.path}/manifests/v{out['version']:08d}.json")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(out).encode("utf-8")))
        stream.close()
        try:
            self._rename(draft, final)
        except Exception as e:
            self._fs.delete(draft, False)
            raise RuntimeError(f"manifest version {out['version']} was committed by another writer") from e
        return out

    def _rename(self, draft, final) -> None:  # noqa: ANN001
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE  # an existing version is an error
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, options)

    def _written(self, run: str) -> list[dict]:
        files = [(s.getPath().getName(), s.getLen()) for s in self._list(run) if s.getPath().getName().startswith("part-")]
        return [{"file": f"{run}/{n}", "bytes": b} for n, b in sorted(files)]

    def _run(self, version: int) -> str:
        return f"shards/{version:08d}-{uuid.uuid4().hex}"

    def append(self, rows: DataFrame) -> dict:
        """One arrival: each task's rows become one small shard."""
        base = self.manifest()
        run = self._run(base["version"] + 1)
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{run}")
        if self.spark.read.schema(rows.schema).parquet(f"{self.path}/{run}").isEmpty():
            self._fs.delete(self._path(f"{self.path}/{run}"), True)
            return base if base["schema"] else self._commit(base, [], rows.schema.json())
        return self._commit(base, base["shards"] + self._written(run), rows.schema.json())

    def append_backlog(self, rows: DataFrame, arrival: Column) -> dict:
        """Several arrivals in one pass over ``rows``, told apart by ``arrival`` (never null): one version for each, in order."""
        name, *_ = unused(rows.columns, "arrival")
        run = f".backlog-{uuid.uuid4().hex}"
        rows.withColumn(name, arrival).write.option("compression", "zstd").partitionBy(name).parquet(f"{self.path}/{run}")
        now = self.manifest()
        folders = sorted((s.getPath() for s in self._list(run) if s.isDirectory()), key=lambda p: p.getName())
        self._fs.mkdirs(self._path(f"{self.path}/shards"))
        for folder in folders:
            to = self._run(now["version"] + 1)
            if not self._fs.rename(folder, self._path(f"{self.path}/{to}")):
                raise OSError(f"cannot move {folder}")
            now = self._commit(now, now["shards"] + self._written(to), rows.schema.json())
        self._fs.delete(self._path(f"{self.path}/{run}"), True)
        return now if folders or now["schema"] else self._commit(now, [], rows.schema.json())

    def tier(self, size: int) -> int:
        t = 0
        while size > FLOOR * self.fanout**t:
            t += 1
        return t

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Merges due now: lists of shards of one tier, each up to one file of the target size."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target // 2:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        out = []
        for _, members in sorted(tiers.items()):
            if len(members) < self.fanout:
                continue
            group, size = [], 0
            for s in members:
                if group and size + s["bytes"] > self.target:
                    out.append(group)
                    group, size = [], 0
                group.append(s)
                size += s["bytes"]
            out.append(group)
        return [g for g in out if len(g) > 1]

    def _merge(self, group: list[dict], schema: T.StructType, run: str) -> list[dict]:
        """One task reads the shards of a merge and writes one file."""
        self._read([s["file"] for s in group], schema).coalesce(1).write.option("compression", "zstd").parquet(f"{self.path}/{run}")
        return self._written(run)

    def compact(self) -> dict:
        """Merge until no tier has ``fanout`` shards left. Each round of merges is one version."""
        now = self.manifest()
        while merges := self.plan(now["shards"])[:ROUND]:
            schema = T.StructType.fromJson(json.loads(now["schema"]))
            runs = [self._run(now["version"] + 1) for _ in merges]
            with ThreadPoolExecutor(min(len(merges), SIDE_BY_SIDE)) as pool:
                made = [s for found in pool.map(lambda m: self._merge(m[0], schema, m[1]), zip(merges, runs, strict=True)) for s in found]
            gone = {s["file"] for g in merges for s in g}
            now = self._commit(now, [s for s in now["shards"] if s["file"] not in gone] + made)
        return now

    def _read(self, files: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in files])

    def read(self, version: int | None = None) -> DataFrame:
        now = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(now["schema"])) if now["schema"] else T.StructType([])
        return self._read([s["file"] for s in now["shards"]], schema) if now["shards"] else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = KEEP, age: float = AGE) -> int:
        """Forget all but the latest ``keep`` versions and delete files that none of those names, unless they are younger than ``age`` seconds
        (an append in flight is not yet named). Returns how many files went."""
        versions = self.versions()
        for v in versions[: max(0, len(versions) - keep)]:
            self._fs.delete(self._path(f"{self.path}/manifests/v{v:08d}.json"), False)
        live = {s["file"] for v in versions[-keep:] for s in self.manifest(v)["shards"]}
        limit, gone = (time.time() - age) * 1000, 0
        for folder in self._list("shards"):
            run, left = f"shards/{folder.getPath().getName()}", 0
            for s in self._list(run):
                name = s.getPath().getName()
                if f"{run}/{name}" in live or s.getModificationTime() > limit:
                    left += 1
                elif name.startswith("part-"):
                    self._fs.delete(s.getPath(), False)
                    gone += 1
            if not left:
                self._fs.delete(folder.getPath(), True)
        for s in self._list("manifests"):
            if s.getPath().getName().endswith(".draft") and s.getModificationTime() <= limit:
                self._fs.delete(s.getPath(), False)
        return gone


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive in four parts, are compacted, and come back from the compacted store."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, scratch(spark))
    store.append_backlog(docs, F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    store.compact()
    store.vacuum(keep=1, age=0)  # nobody else writes to this store
    text = F.coalesce(F.col("text"), F.lit(""))
    return store.read().select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


OP7_SQL = "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents"
