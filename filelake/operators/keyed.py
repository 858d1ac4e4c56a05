"""A table with one row for each key, in hash buckets and versions: a merge writes only the buckets it touches.

Below the table's folder lie ``data/<merge>/_bucket=<n>`` (Parquet) and ``versions/<n>.json``, which names for every
bucket its folder and the schema version it was written in. A reader takes the newest version; a writer
publishes the next one under a name that only one of several writers can get, and the others work
their rows into what has been published meanwhile. A failed merge leaves files that no version names;
``vacuum`` removes them.

Rows written under an older schema are brought up to date when read, by the numbered ``steps`` (step k
takes rows of schema k to k + 1), and stay so once a merge touches their bucket. The manifest has one
entry a bucket whatever the table's size; the number of buckets is chosen when the table is made
(about one for each 128 MB) and may be changed by ``rebucket``.

All storage goes through Hadoop's file API. Publishing relies on a rename that fails when the name is
taken, as HDFS has it, and on hard links for local folders.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelake.session import materialize, shuffle_partitions

Rule = Callable[[DataFrame, DataFrame], DataFrame]
BUCKETS = 64
#: Writers that lose a race try again so often.
ATTEMPTS = 50


class KeyedTable:
    """``schema``: of the present version, the key among its columns. ``steps``: one function for each older version."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, steps: tuple[Callable[[DataFrame], DataFrame], ...] = (), buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.steps, self.new_buckets = spark, path.rstrip("/"), key, steps, buckets
        self.schema = T.StructType.fromDDL(schema)
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def versions(self) -> list[int]:
        home = self._path(f"{self.path}/versions")
        if not self._fs.exists(home):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(home)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """``version, buckets, parts`` (bucket -> [folder, schema version, schema]); an empty version 0 where there is none."""
        found = self.versions()
        if version is None:
            version = found[-1] if found else 0
        if version == 0:
            return {"version": 0, "buckets": self.new_buckets, "parts": {}}
        source = self._fs.open(self._path(f"{self.path}/versions/{version}.json"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode("utf-8"))
        finally:
            source.close()

    def _publish(self, state: dict) -> bool:
        """Whether this writer got the version's name."""
        name = f"{self.path}/versions/{state['version']}.json"
        draft = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a local rename would replace
                plain = lambda p: self._path(p).toUri().getPath()
                try:
                    os.link(plain(draft.toString()), plain(name))
                except FileExistsError:
                    return False
                return True
            return not self._fs.exists(self._path(name)) and bool(self._fs.rename(draft, self._path(name)))
        finally:
            self._fs.delete(draft, False)

    # reading

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        by: dict[tuple, list[str]] = {}
        for bucket, (folder, number, schema) in state["parts"].items():
            if buckets is None or int(bucket) in buckets:
                by.setdefault((number, schema), []).append(f"{self.path}/{folder}")
        out = self.spark.createDataFrame([], self.schema)
        for (number, schema), folders in sorted(by.items()):
            rows = self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*folders)
            for step in self.steps[number - 1 :]:
                rows = step(rows)
            out = out.unionByName(rows.select(*self.schema.names))
        return out

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    # writing

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def _write(self, rows: DataFrame, n: int, touched: int) -> dict[str, list]:
        """The folders of the buckets that have rows."""
        merge = f"data/{uuid.uuid4().hex}"
        tasks = shuffle_partitions(self.spark)
        spread = F.pmod(F.xxhash64(self.key, F.lit("spread")), F.lit(max(1, tasks // max(1, touched))))
        rows.select(*self.schema.names).withColumn("_bucket", self._bucket(n)).repartition(tasks, F.col("_bucket"), spread).write.partitionBy("_bucket").parquet(f"{self.path}/{merge}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{merge}"))]
        own = json.dumps(json.loads(T.StructType([T.StructField(f.name, f.dataType) for f in self.schema]).json()))
        return {x.removeprefix("_bucket="): [f"{merge}/{x}", len(self.steps) + 1, own] for x in names if x.startswith("_bucket=")}

    def merge(self, rows: DataFrame, rule: Rule) -> int:
        """The version that holds ``rule(old, rows)``: it sees the touched buckets only and returns all their rows.

        The rule must keep one row a key, and may be asked again with newer old rows if another writer came first.
        """
        rows = materialize(rows, "merge")
        for attempt in range(ATTEMPTS):
            now = self.manifest()
            if attempt == 0 or now["buckets"] != n:
                n, made = now["buckets"], None
                touched = [r[0] for r in rows.select(self._bucket(n)).distinct().collect()]  # one number a bucket at most
                if not touched:
                    return now["version"]
            seen = {b: now["parts"].get(str(b)) for b in touched}
            if made is None or seen != made[0]:
                made = (seen, self._write(rule(self._rows(now, touched), rows), n, len(touched)))
            rest = {b: p for b, p in now["parts"].items() if int(b) not in seen}
            if self._publish({"version": now["version"] + 1, "buckets": n, "parts": rest | made[1]}):
                return now["version"] + 1
            time.sleep(0.01 * attempt)
        raise RuntimeError(f"{ATTEMPTS} other writers came first")

    def delete(self, keys: DataFrame) -> int:
        """The version without the rows of ``keys``."""
        return self.merge(keys.select(self.key).distinct(), lambda old, gone: old.join(gone, self.key, "left_anti"))

    def clear(self) -> int:
        return self._replace(lambda now: {})

    def rebucket(self, n: int) -> int:
        """The same rows in ``n`` buckets, under the present schema."""
        return self._replace(lambda now: self._write(self._rows(now), n, n), n)

    def _replace(self, parts: Callable[[dict], dict], buckets: int | None = None) -> int:
        for _ in range(ATTEMPTS):
            now = self.manifest()
            if self._publish({"version": now["version"] + 1, "buckets": buckets or now["buckets"], "parts": parts(now)}):
                return now["version"] + 1
        raise RuntimeError(f"{ATTEMPTS} other writers came first")

    def vacuum(self, keep: int = 10, hours: float = 24.0) -> int:
        """Drop all but the newest ``keep`` versions, and merges older than ``hours`` that none of these names; how many merges went."""
        found = self.versions()
        kept = [self.manifest(v) for v in found[-keep:]]
        named = {p[0].split("/")[1] for m in kept for p in m["parts"].values()}
        for v in found[:-keep]:
            self._fs.delete(self._path(f"{self.path}/versions/{v}.json"), False)
        home, gone = self._path(f"{self.path}/data"), 0
        for s in self._fs.listStatus(home) if self._fs.exists(home) else []:
            if s.getPath().getName() not in named and s.getModificationTime() < (time.time() - hours * 3600) * 1000:
                gone += bool(self._fs.delete(s.getPath(), True))
        return gone
