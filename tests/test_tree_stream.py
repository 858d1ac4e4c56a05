"""The tree as a stream: one order, bounded batches, restarts that lose and repeat nothing."""

import os
import random

import pytest
from pyspark.sql import functions as F

from filelake.operators.control import Control
from filelake.sources.filetree import FileTree, _StreamReader, walk_after
from filelake.streaming.incremental import append_events, arrivals, tree_arrivals


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree"))
    rnd = random.Random(3)
    for k in range(400):
        folder = "/".join(rnd.choice(["a", "a b", "a-", "b", ".c", "ü"]) for _ in range(rnd.randrange(4)))
        os.makedirs(f"{root}/{folder}", exist_ok=True)
        with open(f"{root}/{folder}/{k}.x", "w") as f:
            f.write("x" * (k % 5))
    os.symlink(f"{root}/a", f"{root}/z-link")
    with open(os.fsencode(root) + b"/bad\xff.x", "w"):
        pass
    return root


def every(root: str) -> list[str]:
    return sorted((os.path.relpath(os.path.join(d, n), root) for d, ds, fs in os.walk(root) for n in ds + fs), key=lambda p: p.split("/"))


def test_walk_goes_on_behind_any_path(tree):
    want = every(tree)
    assert list(walk_after(tree, "")) == want
    for k in [*range(0, len(want), 17), len(want) - 1]:
        assert list(walk_after(tree, want[k])) == want[k + 1 :]
    assert list(walk_after(tree, "a/nothing/here")) == [p for p in want if p.split("/") > ["a", "nothing", "here"]]
    assert list(walk_after(f"{tree}/none", "")) == []


def test_offsets_deal_out_every_entry_once(tree):
    reader, got, at = _StreamReader(tree, None, 7, 3), [], {"path": "", "entries": 0}
    while (end := reader.latestOffset()) != at:
        assert reader.latestOffset() == end  # asked twice, offered once
        parts = reader.partitions(at, end)
        assert len(parts) <= 3 and all(len(p.value) <= 7 for p in parts)
        again = _StreamReader(tree, None, 7, 3).partitions(at, end)  # a repeated batch of another process
        assert [p.value for p in again] == [p.value for p in parts]
        got += [x for p in parts for x in p.value]
        at = end
        if len(got) % 2:  # a restart: the new reader is told where the query stands
            reader = _StreamReader(tree, None, 7, 3)
            assert reader.partitions(at, at) == []
    assert got == every(tree) and at["entries"] == len(got)


def test_stream_restarts_and_waits(spark, tree, tmp_path):
    control, out, log = Control(f"{tmp_path}/state"), f"{tmp_path}/out", f"{tmp_path}/log"
    rows = tree_arrivals(spark, tree, 20, 3, control.path).where("kind = 'file'").select("path", "size", "relative")
    sizes = []
    for k in range(2):
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(processingTime="0 seconds").start()
        while k == 0 and len([p for p in q.recentProgress if p["numInputRows"]]) < 3 and q.isActive:
            q.awaitTermination(0.05)
        if k:
            q.processAllAvailable()
        sizes += [p["numInputRows"] for p in q.recentProgress]
        q.stop()
        control.pause()
        if k == 0:
            waiting = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(processingTime="0 seconds").start()
            waiting.processAllAvailable()  # at most the batch that the log had admitted before
            before = spark.read.parquet(out).count()
            waiting.processAllAvailable()
            assert spark.read.parquet(out).count() == before > 0 and sum(p["numInputRows"] > 0 for p in waiting.recentProgress) <= 1
            waiting.stop()
            control.resume()
    got = [r.relative for r in spark.read.parquet(out).collect()]
    files = [p for p in every(tree) if os.path.islink(f"{tree}/{p}") or not os.path.isdir(f"{tree}/{p}")]
    assert sorted(got) == sorted(n for n in files if "bad" not in n) and max(sizes) <= 60 and FileTree.name() == "filetree"


def test_event_files_hold_few_rows(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.range(1203).select(F.lit("J").alias("job_id"), "id").coalesce(1).write.parquet(src)
    q = append_events(arrivals(spark, src, "job_id string, id long"), out, f"{tmp_path}/cp", 0)
    q.processAllAvailable()
    q.stop()
    each = spark.read.parquet(out).groupBy(F.input_file_name()).count().collect()
    assert sorted(r["count"] for r in each) == [203, 500, 500]
