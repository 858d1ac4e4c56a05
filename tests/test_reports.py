"""Reports that tasks write in parts, and chains of empty folders that go in one call."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from filelake.operators import actions, cleanup, reports
from filelake.plans.scan import listing
from filelake.sources.jsonreport import LIST, write_document, write_list


def plain(head: dict, lists: dict) -> str:
    out = json.dumps(head, ensure_ascii=False, default=str)[:-1]
    for name, rows in lists.items():
        out += f', "{name}": [' + ",".join("\n" + json.dumps({k: v for k, v in r.asDict().items() if v is not None}, ensure_ascii=False, default=str) for r in rows) + "\n]"
    return out + "}\n"


def test_document_equals_one_written_row_by_row(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, F.concat(F.lit('a"\\é\n'), F.col("id").cast("string"))).alias("text"), F.timestamp_micros(F.col("id") * 1_000_001).alias("at"))
    lists = {"some": rows.orderBy(F.desc("n")), "none": rows.limit(0), "one": rows.where("n = 7")}
    path = f"{tmp_path}/sub/r.json"
    write_document(path, {"job": "J", "é": None}, lists)
    assert open(path, encoding="utf-8").read() == plain({"job": "J", "é": None}, {k: v.collect() for k, v in lists.items()})
    assert os.listdir(f"{tmp_path}/sub") == ["r.json"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="broken"):
        write_document(f"{tmp_path}/r.json", {}, {"rows": bad})
    assert os.listdir(tmp_path) == []
    write_list(spark.range(10).repartition(3), f"{tmp_path}/parts")
    names = json.load(open(f"{tmp_path}/parts/{LIST}"))
    assert len(names) == 3 == len(os.listdir(f"{tmp_path}/parts")) - 1


def test_capped_report_keeps_the_oldest(spark, tmp_path):
    seqs = list(range(400))
    random.Random(1).shuffle(seqs)
    ev = spark.createDataFrame([("J", "FAILED", s, f"f{s}", 1) for s in seqs], "job_id string, outcome string, event_seq long, file_path string, file_size long").repartition(7)
    assert reports.write_outcome_report(ev, "FAILED", "J", f"{tmp_path}/r.json", cap=150) == 400
    got = json.load(open(f"{tmp_path}/r.json", encoding="utf-8"))
    assert [e["filePath"] for e in got["entries"]] == [f"f{k}" for k in range(150)] and got["entriesOmitted"] == 250


def test_shared_chains_go_in_one_call(spark, tmp_path):
    root = str(tmp_path / "r")
    for d in ("s/a/b/c", "s/a/d", "s/e", "t/u/v/w", "k/x/y"):
        os.makedirs(f"{root}/{d}")
    with open(f"{root}/k/x/.keep", "w"):
        pass
    rows = listing(spark, root)
    dirs = cleanup.empty_directories(rows.where("kind = 'dir'").select("path"), rows.where("kind = 'file'").select("path"))
    stray = dirs.select("path").union(spark.createDataFrame([(f"{root}/gone",), (root,), (f"{root}/",)], "path string"))
    got = {os.path.relpath(r.path, root): r.status for r in actions.prune(spark, f"{root}/", stray).collect()}
    assert set(got.values()) == {"PRUNED"} and len(got) == 12 and sorted(os.listdir(root)) == ["k"] and os.listdir(f"{root}/k") == ["x"]
    late = spark.createDataFrame([(f"{root}/k",), (f"{root}/k/x",)], "path string")
    assert {r.status for r in actions.prune(spark, root, late).collect()} == {"FAILED"} and os.path.exists(f"{root}/k/x/.keep")
