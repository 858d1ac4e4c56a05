"""Summaries, progress snapshots, settings, metrics and reports of a job."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from filelake import settings
from filelake.operators import checkpoint, jobs, reports, summary
from filelake.operators.ranking import running
from filelake.operators.verify import reconcile
from filelake.sources.resources import ResourceSampler, executor_memory


def stats(spark, job='J,"1"<x>'):
    rows = [(job, dt.datetime(2024, 3, 1, 10, 0, 0), dt.datetime(2024, 3, 1, 11, 2, 3, 500000), 7, 1536, 2048.0)]
    return spark.createDataFrame(rows, "job_id string, start_time timestamp_ntz, end_time timestamp_ntz, files_processed long, bytes_processed long, peak_mb_per_sec double")


def test_summary_fields_and_forms(spark, tmp_path):
    got = summary.summary_fields(stats(spark)).first().asDict()
    assert list(got) == [label for label, _, _ in summary.FIELDS] and len(got) == 30
    assert got["Duration"] == "1:02:03" and got["Start time"] == "2024-03-01T10:00:00" and got["End time"] == "2024-03-01T11:02:03.5"
    assert got["Data processed"] == "1.5 KB" and got["Files failed"] == "0" and got["Status"] == "" and got["Peak GB/sec"] == "2.00"
    assert json.load(open(summary.export_summary(stats(spark), f"{tmp_path}/a/s.json", "json"), encoding="utf-8")) == got
    head, line = open(summary.export_summary(stats(spark), f"{tmp_path}/s.csv", "csv"), encoding="utf-8").read().splitlines()
    assert head.startswith("Job ID,Status") and line.startswith('"J,""1""<x>",,')
    samples = spark.createDataFrame([(0, 0.0, 1.0), (10, 5.0, 0.5)], "elapsed long, files_per_sec double, mb_per_sec double")
    html = open(summary.export_summary(stats(spark), f"{tmp_path}/s.html", "html", samples), encoding="utf-8").read()
    assert "J,&quot;1&quot;&lt;x&gt;" in html and html.count("<polyline") == 2 and "<x>" not in html
    assert "No throughput" in open(summary.export_summary(stats(spark), f"{tmp_path}/s.html", "html"), encoding="utf-8").read()
    for bad in (stats(spark).limit(0), stats(spark).union(stats(spark))):
        with pytest.raises(ValueError):
            summary.export_summary(bad, f"{tmp_path}/x.json", "json")
    with pytest.raises(ValueError):
        summary.export_summary(stats(spark), f"{tmp_path}/x", "xml")


def test_chart_of_idle_job_stays_on_the_base_line():
    assert summary.chart([(0, 0.0, 0.0), (0, 0.0, 0.0)]).count("40.0,240.0") == 4


def test_state_round_trip(spark, tmp_path):
    out = spark.createDataFrame([("TRANSFERRED", 5), ("PRESENT", 2), ("SKIPPED", 1), ("DUPLICATE", 9)], "outcome string, size long")
    state = checkpoint.progress(out, "J", "RUNNING", str(tmp_path), f"{tmp_path}/dst")
    assert (state["processedFiles"], state["skippedFiles"], state["failedFiles"], state["duplicateFiles"], state["processedBytes"]) == (2, 1, 0, 1, 7)
    path = f"{tmp_path}/c/state.json"
    checkpoint.export_state(state, path)
    assert checkpoint.import_state(path) == state and os.listdir(f"{tmp_path}/c") == ["state.json"]
    for bad in ({"sourcePath": f"{tmp_path}/none"}, {"sourcePath": None}, {"targetPath": f"{tmp_path}/no/where"}):
        checkpoint.export_state(state | bad, path)
        assert checkpoint.import_state(path) is None
    with pytest.raises(FileNotFoundError):
        checkpoint.import_state(f"{tmp_path}/none.json")
    assert checkpoint.progress(out.limit(0), "J", "RUNNING", "a", "b")["processedBytes"] == 0


def test_settings(tmp_path):
    path = f"{tmp_path}/x/app.properties"
    first = settings.load(path)
    assert first.threads == 2 * os.cpu_count() and (first.image_min_kb, first.video_min_kb, first.deep_validation, first.folder_pattern) == (10, 100, True, "YYYY_MMM")
    os.makedirs(f"{tmp_path}/x")
    with open(path, "w", encoding="utf-8") as f:
        f.write("# note\nworker.thread.count: 3\nfolder.pattern=ODD\nduplicate.policy = KEEP_BOTH\nvalidation.deep.enabled=FALSE\nignore.patterns.user=a*, ,\\\n  b?\nmine=c\\:d\\\\e\n")
    s = settings.load(path)
    assert (s.threads, s.folder_pattern, s.duplicate_policy, s.deep_validation, s.user_ignore, s.other) == (3, "YYYY_MMM", "KEEP_BOTH", False, ["a*", "b?"], {"mine": "c:d\\e"})
    assert s.ignore[-2:] == ["a*", "b?"] and "Thumbs.db" in s.ignore
    settings.save(s, path)
    assert settings.load(path) == s


def test_metrics(spark):
    m = ResourceSampler(spark)
    cpu, heap, read, written = m.sample(1 << 20, 0)
    assert 0 <= cpu <= 100 and heap > 0 and read > 0 and written == 0
    assert m.sample(0, 0)[2] == 0 and m.peaks[2] == read
    assert all(free >= 0 for _, free in executor_memory(spark).values())


def test_integrity_report(spark, tmp_path):
    owners = spark.createDataFrame([("A", "d/a", 1), ("B", "d/b", 2), ("C", "d/c", 3)], "sha256 string, destination_path string, destination_size long")
    there = spark.createDataFrame([("d/a", 1, "a", "a"), ("d/b", 2, "b", "x"), ("d/new", 4, "new", "n"), ("d/_skipped/r", 1, "_skipped/r", "r")], "path string, size long, relative string, observed_sha256 string")
    path = f"{tmp_path}/r/i.json"
    reports.write_integrity_report(reconcile(owners, there, True), {"runId": "V1"}, path, True)
    got = json.load(open(path, encoding="utf-8"))
    assert got["counts"] == {"INTACT": 1, "MISSING": 1, "RESIZED": 0, "CORRUPTED": 1, "UNREADABLE": 0, "UNTRACKED": 1, "UNVERIFIABLE": 0}
    assert (got["filesVerified"], got["problems"], got["clean"], got["bytesRead"], got["runId"]) == (3, 2, False, 3, "V1")
    assert [(x["path"], x["status"]) for x in got["findings"]] == [("d/b", "CORRUPTED"), ("d/c", "MISSING"), ("d/new", "UNTRACKED")] and "expectedSize" not in got["findings"][2]
    clean = reconcile(owners.limit(0), there.limit(0))
    assert reports.write_integrity_report(clean, {}, path, False)["clean"] and json.load(open(path, encoding="utf-8"))["findings"] == []
    assert not reports.write_integrity_report(clean, {}, path, False, completed=False)["clean"]


def test_cleanup_report(spark, tmp_path):
    kind = "path string, destination string, status string, bytes long, error string"
    rows = spark.createDataFrame([("b", None, "DELETED", 5, None), ("a", None, "DELETED", 6, None), ("c", None, "FAILED", 0, "x\n")], kind)
    path = f"{tmp_path}/c.json"
    assert reports.write_cleanup_report(rows.limit(0), [], {}, path) is None and not os.path.exists(path)
    reports.write_cleanup_report(rows, ["e/f"], {"runId": "C"}, path, ["g"])
    got = json.load(open(path, encoding="utf-8"))
    assert (got["filesDeleted"], got["bytesDeleted"], got["filesSkipped"], got["filesFailed"], got["directoriesRemoved"], got["directoriesFailed"]) == (2, 11, 0, 1, 1, ["g"])
    assert [x["path"] for x in got["deleted"]] == ["a", "b"] and got["failed"][0]["error"] == "x\n" and got["skipped"] == []


def test_outcome_fan_out(spark, tmp_path):
    ev = spark.range(3).select(F.lit("J").alias("job_id"), F.lit("DUPLICATE").alias("outcome"), F.col("id").alias("event_seq"), F.lit(2).alias("file_size"))
    got = reports.write_all_outcomes(ev, "J", str(tmp_path))
    assert list(got) == ["DUPLICATE"] and json.load(open(f"{tmp_path}/_duplicates/duplicate.json", encoding="utf-8")) == json.load(open(got["DUPLICATE"], encoding="utf-8"))
    assert json.load(open(got["DUPLICATE"], encoding="utf-8"))["totalBytesSaved"] == 6


def test_job_store(spark, tmp_path):
    store, at = jobs.JobStore(spark, f"{tmp_path}/store"), dt.datetime(2024, 3, 1, 10)
    assert store.jobs().count() == store.events().count() == store.samples().count() == 0
    store.insert("A/b c", at)
    store.insert("B", at + dt.timedelta(hours=1))
    store.update("B", files_processed=7, peak_mb_per_sec=2.5)
    store.status("B", "PAUSED")
    assert jobs.active_job(store.jobs()).first().job_id == "B" and [r.job_id for r in jobs.history(store.jobs()).collect()] == ["B", "A/b c"]
    store.status("B", "COMPLETED", at + dt.timedelta(hours=2))
    row = jobs.by_key(store.jobs(), "job_id", "B").first()
    assert (row.status, row.files_processed, row.files_failed, row.peak_mb_per_sec, row.start_time.hour, row.end_time.hour) == ("COMPLETED", 7, 0, 2.5, 11, 12)
    assert jobs.active_job(store.jobs()).first().job_id == "A/b c"
    samples = spark.createDataFrame([(j, None, k, float(k), 1.0, 0.0, 0.0) for j in ("A/b c", "B") for k in (2, 1)], jobs.SAMPLES)
    store.append_samples(samples)
    store.append_samples(samples.limit(0))
    store.append_events(spark.createDataFrame([("A/b c", "FAILED", 1, *[None] * 8)], jobs.EVENTS))
    assert [r.elapsed for r in jobs.of_job(store.samples(), "B").collect()] == [1, 2]
    assert {r.job_id: (r.samples, r.most_files_per_sec) for r in jobs.with_samples(store.jobs(), store.samples()).collect()} == {"A/b c": (2, 2.0), "B": (2, 2.0)}
    store.delete("A/b c")
    assert [r.job_id for r in store.jobs().collect()] == ["B"] and store.events().count() == 0 and store.samples().count() == 2
    with pytest.raises(ValueError):
        store.update("B", odd=1)


def test_running_sums_over_many_ranges(spark):
    rows = [(None if k % 3 == 0 else "g" if k % 3 == 1 else f"s{k}", k, k % 5) for k in range(400)]
    got = {r.k: r.total for r in running(spark.createDataFrame(rows, "g string, k long, v long").repartition(5), ["g"], [F.col("k")], F.col("v"), "total").collect()}
    assert got == {k: sum(v for h, j, v in rows if h == g and j <= k) for g, k, _ in rows}
    assert running(spark.createDataFrame([], "g string, k long"), ["g"], [F.col("k")], F.lit(1), "n").count() == 0
