"""Scans that are repeated, stopped, paused and watched."""

import json
import os
import threading
import time
from collections import Counter

import pytest

from filelake.operators import checkpoint
from filelake.operators.control import Control, Gate
from filelake.operators.live import Live, Stopped, Tally, totals
from filelake.operators.stores import OWNERS, CacheTable, OwnerTable
from filelake.plans.scan import listing, run_scan
from tests.test_files import files_of, jpeg, put


@pytest.mark.parametrize(("how", "move"), [("damaged", False), ("damaged", True), ("gone", False), ("pattern", False)])
def test_reruns_make_one_new_copy(spark, tmp_path, how, move):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    want = {k: jpeg(k) for k in range(2)}
    keep = {}
    for k, data in want.items():
        put(src, f"{k}.jpg", data)
    owners, cache = OwnerTable(spark, f"{tmp_path}/owners", buckets=2), CacheTable(spark, f"{tmp_path}/cache", buckets=2)
    options = {"move": move, "cache": cache, "deep": False}
    first = run_scan(spark, src, dst, owners, **options)
    assert first.completed and first.outcomes.where("outcome = 'TRANSFERRED'").count() == 2
    if move:  # the files come back, as from a card that was not wiped
        for k, data in want.items():
            put(src, f"{k}.jpg", data)
    hurt = next(r.destination_path for r in owners.read().collect() if r.canonical.endswith("0.jpg"))
    if how == "damaged":
        with open(hurt, "wb") as f:
            f.write(b"bad")
        keep = {os.path.relpath(hurt, dst): b"bad"}
    else:
        os.remove(hurt)
    for run in range(3 if how == "damaged" else 2):
        if how == "pattern":
            options["pattern"] = "YYYY_MM_DD"
        out = run_scan(spark, src, dst, owners, **options)
        assert out.outcomes.where("outcome = 'TRANSFERRED'").count() == (run == 0), run
        there = files_of(dst)
        assert len(there) == 2 + len(keep) and Counter(v for n, v in there.items() if n not in keep) == Counter(want.values())
        placed = {r.destination_path: r.destination_size for r in owners.read().collect()}
        assert all(os.path.getsize(p) == n for p, n in placed.items()) and len(placed) == 2
        if move and run == 0:
            put(src, "0.jpg", want[0])
    assert owners.versions()[-1] == 2  # nothing new, nothing written


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("many"))
    for k in range(3000):
        put(root, f"d{k % 30}/{k}.jpg", jpeg(k % 251, 11_000 + k))
    return root


def stopping(control: Control, when) -> tuple[threading.Thread, list]:
    asked = []

    def watch() -> None:
        while not when():
            time.sleep(0.01)
        control.stop()
        asked.append(time.monotonic())

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    return thread, asked


@pytest.mark.parametrize("phase", ["planning", "transfer"])
def test_stop_is_seen_in_seconds(spark, tmp_path, many, phase):
    dst, control, snapshot = str(tmp_path / "dst"), Control(f"{tmp_path}/state"), f"{tmp_path}/s.json"
    begun = lambda: any(files for _, _, files in os.walk(dst))
    reading = lambda: os.path.isdir(f"{snapshot}.live") and any(f.startswith("read-") for _, _, fs in os.walk(f"{snapshot}.live") for f in fs)
    thread, asked = stopping(control, begun if phase == "transfer" else reading)
    part = run_scan(spark, many, dst, spark.createDataFrame([], OWNERS), control=control, snapshot=snapshot)
    took = time.monotonic() - asked[0]
    thread.join()
    print(f"{phase}: ended {took:.1f} s after the stop")
    assert took < 6 and not part.completed  # 3 s on a free machine
    there, kinds = files_of(dst), Counter(r.outcome for r in part.outcomes.select("outcome").collect())
    assert kinds.total() == 3000 and kinds["TRANSFERRED"] == len(there) < 3000 and not [n for n in there if "part-" in n]
    assert part.owners.count() == len(there)
    state = json.load(open(snapshot, encoding="utf-8"))
    assert state["status"] == "STOPPED" and state["processedFiles"] == len(there)
    if phase == "planning":
        assert not there and kinds["NOT_REACHED"] == 3000
    else:
        assert part.cache.count() == 3000 and kinds["PLANNED"] == 3000 - len(there) > 0
    control.resume()
    done = run_scan(spark, many, dst, part.owners, control=control, cache=part.cache)
    assert done.completed and len(files_of(dst)) == 3000 and done.outcomes.where("outcome = 'PRESENT'").count() == len(there)


def test_a_pause_holds_and_snapshots_grow(spark, tmp_path, many):
    dst, control, snapshot = str(tmp_path / "dst"), Control(f"{tmp_path}/state"), f"{tmp_path}/s.json"
    over, seen, still = threading.Event(), [], []
    count = lambda: sum(len(files) for _, _, files in os.walk(dst))

    def toggle() -> None:
        while not over.is_set():
            if 0 < count() < 3000:
                control.pause()
                time.sleep(0.5)
                still.append(count())
                time.sleep(0.5)
                still[-1] = (still[-1], count())
                control.resume()
            time.sleep(0.15)

    def look() -> None:
        while not over.is_set():
            if os.path.exists(snapshot) and (state := json.load(open(snapshot, encoding="utf-8"))) not in seen[-1:]:
                seen.append(state)
            time.sleep(0.02)

    threads = [threading.Thread(target=f, daemon=True) for f in (toggle, look)]
    for t in threads:
        t.start()
    done = run_scan(spark, many, dst, spark.createDataFrame([], OWNERS), control=control, snapshot=snapshot, trigger=checkpoint.Trigger(100, 60))
    over.set()
    for t in threads:
        t.join()
    assert done.completed and still and all(a == b for a, b in still)
    running = [s["processedFiles"] for s in seen if s["status"] in ("RUNNING", "PAUSED") and s["processedFiles"]]
    print("snapshots", running, "pauses", len(still))
    assert len(set(running)) >= 3 and running == sorted(running) and max(running) <= 3000
    last = checkpoint.import_state(snapshot)
    assert last["status"] == "COMPLETED" and last["processedFiles"] == 3000 and not os.path.exists(f"{snapshot}.live")


def test_tallies_count_a_repeated_task_once(tmp_path):
    for _ in range(2):
        t = Tally(str(tmp_path), "read-3.json", every=0)
        t.add("A", 5), t.add("A", 6), t.add("B")
    Tally(str(tmp_path), "read-4.json", every=0).add("A", 1)
    Tally(str(tmp_path), "reading-4.json", every=0).add("A", 1)
    assert totals(str(tmp_path), "read") == ({"A": 3, "B": 1}, {"A": 12, "B": 0}) and totals(f"{tmp_path}/none", "x") == ({}, {})


def test_gate_and_cancelled_jobs(spark, tmp_path):
    control = Control(f"{tmp_path}/state")
    assert Gate(None).go_on() and control.gate().go_on()
    with Live(spark, control, None, "J", "a", "b") as live:
        live.check()
        threading.Timer(1.0, control.stop).start()
        began = time.monotonic()
        with pytest.raises(Stopped), live.cancellable():
            spark.range(0, 1 << 40, 1, 64).selectExpr("sum(hash(id) % 7)").collect()
        assert time.monotonic() - began < 10 and not control.gate().go_on()
        with pytest.raises(Stopped), live.cancellable():
            raise AssertionError("never begun")
    assert listing(spark, str(tmp_path), control=control.path).count() == 0  # a stopped listing lists nothing
    control.resume()
    assert listing(spark, str(tmp_path), control=control.path).count() == 1
    with Live(spark, control, None, "J", "a", "b") as live, pytest.raises(ValueError), live.cancellable():
        raise ValueError  # an error of the work itself stays what it is
