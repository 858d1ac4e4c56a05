"""A run while it goes on: counters from its tasks, snapshots as they grow, and an end when it is stopped.

Tasks that work on files keep a ``Tally``: counts and bytes by outcome since the task began, written
as one small file for each task, whole or not at all. A task that is repeated begins anew under the
same name, so nothing counts twice. A thread of the driver adds the files up, writes a progress
snapshot whenever one is due (1 000 files or 60 s), and cancels the tagged jobs once the control
says STOPPED. Jobs that touch files are not cancelled: their tasks ask the ``Gate`` before each
file, finish with rows that say NOT_REACHED, and what they have done is kept.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from filelake.operators import checkpoint
from filelake.operators.control import Control, Gate


class Stopped(Exception):
    """The control said STOPPED."""


class Tally:
    """Counts of one task: (number, bytes) by outcome, written every ``every`` seconds at most and at the end."""

    def __init__(self, folder: str | None, name: str = "", every: float = 0.5) -> None:
        self.path, self.every, self.at = folder and f"{folder}/{name}", every, 0.0
        self.n: Counter = Counter()
        self.bytes: Counter = Counter()

    @classmethod
    def of_task(cls, folder: str | None, phase: str, every: float = 0.5) -> Tally:
        from pyspark import TaskContext

        task = TaskContext.get()
        return cls(folder, f"{phase}-{task.partitionId() if task else 0}.json", every)

    def add(self, outcome: str, size: int = 0) -> None:
        self.n[outcome] += 1
        self.bytes[outcome] += size
        if self.path and time.monotonic() - self.at >= self.every:
            self.write()

    def write(self) -> None:
        if not self.path:
            return
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        draft = f"{self.path}.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as f:
            json.dump({k: [n, self.bytes[k]] for k, n in self.n.items()}, f)
        os.replace(draft, self.path)
        self.at = time.monotonic()


def totals(folder: str, phase: str) -> tuple[Counter, Counter]:
    """(numbers, bytes) by outcome over all tasks of a phase."""
    n, size = Counter(), Counter()
    try:
        names = [x for x in os.listdir(folder) if x.startswith(f"{phase}-") and x.endswith(".json")]
    except FileNotFoundError:
        names = []
    for name in names:
        with open(f"{folder}/{name}", encoding="utf-8") as f:
            for k, (a, b) in json.load(f).items():
                n[k] += a
                size[k] += b
    return n, size


class Live:
    """Watches one run. ``snapshot``: where its progress goes; beside it, in ``<snapshot>.live``, lie the tasks' counts."""

    def __init__(self, spark: SparkSession, control: Control | None, snapshot: str | None, job: str, source: str, target: str, trigger: checkpoint.Trigger | None = None, every: float = 0.2) -> None:
        self.spark, self.control, self.snapshot, self.trigger, self.every = spark, control, snapshot, trigger or checkpoint.Trigger(), every
        self.head = (job, os.path.abspath(source), os.path.abspath(target))
        self.folder = f"{os.path.abspath(snapshot)}.live/{uuid.uuid4().hex}" if snapshot else None
        self.tag, self.phase, self.base, self.seen = f"filelake-{uuid.uuid4().hex}", "", Counter(), 0
        self._end, self._lock, self._thread = threading.Event(), threading.Lock(), threading.Thread(target=self._watch, daemon=True)

    def __enter__(self) -> Live:
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._end.set()
        self._thread.join()
        if self.folder:
            for name in os.listdir(self.folder) if os.path.isdir(self.folder) else []:
                os.remove(f"{self.folder}/{name}")
            for d in (self.folder, os.path.dirname(self.folder)):
                if os.path.isdir(d) and not os.listdir(d):
                    os.rmdir(d)

    @property
    def gate(self) -> Gate:
        return Gate(self.control.path if self.control else None)

    @property
    def stopped(self) -> bool:
        return self.control is not None and self.control.state == "STOPPED"

    def begin(self, phase: str, base: dict | None = None) -> None:
        """From now on the counts are ``base`` (column of the snapshot -> value) and what the tasks of ``phase`` add."""
        with self._lock:
            self.phase, self.base, self.seen = phase, Counter(base or {}), 0

    def counts(self) -> Counter:
        """Files and bytes so far, by the names of a snapshot."""
        with self._lock:
            out, phase = Counter(self.base), self.phase
        n, size = totals(self.folder, phase) if self.folder and phase else (Counter(), Counter())
        out.update({"processedFiles": n["TRANSFERRED"], "failedFiles": n["FAILED"], "processedBytes": size["TRANSFERRED"]})
        return out

    def write(self, status: str, counts: Counter) -> None:
        state = dict(zip(checkpoint.STATE, [self.head[0], status, *self.head[1:]], strict=False)) | {k: counts[k] for k in checkpoint.STATE[4:9]}
        checkpoint.export_state(state | {"checkpointTime": time.strftime("%Y-%m-%dT%H:%M:%S")}, self.snapshot)

    def _watch(self) -> None:
        while not self._end.wait(self.every):
            state = self.control.state if self.control else "RUNNING"
            if state == "STOPPED":
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
            if self.folder and self.phase:
                n = sum(totals(self.folder, self.phase)[0].values())
                fresh, self.seen = max(0, n - self.seen), n
                if self.trigger.due(fresh, time.monotonic()):
                    self.write(state, self.counts())

    def check(self) -> None:
        """Between two steps that touch no file: waits while PAUSED, raises Stopped once STOPPED."""
        if not self.gate.go_on():
            raise Stopped

    @contextmanager
    def cancellable(self) -> Iterator[None]:
        """Jobs begun inside end when the run is stopped, and Stopped is raised: for steps whose partial results are of no use."""
        self.check()
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            yield
        except Exception as e:
            if self.stopped:
                raise Stopped from e
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
