"""Progress snapshots of a job as JSON: written whole or not at all, and read back only while their folders are there."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The names of a progress snapshot.
STATE = ["jobId", "status", "sourcePath", "targetPath", "processedFiles", "skippedFiles", "failedFiles", "duplicateFiles", "processedBytes", "checkpointTime"]


# A snapshot is due after so many files or seconds.
FILES_TRIGGER, SECONDS_TRIGGER = 1000, 60


class Trigger:
    """Says when the next snapshot is due."""

    def __init__(self, files: int = FILES_TRIGGER, seconds: float = SECONDS_TRIGGER) -> None:
        self.files, self.seconds, self.n, self.at = files, seconds, 0, None

    def due(self, files: int, now: float) -> bool:
        """Counts ``files`` more at the time ``now`` (seconds); the count and the clock start again when due."""
        self.n += files
        self.at = now if self.at is None else self.at
        if self.n < self.files and now - self.at < self.seconds:
            return False
        self.n, self.at = 0, now
        return True


def progress(outcomes: DataFrame, job: str, status: str, source: str, target: str) -> dict:
    """The snapshot of a job from its (outcome, size) rows: one aggregate, one row to the driver."""
    kind = lambda *k: F.count_if(F.col("outcome").isin(*k))
    done = F.col("outcome").isin("TRANSFERRED", "PRESENT")
    row = outcomes.agg(kind("TRANSFERRED", "PRESENT"), kind("SKIPPED"), kind("FAILED"), kind("DUPLICATE"), F.coalesce(F.sum(F.when(done, F.col("size"))), F.lit(0)), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).first()
    return dict(zip(STATE, [job, status, source, target, *row], strict=True))


def export_state(state: dict, path: str) -> None:
    """Through a temporary name in the same folder, then renamed: a reader sees the old snapshot or the new one."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    draft = f"{path}.tmp"
    with open(draft, "w", encoding="utf-8") as f:
        json.dump({k: state.get(k) for k in STATE}, f, ensure_ascii=False, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(draft, path)


def import_state(path: str) -> dict | None:
    """The snapshot, or None when a path is missing from it, its source is no folder, or its target can't be made.

    A file that isn't there, or isn't JSON, is an error."""
    with open(path, encoding="utf-8") as f:
        state = json.load(f)
    source, target = state.get("sourcePath"), state.get("targetPath")
    if not source or not target or not os.path.isdir(source):
        return None
    if not os.path.isdir(target) and not os.path.exists(os.path.dirname(target.rstrip("/"))):
        return None
    return state
