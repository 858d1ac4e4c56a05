"""Side effects on files, one result row each: copy, move, delete, prune. Idempotent, so a repeated task does no harm.

A target is only ever created, never replaced: a file that is already there stays, and the
source with it.
"""

from __future__ import annotations

import filecmp
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.functions.fixed import MIME_GROUPS
from filelake.operators.cleanup import dangerous_root
from filelake.operators.control import Gate
from filelake.operators.live import Tally
from filelake.session import file_tasks, materialize, ship

RESULT = "path string, destination string, status string, bytes long, error string"
NAMES = ["path", "destination", "status", "bytes", "error"]


def describe(e: BaseException) -> str:
    """``Type: message``; the type alone where there is no message."""
    text = str(e)
    return f"{type(e).__name__}: {text}" if text else type(e).__name__


def _claim(draft: str, target: str) -> None:
    """Give ``draft`` the name ``target`` unless a file holds it (FileExistsError)."""
    try:
        os.link(draft, target)
        os.unlink(draft)
    except FileExistsError:
        raise
    except OSError:  # no hard links here: hold the name with an empty file, marked as such, before it is replaced
        with open(mark := f"{target}.claim", "a", encoding="utf-8"):
            pass
        try:
            os.close(os.open(target, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            os.replace(draft, target)
        finally:
            os.remove(mark)


def _left_behind(target: str) -> bool:
    """An empty file whose mark says that an attempt ended between holding the name and filling it."""
    return os.path.exists(f"{target}.claim") and os.path.getsize(target) == 0


def transfer_one(source: str, target: str, move: bool, size: int | None = None) -> tuple:
    """Copy through a temporary name, check the size, then take the target's name if it is free.

    A target that holds the same bytes is a finished copy of an earlier attempt; one with other
    bytes is another file's, and the transfer fails with both left as they are. A source that is gone
    counts as moved only if the target has its recorded ``size`` (any, where none is known).
    """
    try:
        if move and not os.path.exists(source) and os.path.exists(target):
            there = os.path.getsize(target)
            if size is not None and there != size:
                return (source, target, "FAILED", 0, f"FileNotFoundError: {source} is gone, and {target} holds {there} bytes, not {size}")
            return (source, target, "TRANSFERRED", there, None)
        size = os.path.getsize(source)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        if os.path.exists(target) and size and _left_behind(target):
            os.remove(target)
        if not os.path.exists(target):
            if move:
                try:
                    os.link(source, target)
                    os.unlink(source)
                    return (source, target, "TRANSFERRED", size, None)
                except OSError:
                    pass  # another volume, or the name was taken: copy and delete
            draft = f"{target}.part-{uuid.uuid4().hex}"
            try:
                shutil.copy2(source, draft)
                if os.path.getsize(draft) != size:
                    raise OSError("size differs after copy")
                _claim(draft, target)
            finally:
                if os.path.exists(draft):
                    os.remove(draft)
        elif not filecmp.cmp(source, target, shallow=False):
            raise FileExistsError(f"{target} holds another file")
        if move:
            os.remove(source)
        return (source, target, "TRANSFERRED", size, None)
    except OSError as e:
        return (source, target, "FAILED", 0, describe(e))


def require_distinct(plan: DataFrame) -> None:
    """Two rows with one destination are an error, before any file is touched."""
    twice = plan.where("destination is not null").groupBy("destination").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"{twice['count']} files would go to {twice['destination']}")


def transfer(plan: DataFrame, move: bool = False, gate: Gate | None = None, counts: str | None = None, phase: str = "transfer") -> DataFrame:
    """RESULT rows for (path, destination); destinations are distinct (``require_distinct``).

    Before each file the task asks ``gate``; once that says no, the rest is NOT_REACHED. ``counts``: the folder
    in which tasks tally what they have done so far. A ``size`` column, if there is one, tells a moved file from a lost one.
    """
    gate = gate or Gate(None)
    sized = "size" in plan.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = Tally.of_task(counts, phase)
        for f in frames:
            rows = []
            for a, b, n in zip(f["path"], f["destination"], f["size"], strict=True):
                rows.append(transfer_one(a, b, move, None if n != n or n is None else int(n)) if gate.go_on() else (a, b, "NOT_REACHED", 0, None))
                tally.add(rows[-1][2], rows[-1][3])
            yield pd.DataFrame(rows, columns=NAMES)
        tally.write()

    ship(plan.sparkSession)
    rows = plan.select("path", "destination", (F.col("size") if sized else F.lit(None)).cast("double").alias("size"))
    return rows.repartition(file_tasks(plan.sparkSession), "path").mapInPandas(run, RESULT)


def group_of(path: str) -> tuple[str, int]:
    """(group of a file by its content, size)."""
    from filelake.sources.content import refine_zip, sniff

    with open(path, "rb") as f:
        mime = sniff(f.read(4096))
    if mime == "application/zip":
        mime = refine_zip(path)
    return next((g for g, _, _, prefixes, exact in MIME_GROUPS if mime in exact or any(mime.startswith(p) for p in prefixes)), "OTHER"), os.path.getsize(path)


def _deleter(select: Callable[[str, str], bool]) -> Callable[[str, str | None], tuple]:
    allowed = {g for g, _, ok, _, _ in MIME_GROUPS if ok}

    def one(path: str, expected: str | None) -> tuple:
        try:
            now, size = group_of(path)
            if expected is None:
                if not select(path, now):
                    return (path, None, "KEPT", 0, now)
                if now not in allowed:
                    return (path, None, "SKIPPED_REVERIFY", 0, f"now {now}")
            elif now != expected or now not in allowed:
                return (path, None, "SKIPPED_REVERIFY", 0, f"now {now}")
            os.remove(path)
            return (path, now, "DELETED", size, None)
        except FileNotFoundError:
            return (path, None, "SKIPPED_REVERIFY", 0, "no longer exists")
        except OSError as e:
            return (path, None, "FAILED", 0, describe(e))

    return one


def delete(plan: DataFrame) -> DataFrame:
    """Delete (path, group) after sniffing again: only a file still in the same deletable group goes. ``destination``: its group."""
    one = _deleter(lambda path, now: True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([one(a, b) for a, b in zip(f["path"], f["group"], strict=True)], columns=NAMES)

    ship(plan.sparkSession)
    return plan.select("path", "group").repartition(file_tasks(plan.sparkSession), "path").mapInPandas(run, RESULT)


def delete_while_scanning(files: DataFrame, root: str, groups: list[str], extensions: list[str], cancel: str | None = None, gate: Gate | None = None, counts: str | None = None) -> DataFrame:
    """One pass over the listed ``files`` below ``root``: each is classified and, if its group or extension is selected, deleted at once.

    RESULT rows; a file that was not selected is KEPT (``error``: its group). Once the file named ``cancel``
    exists, or ``gate`` says no, the rest is NOT_REACHED. ``counts``: the folder in which tasks tally outcomes and bytes while
    they run (``live.totals(counts, "delete")`` adds them up). Materialise the rows before reading them twice; ``running_totals`` sums them up.
    """
    if why := dangerous_root(root):
        raise ValueError(why)
    if bad := [g for g in groups if g not in {g for g, _, ok, _, _ in MIME_GROUPS if ok}]:
        raise ValueError(f"never deleted: {bad}")
    wanted = {e for x in extensions if (e := x.strip().lower().removeprefix("*").removeprefix(".").strip())}
    one, gate = _deleter(lambda path, now: now in groups or os.path.splitext(path)[1][1:].lower() in wanted), gate or Gate(None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = Tally.of_task(counts, "delete")
        for f in frames:
            rows = []
            for path in f["path"]:
                stopped = cancel is not None and os.path.exists(cancel) or not gate.go_on()
                rows.append((path, None, "NOT_REACHED", 0, None) if stopped else one(path, None))
                tally.add(rows[-1][2], rows[-1][3])
            yield pd.DataFrame(rows, columns=NAMES)
        tally.write()

    ship(files.sparkSession)
    return files.select("path").repartition(file_tasks(files.sparkSession), "path").mapInPandas(run, RESULT)


def running_totals(results: DataFrame) -> DataFrame:
    """examined, deleted, bytes_deleted, failed, completed of a deletion so far: one row."""
    is_ = lambda s: F.col("status") == s
    return results.agg(
        F.count_if(~is_("NOT_REACHED")).alias("examined"), F.count_if(is_("DELETED")).alias("deleted"),
        F.coalesce(F.sum(F.when(is_("DELETED"), F.col("bytes"))), F.lit(0)).alias("bytes_deleted"),
        F.count_if(is_("FAILED")).alias("failed"), (F.count_if(is_("NOT_REACHED")) == 0).alias("completed"),
    )


def prune(spark: SparkSession, root: str, dirs: DataFrame) -> DataFrame:
    """Remove empty directories (``path`` rows of ``empty_directories``), deepest first; the root stays. RESULT rows, PRUNED or FAILED.

    The set is whole before anything is removed. Then one level after the other goes, each over many tasks, so
    a folder that several chains share is met when all of them are gone: one job for each depth.
    """
    if why := dangerous_root(root):
        raise ValueError(why)
    home = os.path.normpath(root)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d in f["path"]:
                try:
                    os.rmdir(d)
                    rows.append((d, None, "PRUNED", 0, None))
                except FileNotFoundError:
                    rows.append((d, None, "PRUNED", 0, None))  # by an earlier attempt of this task
                except OSError as e:
                    rows.append((d, None, "FAILED", 0, describe(e)))
            yield pd.DataFrame(rows, columns=NAMES)

    ship(spark)
    parts = F.filter(F.split("path", "/+"), lambda x: ~x.isin("", "."))
    below = F.size(parts) > len([x for x in home.split("/") if x])
    whole = materialize(dirs.select("path").where(below).withColumn("_depth", F.size(parts)), "dirs")
    found = spark.createDataFrame([], RESULT)
    for depth in sorted((r[0] for r in whole.select("_depth").distinct().collect()), reverse=True):  # one number a level
        level = whole.where(F.col("_depth") == depth).select("path").repartition(file_tasks(spark), "path")
        found = found.unionByName(materialize(level.mapInPandas(run, RESULT), f"level{depth}"))
    return found


def deleted_per_group(results: DataFrame) -> DataFrame:
    """Deleted files of each group by display name, in name order."""
    shown = results.sparkSession.createDataFrame([(g, n) for g, n, _, _, _ in MIME_GROUPS], "group string, display_name string")
    gone = results.where("status = 'DELETED'").groupBy(F.col("destination").alias("group")).agg(F.count("*").alias("deleted"))
    return gone.join(F.broadcast(shown), "group").select("display_name", "deleted").orderBy("display_name")  # one row for each group

