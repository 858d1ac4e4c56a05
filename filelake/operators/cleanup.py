"""Cleanup: grouping, selection, re-verification, empty directories and dangerous roots."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.functions import columns as C
from filelake.functions.fixed import MIME_GROUPS, PROTECTED_FOLDERS


def group_totals(files: DataFrame) -> DataFrame:
    """Count and bytes of every group, in group order, zero filled."""
    dims = files.sparkSession.createDataFrame([(g, n, d, i) for i, (g, n, d, _, _) in enumerate(MIME_GROUPS)], "group string, display_name string, deletable boolean, rank int")
    counted = files.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    return dims.join(counted, "group", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0))})


def select_for_deletion(files: DataFrame, groups: list[str], extensions: list[str]) -> DataFrame:
    """(group or extension) and deletable. Asking for protected media is an error."""
    if "PROTECTED_MEDIA" in groups:
        raise ValueError("protected media is never deleted")
    wanted = [e.strip().lower().removeprefix("*").removeprefix(".").strip() for e in extensions]
    return files.where((F.col("group").isin(groups) | F.col("ext").isin([e for e in wanted if e])) & C.deletable(F.col("group")))


def deletable_totals(files: DataFrame) -> DataFrame:
    """One row: files and bytes in all, files that may be deleted, files of protected media."""
    may = C.deletable(F.col("group"))
    return files.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(may).alias("deletable"),
        F.count_if(F.col("group") == "PROTECTED_MEDIA").alias("protected"),
    )


def in_group(files: DataFrame, group: str) -> DataFrame:
    return files.where(F.col("group") == group)


def reverify(preview: DataFrame, now: DataFrame) -> DataFrame:
    """Adds outcome and reason: a file that is gone or changed its group since the preview is skipped."""
    current = now.select("path", F.col("group").alias("_now"))
    out = preview.join(current, "path", "left")
    gone, other = F.col("_now").isNull(), F.col("_now") != F.col("group")
    reason = F.when(gone, "no longer exists").when(other, F.concat(F.lit("now "), F.col("_now")))
    return out.withColumn("outcome", F.when(gone | other | ~C.deletable(F.col("group")), "SKIPPED_REVERIFY").otherwise("PREVIEWED")).withColumn("reason", reason).drop("_now")


def ancestors(paths: DataFrame, path: str = "path") -> DataFrame:
    """Distinct folders above each path."""
    parts = F.split(F.col(path), "/")
    return paths.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dir")).distinct()


def empty_directories(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """Directories with no file anywhere below, deepest first when ordered by depth."""
    used = ancestors(files).select(F.col("dir").alias("path"))
    return dirs.join(used, "path", "left_anti").withColumn("depth", F.size(F.split("path", "/")))


def dangerous_root(path: str | None) -> str | None:
    """Why a root must not be cleaned, or None."""
    if not path or not path.strip():
        return "no folder given"
    full = os.path.normpath(os.path.abspath(path))
    if full == "/":
        return "file system root"
    if full == os.path.expanduser("~"):
        return "home folder"
    for p in PROTECTED_FOLDERS:
        if full == p or full.startswith(p + "/"):
            return f"system folder {p}"
    return None


def check_job_paths(source: str | None, target: str | None) -> None:
    """Both given, different, neither inside the other."""
    if not source or not target:
        raise ValueError("source and target are needed")
    a, b = (os.path.normpath(os.path.abspath(x)) for x in (source, target))
    if a == b or a.startswith(b + "/") or b.startswith(a + "/"):
        raise ValueError("source and target must be apart")
