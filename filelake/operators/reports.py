"""Outcome reports, histories and status logs."""

from __future__ import annotations

import os
import shutil
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.functions.fixed import REPORT_FOLDERS, STATUSES
from filelake.operators.ranking import first_rows
from filelake.operators.verify import status_counts, verdict
from filelake.sources.jsonreport import write_document

CAP = 100_000


def outcome_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id", "outcome").agg(F.count("*").alias("n"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def capped(events: DataFrame, cap: int, by: list[str], order: list[str]) -> DataFrame:
    """The oldest ``cap`` rows of each report with its true total, and whether it is truncated."""
    totals = events.groupBy(*by).agg(F.count("*").alias("total"))
    kept = first_rows(events, by, [F.col(c) for c in order], cap, "rank").withColumn("rank", F.col("rank").cast("int"))
    return kept.join(totals, by).withColumn("truncated", F.col("total") > cap)


def savings(claimed: DataFrame, by: list[str]) -> DataFrame:
    """Duplicates of each group and the bytes that not copying them saves. ``claimed``: rows of ``claims.claim``."""
    return claimed.where("disposition = 'DUPLICATE'").groupBy(*by).agg(F.count("*").alias("duplicates"), F.sum("size").alias("bytes_saved"))


def recent(rows: DataFrame, order: list[str], n: int = 8) -> DataFrame:
    """The last ``n`` rows, newest first: the number is the feature."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def preview(rows: DataFrame, column: str, n: int = 20) -> str:
    """The first ``n`` values in order, a line each, and how many more there are."""
    total, shown = rows.count(), [r[0] for r in rows.select(column).orderBy(column).limit(n).collect()]  # ``n`` rows
    return "".join(f"{x}\n" for x in shown) + (f"... and {total - len(shown)} more" if total > len(shown) else "")


# The names of a report entry and their columns.
ENTRY = {
    "filePath": "file_path", "fileName": "file_name", "fileSize": "file_size", "reason": "reason", "sha256Hash": "sha256", "matchedPath": "matched_path",
    "destinationPath": "destination_path", "recordedAt": "recorded_at",
}


def write_outcome_report(events: DataFrame, outcome: str, job: str, path: str, cap: int = CAP, source: str | None = None, target: str | None = None) -> int:
    """Write one JSON report to ``path``; returns the true total. Nothing is written for an outcome without rows.

    The cap is the feature: a report lists its oldest rows and says how many it leaves out."""
    own = events.where((F.col("job_id") == job) & (F.col("outcome") == outcome))
    total, size = own.agg(F.count("*"), F.coalesce(F.sum("file_size"), F.lit(0))).first()
    if not total:
        return 0
    stamp = datetime.now(timezone.utc).isoformat(timespec="microseconds").replace("+00:00", "Z")
    head = {"jobId": job, "outcome": outcome, "generatedAt": stamp, "sourcePath": source, "targetPath": target, "totalCount": total, "totalBytesSaved" if outcome == "DUPLICATE" else "totalBytes": size, "truncated": total > cap}
    if total > cap:
        head |= {"entriesOmitted": total - cap, "truncationNotice": f"Report lists the first {cap} of {total} entries; the event table holds them all."}
    names = {k: c for k, c in ENTRY.items() if c in own.columns and (outcome == "DUPLICATE" or k not in ("sha256Hash", "matchedPath"))}
    oldest = own if total <= cap else first_rows(own, ["job_id"], [F.col("event_seq")], cap, "_n")
    write_document(path, head, {"entries": oldest.orderBy("event_seq").select(*[F.col(c).alias(k) for k, c in names.items()])})
    return total


def status_latest(log: DataFrame, by: str, status: str, order: list[str]) -> DataFrame:
    """Status is an append-only log: the latest row wins."""
    return log.groupBy(by).agg(F.max_by(status, F.struct(*order)).alias("status"))


def write_all_outcomes(events: DataFrame, job: str, folder: str, cap: int = CAP, source: str | None = None, target: str | None = None) -> dict[str, str]:
    """The three outcome reports of a job, each by job and again under its latest name; outcomes without rows write none."""
    written = {}
    for outcome, sub in zip(("SKIPPED", "FAILED", "DUPLICATE"), REPORT_FOLDERS, strict=True):
        path = os.path.join(folder, sub, f"{outcome.lower()}-{job}.json")
        if write_outcome_report(events, outcome, job, path, cap, source, target):
            latest = os.path.join(folder, sub, f"{outcome.lower()}.json")
            shutil.copyfile(path, f"{latest}.tmp")
            os.replace(f"{latest}.tmp", latest)
            written[outcome] = path
    return written


def write_integrity_report(findings: DataFrame, run: dict, path: str, deep: bool, completed: bool = True) -> dict:
    """Always written: what was measured, how far it can be trusted, all seven counts, and each finding that isn't intact.

    ``findings``: rows of ``verify.reconcile`` (materialised: they are read several times). Returns the head."""
    counts = {r.status: r.n for r in status_counts(findings).collect()}  # seven rows
    verified, problems, clean = verdict(findings, completed).select("verified", "problems", "clean").first()
    if not completed:
        caveat = "Cancelled before its end: files that were not reached have not been checked."
    elif deep:
        caveat = "Deep: every recorded file was read and its SHA-256 compared."
    else:
        caveat = "Quick: only existence and size were checked, so a change that keeps the length looks intact. A deep run compares contents."
    hashed = F.col("observed_sha256").isNotNull() if deep and "observed_sha256" in findings.columns else F.lit(False)
    read = findings.agg(F.coalesce(F.sum(F.when(hashed & F.col("destination_size").isNotNull(), F.col("size"))), F.lit(0))).first()[0]
    head = run | {"mode": "DEEP" if deep else "QUICK", "completed": completed, "clean": clean, "bytesRead": read, "caveat": caveat, "counts": {s: counts[s] for s in STATUSES}, "filesVerified": verified, "problems": problems}
    names = {"path": "path", "status": "status", "destination_size": "expectedSize", "size": "observedSize", "sha256": "expectedSha256", "observed_sha256": "observedSha256"}
    bad = findings.where("status <> 'INTACT'")
    write_document(path, head, {"findings": bad.select(*[F.col(a).alias(b) for a, b in names.items() if a in bad.columns]).orderBy("path")})
    return head


def write_cleanup_report(results: DataFrame, removed: list[str], run: dict, path: str, not_removed: list[str] | None = None) -> dict | None:
    """Deleted, skipped and failed files and the folders removed; None, and no file, when nothing happened.

    ``results``: rows of ``actions.delete`` (materialised), with any further columns of the preview."""
    by = {r.status: (r.n, r.bytes) for r in results.groupBy("status").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    if not by and not removed:
        return None
    n = lambda s: by.get(s, (0, 0))
    head = run | {"permanentDeletion": True, "filesDeleted": n("DELETED")[0], "bytesDeleted": n("DELETED")[1], "filesSkipped": n("SKIPPED_REVERIFY")[0], "filesFailed": n("FAILED")[0]}
    head |= {"directoriesRemoved": len(removed), "directoriesRemovedPaths": removed} | ({"directoriesFailed": not_removed} if not_removed else {})
    write_document(path, head, {name: results.where(F.col("status") == s).orderBy("path") for name, s in (("deleted", "DELETED"), ("skipped", "SKIPPED_REVERIFY"), ("failed", "FAILED"))})
    return head
