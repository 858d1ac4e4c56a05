"""Scan and organise: listing, gates, content, claims, placement, transfer, catalogue snapshots."""

from __future__ import annotations

import os
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.functions import columns as C
from filelake.functions.fixed import IGNORE_PATTERNS, IMAGE_MIN_BYTES, REPORT_FOLDERS, VIDEO_MIN_BYTES
from filelake.operators import actions, checkpoint, claims, gates, placement, stores
from filelake.operators.cleanup import check_job_paths
from filelake.operators.control import Control
from filelake.operators.live import Live, Stopped
from filelake.operators.ranking import running
from filelake.session import materialize, ship
from filelake.settings import Settings
from filelake.sources.content import NOT_REACHED, with_content
from filelake.sources.filetree import FileTree

OWNERS, CACHE = stores.OWNERS, stores.CACHE
#: Files of one wave: after each its results are a table of their own. Pause, stop and snapshots do not wait for it.
WAVE = 1_000_000
FOUND = ["sha256", "partial_sha256", "mime"]


class Scan(NamedTuple):
    """``outcomes`` of the files, the next ``owners`` and ``cache`` snapshots, and whether the run reached its end."""

    outcomes: DataFrame
    owners: DataFrame
    cache: DataFrame
    completed: bool


class Plan(NamedTuple):
    """``rows``: one for each file; ``fresh``: new cache rows; ``work``: whether a file has a destination; ``complete``: not stopped before."""

    rows: DataFrame
    fresh: DataFrame
    work: bool
    complete: bool


def listing(spark: SparkSession, root: str, cancel: str | None = None, control: str | None = None) -> DataFrame:
    ship(spark)  # the reader of the data source runs in the executors
    spark.dataSource.register(FileTree)
    reader = spark.read.format("filetree")
    for name, value in (("cancel", cancel), ("control", control)):
        reader = reader.option(name, value) if value else reader
    return reader.load(root)


def media_total(files: DataFrame, ignore: list[str] = IGNORE_PATTERNS, already_moved: int = 0) -> int:
    """Files that a scan will look at (the total of progress and ETA); a run that moves adds those it has moved."""
    return gates.walk_disposition(files.where("kind = 'file'"), ignore).where("walk_skip is null").count() + already_moved


def contents(ready: DataFrame, cache: DataFrame, deep: bool, live: Live) -> DataFrame:
    """``ready`` with digests, type, problem, date, error and ``fresh`` (read now). A file whose size and mtime are cached is not opened."""
    known = cache.where("mime is not null").select("path", "size", "mtime", *FOUND, F.col("media_date").alias("embedded_date"))
    looked = claims.cache_lookup(ready, known)
    hits = looked.where("mime is not null").withColumns({"problem": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "fresh": F.lit(False)})
    misses = with_content(looked.where("mime is null").drop(*FOUND, "embedded_date"), deep, live.gate, live.folder)
    return hits.unionByName(misses.withColumn("fresh", F.lit(True)))


def _image_failure(problem: Column) -> Column:
    """Damage by its markers, anything else as an image that does not decode."""
    return F.concat(F.when(C.corrupted(problem), "Corrupt image data: ").otherwise("Image decode failed: "), problem)


def _nothing(*names: str) -> list[Column]:
    return [F.lit(None).cast("string").alias(n) for n in names]


def _plan(
    spark: SparkSession, source: str, target: str, owners: DataFrame, cache: DataFrame, live: Live, pattern: str = "YYYY_MMM", ignore: list[str] = IGNORE_PATTERNS,
    policy: str = "SKIP", deep: bool = True, image_min: int = IMAGE_MIN_BYTES, video_min: int = VIDEO_MIN_BYTES,
) -> Plan:
    check_job_paths(source, target)
    control = live.control.path if live.control else None
    there = materialize(listing(spark, target, control=control), "target")
    walked = gates.walk_disposition(listing(spark, source, control=control).where("kind = 'file'"), ignore)
    cheap = materialize(walked.withColumn("reason", F.coalesce("walk_skip", gates.size_gate(F.col("size"), F.col("file_type"), image_min, video_min))), "source")
    skipped = cheap.where("reason is not null").select("path", "size", F.lit("SKIPPED").alias("outcome"), "reason", *_nothing("sha256", "matched_path", "date_source", "destination"))
    rest = cheap.where("reason is null").select("path", "size", F.lit("NOT_REACHED").alias("outcome"), *_nothing("reason", "sha256", "matched_path", "date_source", "destination"))
    none = spark.createDataFrame([], CACHE)
    if live.stopped:  # a part of a listing decides nothing
        return Plan(skipped.unionByName(rest), none, False, False)
    live.begin("read", {"skippedFiles": cheap.where("reason is not null").count()} if live.snapshot else None)
    failed = F.when(~F.col("mime").rlike("^(image|video)/"), F.concat(F.lit("Unreadable media: detected type="), F.col("mime"))).when(F.col("mime").like("image/%"), _image_failure(F.col("problem"))).otherwise(F.col("problem"))
    content = contents(cheap.where("reason is null").drop("reason", "walk_skip"), cache, deep, live)
    content = materialize(content.withColumn("failure", F.coalesce("error", failed)), "checked")  # each file is read once
    fresh = content.where("fresh and failure is null").select("path", "size", "mtime", *FOUND, F.col("embedded_date").alias("media_date"))
    bad = content.where(F.col("failure").isNotNull() & (F.col("failure") != NOT_REACHED))
    bad = bad.select("path", "size", F.lit("FAILED").alias("outcome"), F.col("failure").alias("reason"), "sha256", *_nothing("matched_path", "date_source", "destination"))
    try:
        with live.cancellable():
            done, work = _decided(content.where("failure is null"), there, owners, target, pattern, policy)
    except Stopped:
        left = content.where((F.col("failure") == NOT_REACHED) | F.col("failure").isNull())
        left = left.select("path", "size", F.lit("NOT_REACHED").alias("outcome"), *_nothing("reason"), "sha256", *_nothing("matched_path", "date_source", "destination"))
        return Plan(left.unionByName(bad).unionByName(skipped), fresh, False, False)
    return Plan(done.unionByName(bad).unionByName(skipped), fresh, work, True)


def _decided(valid: DataFrame, there: DataFrame, owners: DataFrame, target: str, pattern: str, policy: str) -> tuple[DataFrame, bool]:
    """(rows of sound files with their claims and destinations, whether there is one)."""
    valid = claims.claim(valid, owners)
    date, how = C.capture_date(F.col("embedded_date"), F.col("created"), F.col("mtime"))
    valid = valid.withColumn("date", date).withColumn("date_source", how)
    own = claims.resume(valid.join(owners.select("sha256", "destination_path", "destination_size"), "sha256", "left"), there)
    state = F.when(F.col("date").isNull(), "SKIPPED").when(F.col("disposition") == "DUPLICATE", "DUPLICATE").when((F.col("disposition") == "OWN") & F.col("present"), "PRESENT").otherwise("PLANNED")
    base = target.rstrip("/")
    own = materialize(own.withColumn("outcome", state).withColumn("dir", F.concat_ws("/", F.lit(base), placement.folder(F.col("date"), pattern))), "own")
    rows = own.select("path", "size", "outcome", F.when(F.col("outcome") == "SKIPPED", "METADATA_MISSING").alias("reason"), "sha256", F.when(F.col("outcome") == "DUPLICATE", F.col("matched")).alias("matched_path"), "date_source")
    placing = ["PLANNED"] if policy == "SKIP" else ["PLANNED", "DUPLICATE"]
    if own.where(F.col("outcome").isin(placing)).isEmpty():  # a second run usually finds nothing new
        return rows.select("*", *_nothing("destination")), False
    held = there.where("kind = 'file'").select(F.col("parent").alias("dir"), C.file_name(F.col("path")).alias("name"))
    placed = materialize(placement.place(own.where("outcome = 'PLANNED'").select("path", "dir", "name"), held), "placed")
    if policy != "SKIP":
        held = held.union(placed.select("dir", F.col("final_name").alias("name")))
        twins = own.where("outcome = 'DUPLICATE'").select("path", "dir", "name")
        if policy == "MOVE_TO_BUCKET":
            more = placement.place(twins.withColumn("dir", F.lit(f"{base}/{REPORT_FOLDERS[2]}")), held)
        else:
            more = placement.place(twins, held, form="_DUP_{}", always=True)
        placed = placed.unionByName(more)
    placed = placed.select("path", F.concat_ws("/", "dir", "final_name").alias("destination"))
    return rows.join(placed, "path", "left"), True


def plan_scan(spark: SparkSession, source: str, target: str, owners: DataFrame, cache: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:  # noqa: ANN003
    """(plan, next cache snapshot). Writes nothing to either tree.

    The plan has one row for each file with its outcome so far: SKIPPED, FAILED, DUPLICATE (with a destination
    unless the policy is SKIP), PRESENT, or PLANNED with a destination. Both trees are listed once.
    """
    cache = spark.createDataFrame([], CACHE) if cache is None else cache
    plan = _plan(spark, source, target, owners, cache, Live(spark, None, None, "", source, target), **options)
    return plan.rows, claims.upsert_cache(cache, plan.fresh).select(*cache.columns)


def from_settings(s: Settings) -> dict:
    """The options of a scan that a settings file holds."""
    return {"pattern": s.folder_pattern, "ignore": s.ignore, "policy": s.duplicate_policy, "deep": s.deep_validation, "image_min": s.image_min_kb * 1024, "video_min": s.video_min_kb * 1024}


def run_scan(
    spark: SparkSession, source: str, target: str, owners: DataFrame | stores.OwnerTable, move: bool = False, control: Control | None = None, wave: int = WAVE,
    snapshot: str | None = None, job: str = "JOB", cache: DataFrame | stores.CacheTable | None = None, trigger: checkpoint.Trigger | None = None, **options,  # noqa: ANN003
) -> Scan:
    """Plan, then transfer. Claims are recorded only for transfers that succeeded, also those of owners that are placed anew.

    While ``control`` says PAUSED no task lists, reads or transfers a further file; once it says STOPPED the run ends
    within seconds: files not reached are NOT_REACHED (or PLANNED, with a destination), ``completed`` is false, and what was
    hashed or transferred is kept. ``snapshot``: progress JSON, written every 1 000 files or 60 s while tasks run, and at the end.
    ``owners`` and ``cache`` are snapshots, of which the result has the next ones, or keyed tables, into which the run merges.
    """
    known = owners.read() if isinstance(owners, stores.OwnerTable) else owners
    cached = spark.createDataFrame([], CACHE) if cache is None else cache.read() if isinstance(cache, stores.CacheTable) else cache
    with Live(spark, control, snapshot, job, source, target, trigger) as live:
        live.begin("list")
        plan = _plan(spark, source, target, known, cached, live, **options)
        if isinstance(cache, stores.CacheTable):
            cache.upsert(plan.fresh)
            next_cache = cache.read()
        else:
            next_cache = cached if plan.fresh.isEmpty() else materialize(claims.upsert_cache(cached, plan.fresh).select(*cached.columns), "cache")
        found, completed, rows = spark.createDataFrame([], actions.RESULT), plan.complete, plan.rows
        if plan.work:
            rows = materialize(rows, "plan")
            found, completed = _moved(rows, move, control, wave, live, options.get("policy", "SKIP"))
        outcomes = _outcomes(rows, found)
        if snapshot:
            state = checkpoint.progress(outcomes, job, "COMPLETED" if completed else "STOPPED", os.path.abspath(source), os.path.abspath(target))
            checkpoint.export_state(state, snapshot)
    if not plan.work:
        return Scan(outcomes, known, next_cache, completed)
    placed = rows.where("outcome = 'PLANNED'").join(found.where("status = 'TRANSFERRED'").select("path", "bytes"), "path")
    placed = placed.select("sha256", F.col("path").alias("canonical"), F.col("destination").alias("destination_path"), F.col("bytes").alias("destination_size"))
    if isinstance(owners, stores.OwnerTable):
        owners.commit(placed)
        return Scan(outcomes, owners.read(), next_cache, completed)
    return Scan(outcomes, claims.commit_claims(known, placed), next_cache, completed)


def _moved(plan: DataFrame, move: bool, control: Control | None, wave: int, live: Live, policy: str) -> tuple[DataFrame, bool]:
    """(RESULT rows, whether all of the work was reached)."""
    actions.require_distinct(plan)
    standing = _standing(plan) if live.snapshot else {}
    work = plan.where("destination is not null").select("path", "destination", "outcome", "size")
    waves = -(-work.count() // wave)
    if waves > 1:
        work = materialize(running(work, [], [F.col("path")], F.lit(1), "_at").select("*", F.expr(f"(_at - 1) div {wave}").alias("_wave")), "work")
    else:
        work = work.withColumn("_wave", F.lit(0))
    results, completed = [], True
    for k in range(waves):
        if control is not None and not control.go_on():
            completed = False
            break
        now = work.where(F.col("_wave") == k)
        live.begin(f"transfer{k}", standing)
        moved = actions.transfer(now.where("outcome = 'PLANNED'"), move, live.gate, live.folder, f"transfer{k}")
        if policy != "SKIP":
            moved = moved.unionByName(actions.transfer(now.where("outcome = 'DUPLICATE'"), False, live.gate))  # twins are copied
        results.append(materialize(moved, f"wave{k}"))
        standing = dict(live.counts())
    found = plan.sparkSession.createDataFrame([], actions.RESULT)
    for more in results:
        found = found.unionByName(more)
    return found, completed and found.where("status = 'NOT_REACHED'").isEmpty()


def _standing(plan: DataFrame) -> dict:
    """What a snapshot counts before the first transfer."""
    state = checkpoint.progress(plan, "", "RUNNING", "", "")
    return {k: state[k] for k in checkpoint.STATE[4:9]}


def _outcomes(plan: DataFrame, results: DataFrame) -> DataFrame:
    got = results.select("path", F.col("status").alias("_status"), F.col("error").alias("_error"))
    final = F.when(F.col("_status") == "FAILED", "FAILED").when((F.col("_status") == "TRANSFERRED") & (F.col("outcome") == "PLANNED"), "TRANSFERRED").otherwise(F.col("outcome"))
    return plan.join(got, "path", "left").withColumn("outcome", final).withColumn("reason", F.coalesce("_error", "reason")).drop("_status", "_error")
