"""Catalogue against storage: every recorded destination gets one status, untracked files are listed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.functions.columns import is_report_artifact
from filelake.functions.fixed import PROBLEM_STATUSES, STATUSES, VERIFIED_STATUSES


def reconcile(catalogue: DataFrame, listing: DataFrame, deep: bool = False) -> DataFrame:
    """Full outer join on the destination. ``catalogue``: sha256, destination_path, destination_size; ``listing``: path, size
    (null if unreadable), relative, and for a deep run observed_sha256 (null if unreadable)."""
    c = catalogue.withColumn("_tracked", F.lit(True))
    rows = c.join(listing.withColumn("_there", F.lit(True)), c["destination_path"] == listing["path"], "full_outer")
    intact = F.lit("INTACT")
    if deep:
        intact = F.when(F.col("observed_sha256").isNull(), "UNREADABLE").when(F.lower("observed_sha256") == F.lower("sha256"), "INTACT").otherwise("CORRUPTED")
    status = (
        F.when(F.col("_tracked").isNull(), "UNTRACKED").when(F.col("destination_path").isNull(), "UNVERIFIABLE").when(F.col("_there").isNull(), "MISSING")
        .when(F.col("size").isNull(), "UNREADABLE").when(F.col("size") != F.col("destination_size"), "RESIZED").otherwise(intact)
    )
    rows = rows.withColumn("status", status).where(~((F.col("status") == "UNTRACKED") & is_report_artifact(F.col("relative"))))
    return rows.withColumn("path", F.coalesce("path", "destination_path")).drop("_tracked", "_there")


def untracked(catalogue: DataFrame, listing: DataFrame) -> DataFrame:
    """Files of the listing that no recorded destination names, without reports."""
    left = listing.join(catalogue.select(F.col("destination_path").alias("path")), "path", "left_anti")
    return left.where(~is_report_artifact(F.col("relative")))


def status_counts(findings: DataFrame) -> DataFrame:
    """One row for each of the seven statuses, zero filled."""
    every = findings.sparkSession.createDataFrame([(s, i, s in PROBLEM_STATUSES) for i, s in enumerate(STATUSES)], "status string, rank int, problem boolean")
    counted = findings.groupBy("status").agg(F.count("*").alias("n"))
    return every.join(counted, "status", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def verdict(findings: DataFrame, completed: bool = True) -> DataFrame:
    """verified, problems and clean; a cancelled run is never clean."""
    bad = F.count_if(F.col("status").isin(PROBLEM_STATUSES))
    return findings.agg(F.count_if(F.col("status").isin(VERIFIED_STATUSES)).alias("verified"), bad.alias("problems"), (F.lit(completed) & (bad == 0)).alias("clean"))
