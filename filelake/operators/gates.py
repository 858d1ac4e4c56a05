"""Walk filter, validation gates and event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelake.functions import columns as C
from filelake.functions.fixed import IGNORE_PATTERNS, IMAGE_MIN_BYTES, VIDEO_MIN_BYTES


def walk_disposition(files: DataFrame, patterns: list[str] = IGNORE_PATTERNS) -> DataFrame:
    """Adds name, ext, file_type and walk_skip: ignore rules first, then unsupported formats."""
    out = files.withColumn("name", C.file_name(F.col("path"))).withColumn("ext", C.extension(F.col("name")))
    out = out.withColumn("file_type", C.media_type(F.col("ext")))
    skip = F.when(C.ignored(F.col("name"), patterns), "IGNORE_RULE_MATCHED").when(F.col("file_type").isNull(), "UNSUPPORTED_FORMAT")
    return out.withColumn("walk_skip", skip)


def size_gate(size: Column, file_type: Column, image_min: int = IMAGE_MIN_BYTES, video_min: int = VIDEO_MIN_BYTES) -> Column:
    """Skip reason of the cheap gates, or null: empty first, then too small for its type (strictly below)."""
    return F.when(size == 0, "EMPTY_FILE").when((file_type == "IMAGE") & (size < image_min), "SMALL_FILE").when((file_type == "VIDEO") & (size < video_min), "SMALL_FILE")


def skip_events(rows: DataFrame, job: str) -> DataFrame:
    """Event rows for skipped, failed and duplicate files; blank failure reasons and null skip reasons get their stand-ins."""
    reason = F.when(F.col("outcome") == "FAILED", F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("Unspecified failure"))).otherwise(F.coalesce("reason", F.lit("UNKNOWN")))
    return rows.where(F.col("outcome").isin("SKIPPED", "FAILED", "DUPLICATE")).select(
        F.lit(job).alias("job_id"), "outcome", F.col("path").alias("file_path"), C.file_name(F.col("path")).alias("file_name"),
        F.coalesce("size", F.lit(0)).alias("file_size"), F.when(F.col("outcome") != "DUPLICATE", reason).alias("reason"), "sha256", "matched_path", "destination_path",
    )


def job_counters(rows: DataFrame, by: str, move: bool = False) -> DataFrame:
    """The fifteen counters of a job in one pass over outcome rows (outcome, reason, size, folder); ``move``: transfers were moves."""
    is_ = lambda o: F.col("outcome") == o
    number = lambda test, name: F.count_if(test).alias(name)
    size = lambda test, name: F.coalesce(F.sum(F.when(test, F.col("size"))), F.lit(0)).alias(name)
    sent, never = is_("TRANSFERRED"), F.lit(False)
    copied, moved = (never, sent) if move else (sent, never)
    return rows.groupBy(by).agg(
        number(sent | is_("PRESENT"), "files_processed"), number(is_("FAILED"), "files_failed"), number(is_("SKIPPED"), "files_skipped"), number(is_("DUPLICATE"), "duplicates_found"),
        number(copied, "files_copied"), number(moved, "files_moved"), number(is_("SKIPPED") & (F.col("reason") == "EMPTY_FILE"), "empty_files"),
        number(is_("SKIPPED") & (F.col("reason") == "SMALL_FILE"), "small_files"), number(is_("FAILED"), "corrupt_files"),
        size(sent, "bytes_processed"), size(moved, "bytes_moved"), size(copied, "bytes_copied"), size(is_("FAILED") | is_("SKIPPED"), "bytes_skipped"), size(is_("DUPLICATE"), "bytes_saved"),
        F.count_distinct(F.when(sent, F.col("folder"))).alias("folders_created"),
    )
