"""Hash cache, content claims and snapshots of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cache_lookup(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds what the cache knows of a file (sha256 and any further columns; null on a miss): a cache row counts only if size and mtime are unchanged."""
    return files.join(cache, ["path", "size", "mtime"], "left")


def claim(files: DataFrame, owners: DataFrame | None = None, key: str = "sha256", order: str = "path") -> DataFrame:
    """Adds matched and disposition: CLAIM for the first of new content, OWN for the recorded owner, else DUPLICATE.

    The first claimant is the smallest ``order``; the minimum is a partial aggregate, so content
    that very many files share never meets in one task (no window over it).
    """
    first = files.groupBy(key).agg(F.min(order).alias("_first"))
    if owners is not None:
        first = first.join(owners.select(key, F.col("canonical").alias("_owner")), key, "left")
    else:
        first = first.withColumn("_owner", F.lit(None).cast(files.schema[order].dataType))
    out = files.join(first, key).withColumn("matched", F.coalesce("_owner", "_first"))
    kind = F.when(F.col(order) != F.col("matched"), "DUPLICATE").when(F.col("_owner").isNull(), "CLAIM").otherwise("OWN")
    return out.withColumn("disposition", kind).drop("_first", "_owner")


def upsert_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """Next cache snapshot: new rows replace old ones of the same path, an old media date outlives a null one."""
    o, n = old.alias("o"), new.alias("n")
    keep = [F.when(F.col("n.path").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in new.columns if c not in ("path", "media_date")]
    return o.join(n, F.col("o.path") == F.col("n.path"), "full_outer").select(F.coalesce("n.path", "o.path").alias("path"), *keep, F.coalesce("n.media_date", "o.media_date").alias("media_date"))


def commit_claims(owners: DataFrame, transferred: DataFrame) -> DataFrame:
    """Next owner snapshot: one owner for each hash, the recorded one before the smallest new ``canonical``.

    A transfer of the owner itself replaces its recorded destination and size; one of another file changes nothing.
    Rows are brought down to one a hash before they meet, so content that very many files share is no hot key.
    """
    known = owners.select("sha256", F.col("canonical").alias("_owner"), F.lit(True).alias("_known"))
    fresh = transferred.groupBy("sha256", "canonical").agg(F.min_by("destination_size", "destination_path").alias("destination_size"), F.min("destination_path").alias("destination_path"))
    fresh = fresh.join(known, "sha256", "left").where(F.col("_known").isNull() | F.col("canonical").eqNullSafe(F.col("_owner")))
    fresh = fresh.groupBy("sha256").agg(F.min(F.struct("canonical", "destination_path", "destination_size")).alias("_new"))
    both, new = owners.join(fresh, "sha256", "full_outer"), F.col("_new").isNotNull()
    later = {c: F.when(new, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in ("destination_path", "destination_size")}
    return both.withColumns(later | {"canonical": F.coalesce("canonical", "_new.canonical")}).select(owners.columns)


def backfill(cache: DataFrame) -> DataFrame:
    """Owner rows from the paths and hashes of a cache, for a store that has no owners yet: the first path of each hash, not placed so far."""
    first = cache.where("sha256 is not null").groupBy("sha256").agg(F.min("path").alias("canonical"))
    return first.withColumns({"destination_path": F.lit(None).cast("string"), "destination_size": F.lit(None).cast("long")})


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str = "sha256", order: str = "canonical") -> DataFrame:
    """The old rows, and of each key they lack the new row with the smallest ``order``."""
    rest = [c for c in old.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")
    return old.unionByName(first.join(old.select(key), key, "left_anti").select(old.columns))


def resume(own: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds present: the recorded destination exists with the recorded size."""
    there = listing.select(F.col("path").alias("destination_path"), F.col("size").alias("_there"))
    return own.join(there, "destination_path", "left").withColumn("present", F.coalesce(F.col("_there") == F.col("destination_size"), F.lit(False))).drop("_there")
