"""The two keyed tables of a scan: who owns which content, and what is known of each path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.operators import claims
from filelake.operators.keyed import BUCKETS, KeyedTable

OWNERS = "sha256 string, canonical string, destination_path string, destination_size long"
CACHE = "path string, size long, mtime timestamp, sha256 string, partial_sha256 string, mime string, media_date timestamp_ntz"


def _with_destination(rows: DataFrame) -> DataFrame:
    """Owners 1 -> 2: content has a place, which older rows do not know."""
    return rows.withColumns({"destination_path": F.lit(None).cast("string"), "destination_size": F.lit(None).cast("long")})


def _with_partial(rows: DataFrame) -> DataFrame:
    """Cache 1 -> 2: the digest of the first bytes."""
    return rows.withColumn("partial_sha256", F.lit(None).cast("string"))


def _with_type(rows: DataFrame) -> DataFrame:
    """Cache 2 -> 3: type and embedded date, so that a known file need not be opened."""
    return rows.withColumns({"mime": F.lit(None).cast("string"), "media_date": F.lit(None).cast("timestamp_ntz")})


class OwnerTable(KeyedTable):
    """Content by hash. Rows of version 1 had hash and owner only."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        super().__init__(spark, path, "sha256", OWNERS, (_with_destination,), buckets)

    def commit(self, transferred: DataFrame) -> int:
        """New claims, and new destinations of recorded owners."""
        return self.merge(transferred.select(*self.schema.names), claims.commit_claims)

    def backfill(self, cache: DataFrame) -> int:
        """Claims for the hashes of a cache that was kept before there were owners; recorded ones stay."""
        return self.merge(claims.backfill(cache), claims.insert_or_ignore)


class CacheTable(KeyedTable):
    """Digests by path. Rows of version 1 lacked the partial digest, those of version 2 type and date; a row without a type is no hit."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        super().__init__(spark, path, "path", CACHE, (_with_partial, _with_type), buckets)

    def upsert(self, fresh: DataFrame) -> int:
        return self.merge(fresh.select(*self.schema.names), lambda old, new: claims.upsert_cache(old, new).select(*self.schema.names))


def clear(*tables: KeyedTable) -> list[int]:
    """Forget all rows of both tables (a later scan starts anew); the older versions stay readable until a vacuum."""
    return [t.clear() for t in tables]
