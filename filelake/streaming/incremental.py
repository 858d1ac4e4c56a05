"""Micro-batch variants: event append, per-second samples and content claims across batches.

Unbounded state (who owns which content) lives in snapshot tables, not in the state store:
each micro-batch claims against the latest snapshot and commits the next one. A batch that is
replayed after a failure finds its snapshot already there and changes nothing.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filelake.operators.claims import claim
from filelake.session import ship
from filelake.sources.filetree import FileTree


def arrivals(spark: SparkSession, path: str, schema: str, files: int = 64) -> DataFrame:
    """A stream of Parquet files; no micro-batch takes more than ``files`` of them, so a backlog never becomes one batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tree_arrivals(spark: SparkSession, root: str, files: int = 64, tasks: int = 16, control: str | None = None) -> DataFrame:
    """The entries of a tree as a stream of bounded batches: ``files`` for each of ``tasks`` tasks; none while the control says PAUSED or STOPPED."""
    ship(spark)
    spark.dataSource.register(FileTree)
    reader = spark.readStream.format("filetree").option("filesPerTask", files).option("tasksPerBatch", tasks)
    return (reader.option("control", control) if control else reader).load(root)


def append_events(events: DataFrame, path: str, checkpoint: str, seconds: int = 5, rows: int = 500) -> StreamingQuery:
    """Lossless append of event rows, partitioned by job: every ``seconds``, in files of at most ``rows`` rows."""
    return events.writeStream.format("parquet").partitionBy("job_id").option("maxRecordsPerFile", rows).option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def per_second(events: DataFrame, ts: str = "ts", late: str = "10 seconds") -> DataFrame:
    """One sample a second: files and bytes in tumbling windows with a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 second").alias("w")).agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes")).select(F.col("w.start").alias("sample_at"), "files", "bytes")


def claim_stream(files: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Claims content of arriving (path, sha256) rows; ``store`` holds owners/batch=N and claims/batch=N."""

    def step(batch: DataFrame, n: int) -> None:
        spark: SparkSession = batch.sparkSession
        owners_path = f"{store}/owners"
        try:
            known = spark.read.schema("sha256 string, canonical string, batch long").parquet(owners_path).where(F.col("batch") < n).drop("batch")
            known.take(1)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], "sha256 string, canonical string")
        out = claim(batch.select("path", "sha256"), known)
        out.write.mode("overwrite").parquet(f"{store}/claims/batch={n}")
        fresh = spark.read.parquet(f"{store}/claims/batch={n}").where("disposition = 'CLAIM'")
        fresh.select("sha256", F.col("path").alias("canonical")).write.mode("overwrite").parquet(f"{owners_path}/batch={n}")

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_claims(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(os.path.join(store, "claims"))
