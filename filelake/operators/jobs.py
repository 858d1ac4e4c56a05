"""The job store: jobs, events and samples as append-only Parquet tables, partitioned by job.

A change of a job is a new row of its log; the row with the latest (``seq``) counts. Appends write a
folder of their own, so a batch is there as a whole or not at all. A delete drops the job's
partitions, events and samples before the job itself. All storage goes through Hadoop's file API.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Counters and rates of a job.
COUNTERS = [
    "files_processed", "files_failed", "files_skipped", "duplicates_found", "files_copied", "files_moved", "empty_files", "small_files", "corrupt_files",
    "bytes_processed", "bytes_moved", "bytes_copied", "bytes_skipped", "bytes_saved", "folders_created",
]
RATES = [
    "avg_mb_per_sec", "peak_mb_per_sec", "avg_files_per_sec", "peak_files_per_sec", "avg_cpu_percent", "peak_cpu_percent", "avg_memory_gb", "peak_memory_gb",
    "peak_disk_read_mb_sec", "peak_disk_write_mb_sec",
]
ACTIVE = ["RUNNING", "PAUSED"]

_JOB = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("start_time", T.TimestampNTZType()), T.StructField("end_time", T.TimestampNTZType()),
    *[T.StructField(c, T.LongType()) for c in COUNTERS], *[T.StructField(c, T.DoubleType()) for c in RATES], T.StructField("seq", T.LongType()),
])
EVENTS = "job_id string, outcome string, event_seq long, file_path string, file_name string, file_size long, reason string, sha256 string, matched_path string, destination_path string, recorded_at timestamp"
SAMPLES = "job_id string, sample_at timestamp, elapsed long, files_per_sec double, mb_per_sec double, cpu_percent double, memory_gb double"


def latest_jobs(log: DataFrame) -> DataFrame:
    """One row for each job: of every column the latest value that is not null."""
    rest = [c for c in log.columns if c not in ("job_id", "seq")]
    return log.groupBy("job_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in rest])


def active_job(jobs: DataFrame) -> DataFrame:
    """At most one job that is running or paused: the one that began last."""
    return jobs.where(F.col("status").isin(ACTIVE)).orderBy(F.desc("start_time"), "job_id").limit(1)


def history(jobs: DataFrame) -> DataFrame:
    """All jobs, newest first."""
    return jobs.orderBy(F.desc("start_time"), "job_id")


def by_key(rows: DataFrame, column: str, key) -> DataFrame:  # noqa: ANN001
    """Point lookup."""
    return rows.where(F.col(column) == F.lit(key))


def transferred(owners: DataFrame) -> DataFrame:
    """Recorded content in destination order; content that was never placed is left out."""
    return owners.where("destination_path is not null").orderBy("destination_path")


def of_job(rows: DataFrame, job: str, order: str = "elapsed") -> DataFrame:
    return rows.where(F.col("job_id") == job).orderBy(order)


def with_samples(jobs: DataFrame, samples: DataFrame) -> DataFrame:
    """Each job with its samples as one summary row: number, last elapsed second, means and peaks of files and MB a second."""
    own = samples.groupBy("job_id").agg(
        F.count("*").alias("samples"), F.max("elapsed").alias("last_elapsed"), F.avg("files_per_sec").alias("mean_files_per_sec"), F.max("files_per_sec").alias("most_files_per_sec"),
        F.avg("mb_per_sec").alias("mean_mb_per_sec"), F.max("mb_per_sec").alias("most_mb_per_sec"),
    )
    return jobs.join(own, "job_id", "left").withColumn("samples", F.coalesce("samples", F.lit(0)))


def without_job(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """The rows that stay when ``jobs`` (job_id) are deleted; rows without a job stay."""
    return rows.join(jobs.select("job_id").distinct(), "job_id", "left_anti")


class JobStore:
    """Tables ``jobs``, ``events`` and ``samples`` below one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _append(self, table: str, rows: DataFrame) -> None:
        """All or nothing: written beside the table, then renamed into it, one folder for each job and batch."""
        draft, batch = f"{self.path}/.draft-{uuid.uuid4().hex}", uuid.uuid4().hex
        rows.write.partitionBy("job_id").parquet(draft)
        for s in self._fs.listStatus(self._path(draft)):
            name = s.getPath().getName()
            if name.startswith("job_id="):
                home = self._path(f"{self.path}/{table}/{name}")
                self._fs.mkdirs(home)
                if not self._fs.rename(s.getPath(), self._path(f"{self.path}/{table}/{name}/batch={batch}")):
                    raise OSError(f"cannot append to {table}/{name}")
        self._fs.delete(self._path(draft), True)

    def _read(self, table: str, schema: str | T.StructType) -> DataFrame:
        folder = f"{self.path}/{table}"
        kinds = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        if not self._fs.exists(self._path(folder)) or not self._fs.listStatus(self._path(folder)):
            return self.spark.createDataFrame([], kinds)
        full = T.StructType([*kinds.fields, T.StructField("batch", T.StringType())])
        return self.spark.read.schema(full).option("basePath", folder).parquet(folder).select(*kinds.names)

    def _log(self, job: str, **values) -> None:  # noqa: ANN003
        row = {c: None for c in _JOB.names} | {"job_id": job, "seq": time.time_ns()} | values
        self._append("jobs", self.spark.createDataFrame([tuple(row[c] for c in _JOB.names)], _JOB))

    def insert(self, job: str, start, status: str = "RUNNING") -> None:  # noqa: ANN001
        self._log(job, status=status, start_time=start, **dict.fromkeys(COUNTERS, 0), **dict.fromkeys(RATES, 0.0))

    def update(self, job: str, **counters) -> None:  # noqa: ANN003
        if unknown := set(counters) - {*COUNTERS, *RATES, "status"}:
            raise ValueError(f"unknown counters {sorted(unknown)}")
        self._log(job, **counters)

    def status(self, job: str, status: str, end=None) -> None:  # noqa: ANN001
        """RUNNING and PAUSED while it runs; COMPLETED or STOPPED with an end time; INTERRUPTED for a job that a crash left."""
        self._log(job, status=status, end_time=end)

    def append_events(self, events: DataFrame) -> None:
        self._append("events", events)

    def append_samples(self, samples: DataFrame) -> None:
        self._append("samples", samples)

    def jobs(self) -> DataFrame:
        return latest_jobs(self._read("jobs", _JOB))

    def events(self) -> DataFrame:
        return self._read("events", EVENTS)

    def samples(self) -> DataFrame:
        return self._read("samples", SAMPLES)

    def delete(self, job: str) -> None:
        """Events first, then samples, then the job, so that nothing is left without its job."""
        name = self.spark.createDataFrame([(job,)], "job_id string")
        folder = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name.first()[0])
        for table in ("events", "samples", "jobs"):
            self._fs.delete(self._path(f"{self.path}/{table}/job_id={folder}"), True)
