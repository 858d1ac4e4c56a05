"""Session helpers: shared scratch tables, code shipping, table access.

Intermediate results that are read more than once are written as Parquet to the
shared folder named by ``spark.checkpoint.dir``, so a lost executor never loses
them; a folder is chosen here only where that setting is missing (tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the executors' Python workers (once per context)."""
    sc = spark.sparkContext
    if getattr(sc, "_filelake_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="filelake-"), "filelake.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("filelake", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._filelake_shipped = True
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder. Only a session in local mode may do without that setting.

    The folders of a session are noted; ``clean`` deletes them once their results are no longer needed.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(sc, "_filelake_scratch", None)
        if not base:
            base = sc._filelake_scratch = tempfile.mkdtemp(prefix="filelake-scratch-")
    path = f"{base.rstrip('/')}/filelake-{uuid.uuid4().hex}"
    if not hasattr(sc, "_filelake_made"):
        sc._filelake_made = []
    sc._filelake_made.append(path)
    return path


def clean(spark: SparkSession) -> int:
    """Delete the intermediate tables that this session wrote so far; DataFrames built on them can no longer be read."""
    sc, gone = spark.sparkContext, 0
    made, sc._filelake_made = getattr(sc, "_filelake_made", []), []
    for path in made:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True))
    return gone


def unused(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as set it apart from ``columns`` (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def file_tasks(spark: SparkSession) -> int:
    """Into how many tasks work on files is dealt. Rows with paths are small and files are not, so Spark must not join such tasks by the bytes of their rows."""
    return 4 * shuffle_partitions(spark)
