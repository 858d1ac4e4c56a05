"""Rates, rolling averages, peaks and two kinds of downsampling. A series of any length may span many tasks (``ranking``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filelake.operators.ranking import first_rows, frames, prefix, running


def delta_rate(rows: DataFrame, by: str, order: list[str], total: str, micros: Column) -> DataFrame:
    """Adds rate: growth of a running total per second since the previous row; no growth is 0, time is at least 1 ms."""
    def rate(w: Window) -> dict[str, Column]:
        dv, dt = F.col(total) - F.lag(total).over(w), (F.col("_us") - F.lag("_us").over(w)) / F.lit(1e6)
        return {"rate": F.when(dv > 0, dv / F.greatest(dt, F.lit(0.001))).otherwise(0.0)}

    return frames(rows.withColumn("_us", micros), [by], [F.col(c) for c in order], 1, rate).drop("_us")


def rolling(rows: DataFrame, by: str, order: list[str], value: str, sizes: dict[str, int]) -> DataFrame:
    """Adds one moving average for each name: over that many rows, partially filled at the start."""
    return frames(rows, [by], [F.col(c) for c in order], max(sizes.values()) - 1, lambda w: {k: F.avg(value).over(w.rowsBetween(1 - n, 0)) for k, n in sizes.items()})


def running_peak(rows: DataFrame, by: str, order: list[str], value: str, name: str = "peak") -> DataFrame:
    return prefix(rows, [by], [F.col(c) for c in order], {name: ("max", F.col(value))})


def bucket_average(samples: DataFrame, by: str, elapsed: str, values: list[str], target: int, firsts: tuple[str, ...] = ()) -> DataFrame:
    """Averages in buckets of elapsed seconds; the bucket width follows from the target count and the last sample. ``firsts``: columns of which each bucket keeps the smallest, such as the time of its first sample."""
    last = samples.groupBy(by).agg(F.coalesce(F.max(elapsed), F.lit(0)).alias("_last"))
    width = F.greatest(F.lit(1), F.expr(f"_last div {max(1, target)}") + 1)
    rows = samples.join(last, by).withColumn("_w", width).withColumn("bucket", F.expr(f"{elapsed} div _w"))
    return rows.groupBy(by, "bucket").agg(F.min(elapsed).alias("elapsed"), *[F.min(c).alias(c) for c in firsts], *[F.avg(v).alias(v) for v in values])


def envelope(samples: DataFrame, by: str, order: list[str], value: str, target: int) -> DataFrame:
    """Rows kept by the min/max envelope: the first minimum and first maximum of each of ``target`` index buckets, and both ends.

    Index and buckets come from running counts and partial aggregates, so a long series is no single task.
    """
    rows = running(samples, [by], [F.col(c) for c in order], F.lit(1), "_i").withColumn("_i", F.col("_i") - 1)
    total = samples.groupBy(by).agg(F.count("*").alias("_n"))
    rows = rows.join(total.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by").withColumn("_b", F.expr(f"((_i + 1) * {target} - 1) div _n"))
    low, high = F.struct(F.col(value).alias("col1"), F.col("_i").alias("col2")), F.struct(F.col(value).alias("col1"), (-F.col("_i")).alias("col2"))
    ends = rows.groupBy(F.col(by).alias("_by"), F.col("_b").alias("_bucket")).agg(F.min(low)["col2"].alias("_lo"), (-F.max(high)["col2"]).alias("_hi"))
    rows = rows.join(ends, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_bucket")))
    keep = (F.col("_n") <= 2 * target) | (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | (F.col("_i") == F.col("_lo")) | (F.col("_i") == F.col("_hi"))
    return rows.where(keep).select(*samples.columns)


def chartable(samples: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """The series with enough samples for a chart."""
    return samples.groupBy(*by).count().where(F.col("count") >= least)


def latest(rows: DataFrame, by: str, order: list[str], n: int = 3600) -> DataFrame:
    """The capped history of each series: its last ``n`` rows."""
    return first_rows(rows, [by], [F.desc(c) for c in order], n, "_rank").drop("_rank")


def job_rate(processed: Column, seconds: Column) -> Column:
    """Files a second over the whole job; 0 within its first second."""
    whole = F.floor(seconds)
    return F.when(whole >= 1, processed / whole).otherwise(0.0)


def keep_last(rows: DataFrame, by: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the value, or the last one before it that was not null."""
    return prefix(rows, [by], [F.col(c) for c in order], {name: ("last", F.col(value))})


def trailing(samples: DataFrame, by: str, elapsed: str, seconds: int) -> DataFrame:
    last = samples.groupBy(by).agg(F.max(elapsed).alias("_last"))
    return samples.join(last, by).where(F.col(elapsed) >= F.greatest(F.lit(0), F.col("_last") - seconds)).drop("_last")


def eta(total: Column, processed: Column, rate: Column) -> Column:
    return F.when((rate > 0) & (total > processed), (total - processed) / rate)
