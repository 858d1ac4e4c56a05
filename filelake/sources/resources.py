"""Resource metrics of a running job: CPU load, used heap and disk rates, sampled on the driver; over the cluster from Spark's own status."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


class ResourceSampler:
    """``sample`` gives (cpu_percent, memory_gb, read_mb_per_sec, write_mb_per_sec) since the last call, and keeps the peaks.

    CPU is this machine's load in percent of all cores. Disk rates come from the bytes that the job says it has read and
    written: no growth is 0, and time counts 1 ms at least."""

    def __init__(self, spark: SparkSession) -> None:
        self.runtime = spark._jvm.java.lang.Runtime.getRuntime()
        self.cpu, self.at, self.bytes = self._ticks(), time.monotonic(), (0, 0)
        self.peaks = (0.0, 0.0, 0.0, 0.0)

    @staticmethod
    def _ticks() -> tuple[int, int]:
        try:
            with open("/proc/stat", encoding="ascii") as f:
                found = [int(x) for x in f.readline().split()[1:9]]
        except OSError:  # not Linux: no load
            return 0, 0
        return sum(found) - found[3] - found[4], sum(found)

    def sample(self, read_bytes: int = 0, written_bytes: int = 0) -> tuple[float, float, float, float]:
        cpu, at, now = self._ticks(), time.monotonic(), (read_bytes, written_bytes)
        busy, every, dt = cpu[0] - self.cpu[0], cpu[1] - self.cpu[1], max(0.001, at - self.at)
        load = 100.0 * busy / every if every > 0 else 0.0
        heap = (self.runtime.totalMemory() - self.runtime.freeMemory()) / 1024**3
        rates = [max(0, b - a) / 1024**2 / dt for a, b in zip(self.bytes, now, strict=True)]
        self.cpu, self.at, self.bytes = cpu, at, now
        got = (max(0.0, min(100.0, load)), heap, *rates)
        self.peaks = tuple(map(max, self.peaks, got))
        return got


def executor_memory(spark: SparkSession) -> dict[str, tuple[int, int]]:
    """(used, free) bytes of storage memory by executor, the driver's own included."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    it, out = status.iterator(), {}
    while it.hasNext():
        pair = it.next()
        most, free = pair._2()._1(), pair._2()._2()
        out[pair._1()] = (most - free, free)
    return out
