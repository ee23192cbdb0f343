"""Timed runs of an encoding, as rows of the metrics table."""

from __future__ import annotations

import itertools
import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.plans.encode import Encoding, encode_files
from helixframe.sources.files import SEQUENTIAL
from helixframe.sources.ranges import FILES

#: Phases that are timed apart.
TIMED = ("lsbm_ms", "huffman_ms", "encode_ms")
UNKNOWN = -1.0


@dataclass
class Times:
    """Milliseconds of each run, whole and by phase."""

    total_ms: list[float] = field(default_factory=list)
    lsbm_ms: list[float] = field(default_factory=list)
    huffman_ms: list[float] = field(default_factory=list)
    encode_ms: list[float] = field(default_factory=list)

    def add(self, marks: list[float]) -> None:
        """marks: seconds at the beginning and after each phase."""
        for name, a, b in zip(TIMED, marks[:-1], marks[1:], strict=True):
            getattr(self, name).append((b - a) * 1e3)
        self.total_ms.append((marks[-1] - marks[0]) * 1e3)

    def columns(self) -> dict[str, F.Column]:
        """Means, and population deviations, as columns."""
        own = ("total_ms", *TIMED)
        means = {c: F.lit(statistics.fmean(getattr(self, c))) for c in own}
        return means | {f"std_{c}": F.lit(statistics.pstdev(getattr(self, c))) for c in own}


def executors(spark: SparkSession) -> list:
    """Summaries of executors from Spark's own status store; none where it can't be read."""
    try:
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return [found.apply(k) for k in range(found.size())]
    except Exception:  # another kind of session
        return []


def peak_memory_mb(spark: SparkSession) -> float:
    """The largest memory that an executor has had so far, JVM heap and what is outside of it; UNKNOWN where Spark doesn't tell."""
    most = UNKNOWN
    for x in executors(spark):
        peak = x.peakMemoryMetrics()
        if peak.isDefined():
            most = max(most, sum(peak.get().getMetricValue(m) for m in ("JVMHeapMemory", "JVMOffHeapMemory")) / 1e6)
    return most if most > 0 else UNKNOWN


def task_seconds(spark: SparkSession) -> tuple[float, int]:
    """Seconds that tasks have taken so far, on all executors, and how many cores there are."""
    own = executors(spark)
    return sum(x.totalDuration() for x in own) / 1e3, sum(x.totalCores() for x in own)


def encode_run(make: Callable[[], Encoding], runs: int = 5) -> DataFrame:
    """A row of the metrics table (the columns of SEQUENTIAL) for each payload of an encoding that `make` makes anew for each of
    `runs` runs, one at least. Its keys must be dataset and file_name, or more.

    Times are those of the whole job: encodings of several payloads share them; Encoding.timed() says how phases of one pass are told apart.
    peak_ram_mb is the largest an executor has had, and cpu_percent the share of all cores' time that tasks took in the runs, -1 where Spark
    doesn't tell. The frame's tables stay until the session ends."""
    spark, times, last, found = SparkSession.getActiveSession(), Times(), None, None
    busy, wall = task_seconds(spark)[0], time.perf_counter()
    for _ in range(max(1, runs)):
        if last is not None:
            last.close()
        last = make()
        found, spent = last.timed()
        times.add([0.0, *itertools.accumulate(spent)])
    (after, cores), wall = task_seconds(spark), time.perf_counter() - wall
    share = 100 * (after - busy) / (wall * cores) if cores and after > busy else UNKNOWN
    schema = T.StructType.fromDDL(SEQUENTIAL)
    own = {"file_size_bytes": F.col("n_bytes"), "runs": F.lit(max(1, runs)), "seq_count": F.col("storage_seq_count"), "peak_ram_mb": F.lit(peak_memory_mb(spark)), "cpu_percent": F.lit(share)} | times.columns()
    return found.select(*[own.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema])


def run_files(spark: SparkSession, path: str, runs: int = 5, glob: str = FILES, dataset: str | None = None) -> DataFrame:
    """encode_run() of a folder's files, or of the one that path names; dataset: a tag that takes the place of theirs."""
    found = encode_run(lambda: encode_files(spark, path, glob), runs)
    return found if dataset is None else found.withColumn("dataset", F.lit(dataset))
