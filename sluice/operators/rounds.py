"""Results that are kept: from round to round, or from question to question."""

from __future__ import annotations

import hashlib
import re
import tempfile
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession


#: Spark drops the shuffle files of a query when it ends, where this is true (Spark 4.1).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. Where that is unset, a temporary one in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="rounds-"))
    return sc._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame) -> DataFrame:
    """The same rows, in the shared folder, so that lineage doesn't grow; what was shuffled on the way there is dropped."""
    shared_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt to as many tasks as there are cores where the input has fewer splits, as one small file has; a large input stays as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def files_state(spark: SparkSession, *paths: str) -> str:
    """What lies at these paths, as a digest of names, sizes and times of change: another one as soon as a table is written anew."""
    found = []
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


class ResultCache:
    """Results by key, each for `seconds` after it was made, at most `most` of them: the one that was asked for longest ago goes first.

    What it holds are kept DataFrames, so the rows lie in the shared folder and not in the driver. A key must name all that a result depends on.
    """

    def __init__(self, seconds: float = 300, most: int = 128, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock, self.held = seconds, most, clock, OrderedDict()

    def forget(self) -> None:
        """Drop all that is held."""
        self.held.clear()

    @staticmethod
    def _there(df: DataFrame) -> bool:
        """Whether what was kept can still be read: its session may have ended, or its files may be gone."""
        try:
            df.take(1)
        except Exception:
            return False
        return True

    def get(self, key: Hashable, make: Callable[[], DataFrame]) -> DataFrame:
        now = self.clock()
        for k in [k for k, (t, _) in self.held.items() if now - t > self.seconds]:
            del self.held[k]
        if key in self.held and not self._there(self.held[key][1]):
            del self.held[key]
        if key not in self.held:
            self.held[key] = (now, keep(make()))
            while len(self.held) > self.most:
                self.held.popitem(last=False)
        self.held.move_to_end(key)
        return self.held[key][1]
