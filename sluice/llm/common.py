"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rounds import shared_folder as shared_dir

#: White space that separates words: space and the controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that Python works on at a time, whatever the size of an Arrow batch.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch that Spark hands to Python, at most, but for a row that is longer by itself.
BATCH_BYTES = 4 << 20
#: Spark drops the shuffle files of a query when it ends, where this is true (Spark 4.1).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder, so that a lost executor costs no recomputation; what was shuffled on the way there is dropped."""
    shared_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete what lies at a path of the shared folder and is no longer needed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def parts(df: DataFrame) -> int:
    """Shuffle partitions of the session: the operator of the cluster sizes it for the input."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes."""
    return text.split()


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to about `most` bytes of `column`, so that memory doesn't follow the length of texts."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = np.array(pa.compute.binary_length(batch.column(at)).fill_null(0), np.int64)
        start = 0
        while start < batch.num_rows:
            ends = np.cumsum(sizes[start:])
            n = max(1, int(np.searchsorted(ends, most, "right")))
            yield batch.slice(start, n)
            start += n


def utf8(column: pa.Array) -> list[bytes]:
    """Strings as UTF-8 bytes; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def worker_cache() -> dict:
    """What a Python worker keeps from task to task; whoever fills it bounds it."""
    return sys.modules.setdefault("sluice_worker_cache", types.ModuleType("sluice_worker_cache")).__dict__.setdefault("held", {})


def give_back() -> None:
    """Return freed memory to the system: workers live from task to task, and their executors have bounds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow for rows with long texts: memory is given back at the end of each task, and batches are cut by bytes.

    The latter is a setting of the session, as what is returned runs later: `spark.sql.execution.arrow.maxBytesPerBatch` becomes `BATCH_BYTES` where it is more.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        yield from f(batches)
        give_back()

    return df.mapInArrow(run, schema)


def sample_at_most(df: DataFrame, key: str, n: int, total: int | None = None) -> DataFrame:
    """About `n` rows at most, chosen by a hash of `key`; all of them where there are no more."""
    total = df.count() if total is None else total
    if total <= n:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * n / total))


def sound_vectors(rows: DataFrame) -> tuple[DataFrame, int, int, float]:
    """(rows, length, number, greatest magnitude of a component): the rows whose `vec` is not null, has no null or non-finite component, and is of the commonest length.

    Of lengths met equally often the shorter is it. Components are doubles. Without a row left the length is 0.
    """
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size("vec") > 0)
    rows = rows.withColumn("vec", F.col("vec").cast("array<double>")).where(F.coalesce(fine, F.lit(False)))
    greatest = F.aggregate("vec", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))
    found = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(greatest).alias("most")).orderBy(F.desc("n"), "dim").first()
    if found is None:
        return rows, 0, 0, 0.0
    return rows.where(F.size("vec") == found["dim"]), found["dim"], found["n"], found["most"]


def spread_join(rows: DataFrame, facts: DataFrame, key: str, count: str, deal: Column, most: int = 1_000) -> DataFrame:
    """`rows` with the columns of `facts`, which has one row for each value of `key`, null too, and in `count` how many rows bear it; rows without facts stay.

    A value that more than one row in `most` bears, of which there are fewer than `most`, is dealt by `deal` to as many shares as it has such parts of the rows, and its facts
    are repeated for each share; so no task takes a frequent value whole. Only those few values are broadcast.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    per = max(1, total // most)
    hot = facts.where(F.col(count) > per).select(F.col(key).alias("_key"), F.least(F.lit(most), F.ceil(F.col(count) / per)).cast("int").alias("_shares"))
    hot = F.broadcast(hot)

    def with_shares(df: DataFrame) -> DataFrame:
        return df.join(hot, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").withColumn("_shares", F.coalesce("_shares", F.lit(1)))

    left = with_shares(rows).withColumn("_share", F.pmod(deal, F.col("_shares")).cast("int")).drop("_shares")
    right = with_shares(facts.drop(count) if count not in rows.columns else facts)
    right = right.withColumn("_of", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares").withColumnRenamed(key, "_fact_key")
    return left.join(right, F.col(key).eqNullSafe(F.col("_fact_key")) & (F.col("_share") == F.col("_of")), "left").drop("_fact_key", "_share", "_of")
