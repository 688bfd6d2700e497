"""Incremental ingestion with Structured Streaming; an addition to what a batch build does."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, path: str, time: str = "ts", files_a_batch: int = 16) -> DataFrame:
    """Event files as they arrive, in the schema of those that are there; a time without a zone is one of the session's."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def first_seen(df: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once within the watermark; state is dropped behind it."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def tumbling(df: DataFrame, time: str, width: str, late: str, by: list[str], value: str) -> DataFrame:
    """Counts and sums of each window, final once the watermark has passed it."""
    return df.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))


def sliding(df: DataFrame, time: str, width: str, step: str, late: str, by: list[str]) -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.window(time, width, step), *by).agg(F.count("*").alias("n"))


def sessions(df: DataFrame, time: str, gap: str, late: str, by: str) -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))


STATES = ("pending", "processing", "success", "duplicate", "skipped", "failed")


def crawl_state(df: DataFrame) -> DataFrame:
    """(url, status, retries) from (url, outcome) events: a failure is retried twice, a success stays one; keyed state that survives restarts."""

    def update(key: tuple, batches, state: GroupState):
        status, retries = state.get if state.exists else ("pending", 0)
        for pdf in batches:
            for outcome in pdf["outcome"]:
                if status in ("success", "duplicate"):
                    continue
                if outcome == "failed":
                    retries += 1
                    status = "failed" if retries > 2 else "pending"
                else:
                    status = outcome
        state.update((status, retries))
        yield pd.DataFrame({"url": [key[0]], "status": [status], "retries": [retries]})

    return df.groupBy("url").applyInPandasWithState(update, "url string, status string, retries int", "status string, retries int", "update", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, mode: str, folder: str) -> DataFrame:
    """Process what is there and return the result, which lies in files below `folder` and never in the driver.

    Each batch is written under its number, so one that is run again takes the place of what it had written. In complete mode the last batch is the result, else all are.
    """
    spark, schema = df.sparkSession, df.schema

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not q.lastProgress and not q.recentProgress:
        return spark.createDataFrame([], schema)
    out = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return out.select(*schema.names)
