"""Queries of streaming ingestion: each runs over the event files that are there and ends."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.rounds import shared_folder
from ..streaming import ingest as I
from .registry import query


def _run(spark, df, mode):
    return I.run_once(df, mode, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


def _events(spark, sf_dir):
    return I.events(spark, f"{sf_dir}/events.parquet*")


@query("st1_tumbling_windows", "select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def st1(spark, sf_dir):
    out = _run(spark, I.tumbling(_events(spark, sf_dir), "ts", "1 day", "2 days", ["event_type"], "value"), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("st2_session_windows", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, s")
def st2(spark, sf_dir):
    out = _run(spark, I.sessions(_events(spark, sf_dir), "ts", "6 hours", "2 days", "user_id"), "complete")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("st3_first_seen", "select distinct event_id from events")
def st3(spark, sf_dir):
    return _run(spark, I.first_seen(_events(spark, sf_dir), ["event_id"], "ts", "2 days"), "append").select("event_id")


@query("st4_crawl_state")
def st4(spark, sf_dir):
    """Arbitrary keyed state, which depends on the order within files; a fixture tests it."""
    rows = _events(spark, sf_dir).select(F.concat(F.lit("u"), F.col("user_id")).alias("url"), F.when(F.col("event_id") % 5 == 0, "success").otherwise("failed").alias("outcome"))
    return _run(spark, I.crawl_state(rows), "update").groupBy("url").agg(F.max("retries").alias("retries"))
