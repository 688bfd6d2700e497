"""Metrics of retrieval, classification and coverage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import compact


def ratio(a: Column, b: Column, zero_division: float | None) -> Column:
    """a / b; `zero_division` (null, or a number) where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(zero_division).cast("double"))


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_scores(df: DataFrame, expected: str, predicted: str, zero_division: float | None = None) -> DataFrame:
    """precision, recall and F1 of each class that is expected or predicted anywhere; one pass over the confusion counts."""
    c = confusion(df, expected, predicted)
    sides = c.select(F.explode(F.array(F.struct(F.col("expected").alias("label"), F.lit(1).alias("e"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("e"), F.lit(1).alias("p")))).alias("s"), "n", (F.col("expected") == F.col("predicted")).cast("int").alias("hit"))
    sums = sides.groupBy("s.label").agg(F.sum(F.col("s.e") * F.col("n")).alias("support"), F.sum(F.col("s.p") * F.col("n")).alias("named"), F.sum(F.col("s.e") * F.col("hit") * F.col("n")).alias("tp"))
    p, r = ratio(F.col("tp"), F.col("named"), zero_division), ratio(F.col("tp"), F.col("support"), zero_division)
    return sums.select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r, zero_division), 6).alias("f1"))


def recall_and_mrr(ranks: DataFrame, ks: list[int]) -> DataFrame:
    """From (query_id, first_rank; null if not found): recall at each k and the mean reciprocal rank."""
    hits = [F.round(F.avg(F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0))), 6).alias(f"recall_{k}") for k in ks]
    return ranks.agg(F.count("*").alias("queries"), *hits, F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"))


def nearest_rank(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """The value at place ceil(q n) of each group."""
    w = W.partitionBy(*by)
    rows = df.withColumns({"_i": F.row_number().over(w.orderBy(value)), "_n": F.count("*").over(w)})
    return rows.where(F.col("_i") == F.greatest(F.lit(1), F.ceil(F.col("_n") * q))).select(*by, F.col(value).alias("value"))


def hash_of_set(x: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_set(x)), "|"), 256)


def paired(a: DataFrame, b: DataFrame, key: str, ok: str) -> DataFrame:
    """win, regression, both or neither for each key that both runs have."""
    rows = a.select(key, F.col(ok).alias("a")).join(b.select(key, F.col(ok).alias("b")), key)
    return rows.select(key, F.when(F.col("a") & F.col("b"), "both").when(F.col("b"), "win").when(F.col("a"), "regression").otherwise("neither").alias("outcome"))


def label_pairs(df: DataFrame, labels: str) -> DataFrame:
    """(a, b, n): how often two labels stand in one row."""
    rows = df.select(F.array_sort(F.array_distinct(labels)).alias("l"))
    pairs = F.flatten(F.transform("l", lambda x: F.transform(F.filter("l", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def intent_coverage(docs: DataFrame, intents: DataFrame, id_col: str, text: Column, day: Column, as_of: str, within: int = 400, keep: int = 8) -> DataFrame:
    """A row for each intent of (intent, subjects, actions, minimum): status, how many sources speak of it, how many of these are recent or undated, and the `keep` that come first.

    A source counts if a subject and an action begin within `within` characters of each other, anywhere in its text. Recent ones come first, then newer ones. READY
    from `minimum` on, PARTIAL with any, GAP without. Intents are few, and are read in the driver; texts are looked at once for all of them.
    """
    rules = intents.collect()
    near = lambda a, b: f"(?s)(?=(?:{a})).{{0,{within}}}?(?=(?:{b}))"
    words = lambda xs: "|".join(re.escape(x.lower()) for x in xs)
    low = F.lower(text)
    hits = F.array_compact(F.array(*[F.when(low.rlike(near(words(r["subjects"]), words(r["actions"]))) | low.rlike(near(words(r["actions"]), words(r["subjects"]))), F.lit(r["intent"])) for r in rules]))
    rows = docs.select(F.col(id_col).alias("id"), day.alias("day"), F.explode(hits).alias("intent"))
    rows = rows.withColumn("recent", F.coalesce(F.year("day") >= F.year(F.lit(as_of).cast("date")) - 1, F.lit(False)))
    place = F.row_number().over(W.partitionBy("intent").orderBy(F.desc("recent"), F.desc_nulls_last("day"), F.desc("id")))
    first = rows.withColumn("place", place).where(F.col("place") <= keep).groupBy("intent").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("s"))
    counts = rows.groupBy("intent").agg(F.count("*").alias("sources"), F.count_if("recent").alias("recent"), F.count_if(F.col("day").isNull()).alias("undated"))
    out = intents.select("intent", "minimum").join(counts, "intent", "left").join(first, "intent", "left")
    n = F.coalesce("sources", F.lit(0))
    return out.select("intent", F.when(n >= F.col("minimum"), "READY").when(n > 0, "PARTIAL").otherwise("GAP").alias("status"), n.alias("sources"), F.coalesce("recent", F.lit(0)).alias("recent"), F.coalesce("undated", F.lit(0)).alias("undated"), F.coalesce(F.transform("s", lambda x: x["id"]), F.array().cast("array<string>")).alias("first"))


def leaks(queries: DataFrame, id_col: str, text_col: str, registry: DataFrame, registry_text: str) -> DataFrame:
    """(group_hash, n, first_id, in_registry, verbatim): questions, by their letters and digits, that come more than once or that a registry has; verbatim if one of them stands there letter by letter."""
    key = lambda c: F.sha2(compact(F.col(c)), 256)
    known = registry.select(key(registry_text).alias("group_hash"), F.sha2(registry_text, 256).alias("raw"))
    rows = queries.select(F.col(id_col).alias("id"), key(text_col).alias("group_hash"), F.sha2(text_col, 256).alias("raw"))
    rows = rows.join(known.select("raw").distinct().withColumn("_same", F.lit(True)), "raw", "left")
    groups = rows.groupBy("group_hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.coalesce(F.bool_or("_same"), F.lit(False)).alias("verbatim"))
    out = groups.join(known.select("group_hash").distinct().withColumn("_known", F.lit(True)), "group_hash", "left").withColumn("in_registry", F.coalesce("_known", F.lit(False)))
    return out.where((F.col("n") > 1) | F.col("in_registry")).select("group_hash", "n", "first_id", "in_registry", "verbatim")
