"""Acceptance one after the other: a row is taken unless a row taken before shares a key with it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import keep

#: Pairs of row and key that one task goes through.
MOST = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of the connected components of edges (a, b), root the least id; rounds grow with the logarithm of a component's size.

    In turn, larger neighbours are linked with the least neighbour (large star), and smaller ones with the least (small star), until edges are stars.
    """
    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if not edges.take(1):
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        small = keep(small)
        # stars: no root is itself a leaf, and what didn't change is done
        if not small.join(edges, ["a", "b"], "left_anti").take(1) and not edges.join(small, ["a", "b"], "left_anti").take(1):
            roots = small.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("root"))
            return small.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
        edges = small


def _one_by_one(pairs: DataFrame, by: str) -> DataFrame:
    """(id) of the rows taken, each part of `by` gone through in the order of ids; a part holds `MOST` pairs at most."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        seen: set = set()
        taken = []
        for i, keys in d.sort_values("id").groupby("id", sort=True)["key"]:
            if seen.isdisjoint(keys):
                seen.update(keys)
                taken.append(i)
        return pd.DataFrame({"id": pd.Series(taken, dtype=d["id"].dtype)})

    return pairs.groupBy(by).applyInPandas(run, f"id {pairs.schema['id'].dataType.simpleString()}")


def accepted(pairs: DataFrame, most: int = MOST) -> DataFrame:
    """(id): the rows of (id, key) that are taken when rows come in the order of ids and one that shares a key with a row taken before is left out. Exact, whatever the rows.

    Two rounds take, all at once, the rows that are the least of all their keys, and drop what shares a key with them: that settles large groups of equal keys. What remains,
    chains of rows that share keys in turn, falls into components; those of `most` pairs at most are gone through in a task each, and the rest takes further rounds.
    """
    pairs = keep(pairs.select("id", "key").where("id is not null and key is not null").distinct())
    taken = pairs.select("id").limit(0)
    while True:
        n = pairs.count()
        if n <= most:
            last = _one_by_one(pairs.withColumn("part", F.lit(0)), "part")
            return keep(taken.unionByName(last))
        for _ in range(2):
            least = pairs.groupBy("key").agg(F.min("id").alias("least"))
            winners = keep(pairs.join(least, "key").groupBy("id").agg(F.bool_and(F.col("id") == F.col("least")).alias("won")).where("won").select("id"))
            gone = pairs.join(pairs.join(winners, "id", "left_semi").select("key"), "key", "left_semi").select("id").distinct()
            taken, pairs = keep(taken.unionByName(winners)), keep(pairs.join(gone, "id", "left_anti"))
        if pairs.count() <= most:
            continue
        least = pairs.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
        # a key without a rival says nothing any more; rows that have no other are taken
        tied = pairs.join(least, "key")
        alone = pairs.join(tied.select("id").distinct(), "id", "left_anti").select("id").distinct()
        root = components(tied.select(F.col("id").alias("a"), F.col("least").alias("b")))
        placed = keep(tied.join(root, "id").select("id", "key", "root"))
        small = placed.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("root")
        solved = _one_by_one(placed.join(small, "root", "left_semi"), "root")
        taken = keep(taken.unionByName(alone).unionByName(solved))
        pairs = keep(placed.join(small, "root", "left_anti").select("id", "key"))
