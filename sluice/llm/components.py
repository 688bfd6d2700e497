"""Connected components of a graph that lies in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of `edges`; root is the same node for all that are connected.

    Contraction: each round hangs a node on its least neighbour, in an order dealt by a hash so that chains
    halve, and keeps only the edges between different parents. Minima are combined before the shuffle, so a node
    with very many neighbours costs no task more than its share. Loops and repeated edges are allowed; no edges
    give no rows.
    """
    e = edges.select(F.col(a).cast("long").alias("_a"), F.col(b).cast("long").alias("_b")).where("_a <> _b")
    e = cut(e.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct())
    hung = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    steps = []
    for _ in range(max_rounds):
        if not e.take(1):
            break
        both = e.unionByName(e.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        up = both.groupBy("_a").agg(F.min(hung("_b")).alias("m"))
        up = cut(up.select(F.col("_a").alias("node"), F.least(hung("_a"), F.col("m"))["id"].alias("parent")))
        steps.append(up)
        left = up.select(F.col("node").alias("_a"), F.col("parent").alias("pa"))
        right = up.select(F.col("node").alias("_b"), F.col("parent").alias("pb"))
        e = e.join(left, "_a").join(right, "_b").where("pa <> pb")
        e = cut(e.select(F.least("pa", "pb").alias("_a"), F.greatest("pa", "pb").alias("_b")).distinct())
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    if not steps:
        return e.select(F.col("_a").alias("node"), F.col("_b").alias("root"))
    out = steps[0].select("node", F.col("parent").alias("root"))
    for up in steps[1:]:
        up = up.select(F.col("node").alias("root"), "parent")
        out = out.join(up, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
    return cut(out)
