"""Deterministic sampling, splitting and ordering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .rounds import keep


def seeded(seed: str, x: Column) -> Column:
    return F.sha2(F.concat(F.lit(seed + ":"), x.cast("string")), 256)


def first_per(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def round_robin(df: DataFrame, bucket: str, order: list) -> DataFrame:
    """turn: the order of taking one row of each bucket after the other; sort by (turn, bucket)."""
    return df.withColumn("turn", F.row_number().over(W.partitionBy(bucket).orderBy(*order)))


def with_quota(df: DataFrame, quotas: DataFrame, by: str, order: list, buffer: float = 0.1) -> DataFrame:
    """The first rows of each group, up to its quota and a tenth more."""
    rows = df.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    return rows.join(quotas, by).where(F.col("_n") <= F.ceil(F.col("quota") * (1 + buffer))).drop("_n", "quota")


def allocate(counts: DataFrame, by: str, n: str, total: int) -> DataFrame:
    """(by, quota): shares of `total` by largest remainders, ties by name. counts has a row for each group, so it is small."""
    rows = counts.withColumn("_all", F.sum(n).over(W.partitionBy()))
    exact = F.col(n) * total / F.col("_all")
    rows = rows.withColumns({"_floor": F.floor(exact), "_rest": F.round(exact - F.floor(exact), 9)})
    rows = rows.withColumns({"_left": total - F.sum("_floor").over(W.partitionBy()), "_i": F.row_number().over(W.orderBy(F.desc("_rest"), by))})
    return rows.select(by, (F.col("_floor") + (F.col("_i") <= F.col("_left")).cast("int")).alias("quota"))


def hash_split(group: Column, parts: int = 10) -> Column:
    """0 to parts - 1 by the group's hash, so that a group never straddles."""
    return (F.conv(F.substring(F.sha2(group.cast("string"), 256), 1, 8), 16, 10).cast("long") % parts).cast("long")


def folds(df: DataFrame, stratum: str, key: Column, k: int) -> DataFrame:
    return df.withColumn("fold", (F.row_number().over(W.partitionBy(stratum).orderBy(key)) - 1) % k)


def evenly_spaced(df: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """k rows of each group at even distances, the first and last among them; halves round to even places."""
    w = W.partitionBy(by)
    rows = df.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (k - 1)).cast("long"))
    return rows.where(F.array_contains(wanted, F.col("_i").cast("long"))).drop("_i", "_n")


def diverse(df: DataFrame, stratum: str, id_col: str, features: list[str], n: int) -> DataFrame:
    """n rows of each stratum, each time one whose feature values were used least, ties by the seeded order.

    Of rows with the same features the first in order is taken first, so n of each at most can ever be; only these meet in the sequential part.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict = {}
        left, out = pdf.sort_values("_h").to_dict("records"), []
        while left and len(out) < n:
            best = min(range(len(left)), key=lambda i: (sum(used.get((f, left[i][f]), 0) for f in features), i))
            row = left.pop(best)
            for f in features:
                used[f, row[f]] = used.get((f, row[f]), 0) + 1
            out.append(row)
        return pd.DataFrame(out, columns=pdf.columns)

    rows = first_per(df.withColumn("_h", seeded("diverse", F.col(id_col))), [stratum, *features], ["_h"], n)
    return rows.groupBy(stratum).applyInPandas(run, rows.schema).drop("_h")


def context_before(df: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """context: the texts before a row, joined."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("context", F.array_join(F.collect_list(text).over(w), "\n"))


def ranks(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rank of each row, from 1, in the order of all rows, without a window that takes all of them.

    Rows are dealt by ranges and sorted; each part counts its own, and begins where those before it end. Ties come as the order leaves them, so it should leave none.
    """
    placed = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_at") + F.col("_before") + 1).drop("_part", "_at", "_before")


def running(df: DataFrame, order: list[Column], weight: Column, start: str, total: str) -> DataFrame:
    """`start`: the sum of the weights of the rows before each in the order of all rows; `total`: of all. As `ranks`, without a window that takes all rows. Null weights count as 0."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).withColumn("_w", F.coalesce(weight, F.lit(0)).cast("long"))
    placed = keep(placed)
    sums = placed.groupBy("_part").agg(F.sum("_w").alias("_s"))
    before = sums.select("_part", (F.sum("_s").over(W.orderBy("_part")) - F.col("_s")).alias("_before"), F.sum("_s").over(W.partitionBy()).alias(total))  # a row a partition
    within = F.sum("_w").over(W.partitionBy("_part").orderBy("_at")) - F.col("_w")
    return placed.join(F.broadcast(before), "_part").withColumn(start, F.col("_before") + within).drop("_part", "_at", "_before")


def drawn(df: DataFrame, id_col: str, family: Column, weight: Column, quotas: dict[str, int], seed: str, epoch: int = 0) -> DataFrame:
    """(family, draw, id): `quotas` draws from each family, with replacement, so a row may come again; a row comes as often as its weight, a whole number, asks for.

    Inverse sampling: rows lie end to end, in the order of ids, each as long as its weight; a draw is a point, by a hash of seed, epoch, family and number, and takes the row that it falls into. Rows and draws meet
    by segments of the mean weight, so that a row lies in few and no task takes a family. Weights of 0 or less and null ids never come; families without rows give no draws.
    """
    out = None
    for name, n in quotas.items():
        rows = df.where((family == name) & (weight > 0) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), weight.cast("long").alias("w"))
        placed = running(rows, [F.col("id")], F.col("w"), "start", "total")
        placed = keep(placed.select("id", "w", "start", "total"))
        head = placed.agg(F.max("total").alias("t"), F.count("*").alias("n")).first()
        if not head["n"]:
            continue
        wide = max(1, head["t"] // head["n"])
        segments = placed.select("id", "start", (F.col("start") + F.col("w")).alias("end"), F.explode(F.sequence(F.floor(F.col("start") / wide), F.floor((F.col("start") + F.col("w") - 1) / wide))).alias("segment"))
        point = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:{epoch}:{name}:"), F.col("draw").cast("string")), 256), 1, 15), 16, 10).cast("long") % head["t"]
        draws = df.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("point", point).withColumn("segment", F.floor(F.col("point") / wide))
        met = draws.join(segments, "segment").where((F.col("start") <= F.col("point")) & (F.col("point") < F.col("end"))).select(F.lit(name).alias("family"), "draw", "id")
        out = met if out is None else out.unionByName(met)
    return out if out is not None else df.limit(0).select(F.lit("").alias("family"), F.lit(0).cast("long").alias("draw"), F.col(id_col).alias("id"))
