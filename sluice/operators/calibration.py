"""Thresholds of a gate by nested cross-validation, as one grid of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .rounds import keep

#: The labels, from what a gate lets through to what it doesn't; and fixed values: what the parts of a gate's utility weigh.
LABELS = ("SUFFICIENT", "PARTIAL", "INSUFFICIENT")
FALSE_SUFFICIENT, RECALLS, MACRO_F1 = 0.32, {"SUFFICIENT": 0.28, "PARTIAL": 0.16, "INSUFFICIENT": 0.12}, 0.12


def folded(df: DataFrame, stratum: list[str], key: Column, k: int, name: str) -> DataFrame:
    """A fold from 0 to k - 1 for each row: in turn within its stratum, in the order of a hash."""
    return df.withColumn(name, ((F.row_number().over(W.partitionBy(*stratum).orderBy(key)) - 1) % k).cast("int"))


def _dense(cells: DataFrame, labels: tuple[str, ...], **ranges: int) -> DataFrame:
    """All combinations of a cell, the numbers of `ranges` and a label: what has no row counts as 0."""
    out = cells
    for name, k in ranges.items():
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return out.withColumn("label", F.explode(F.array(*map(F.lit, labels))))


def _likelihood(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, cell, p): for each cell the likelihoods of the labels, a map, from the training counts `t`: shares within the cell, drawn to those of all cells by one row."""
    whole = F.sum("t").over(W.partitionBy(*by))
    share = F.when(whole > 0, F.sum("t").over(W.partitionBy(*by, "label")) / whole).otherwise(F.lit(0.0))
    rows = counts.withColumn("p", (F.col("t") + share) / (F.sum("t").over(W.partitionBy(*by, "cell")) + 1))
    return rows.groupBy(*by, "cell").agg(F.map_from_entries(F.collect_list(F.struct("label", "p"))).alias("p"))


def _named(p: Column, threshold: Column) -> Column:
    return F.when(p["SUFFICIENT"] >= threshold, "SUFFICIENT").when(p["PARTIAL"] >= p["INSUFFICIENT"], "PARTIAL").otherwise("INSUFFICIENT")


def utility(confusion: DataFrame, by: list[str]) -> DataFrame:
    """(by, utility) from counts (by, label, named, n): few false passes, the recalls, and the mean F1, each with its weight; a recall without rows counts as 0, and no false passes as none."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    hit, own, said = lambda x: n((F.col("label") == x) & (F.col("named") == x)), lambda x: n(F.col("label") == x), lambda x: n(F.col("named") == x)
    sums = [f(x).alias(f"{k}_{x}") for x in LABELS for k, f in (("hit", hit), ("own", own), ("said", said))]
    rows = confusion.groupBy(*by).agg(*sums)
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    recall = {x: part(f"hit_{x}", f"own_{x}") for x in LABELS}
    f1 = lambda x: F.when(F.col(f"own_{x}") + F.col(f"said_{x}") > 0, 2 * F.col(f"hit_{x}") / (F.col(f"own_{x}") + F.col(f"said_{x}"))).otherwise(F.lit(0.0))
    others = F.col("own_PARTIAL") + F.col("own_INSUFFICIENT")
    passed = F.when(others > 0, (F.col("said_SUFFICIENT") - F.col("hit_SUFFICIENT")) / others).otherwise(F.lit(0.0))
    total = FALSE_SUFFICIENT * (1 - passed) + sum((w * recall[x] for x, w in RECALLS.items()), F.lit(0.0)) + MACRO_F1 * (sum((f1(x) for x in LABELS), F.lit(0.0)) / len(LABELS))
    return rows.select(*by, F.round(total, 9).alias("utility"))


def nested_thresholds(df: DataFrame, id_col: str, stratum: str, label: str, cell: str, thresholds: tuple[float, ...], outer: int = 5, inner: int = 3, seed: str = "||cv") -> DataFrame:
    """(fold, threshold, inner_utility, validation_n, validation_utility): for each outer fold the threshold that does best, by inner folds of the other rows alone, and how it does on the fold.

    A row has a `label` of `LABELS` and a `cell`, what the model sees of it, of which there are few; the model learns for each cell how likely the labels are. Rows are read once, and counted by outer fold, inner fold, cell and label: fits,
    predictions and thresholds for all folds at once are then sums and products of counts, so no model is fitted in a loop. Of thresholds that do equally well the first counts. Rows without a label or cell take no part.
    """
    key = F.sha2(F.concat(F.col(id_col).cast("string"), F.lit(seed)), 256)
    rows = df.where(F.col(label).isin(*LABELS) & F.col(cell).isNotNull()).select(key.alias("h"), F.col(stratum).alias("s"), F.col(label).alias("label"), F.col(cell).alias("cell"))
    rows = folded(rows, ["s"], F.col("h"), outer, "f").withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    trained = folded(rows.where("f <> o"), ["o", "s"], F.col("h"), inner, "i")
    held = rows.where("f = o").groupBy("o", "cell", "label").agg(F.count("*").alias("v"))
    counts = keep(trained.groupBy("o", "i", "cell", "label").agg(F.count("*").alias("c")))
    cells = counts.select("cell").unionByName(held.select("cell")).distinct()
    grid = keep(_dense(cells, LABELS, o=outer, i=inner).join(counts, ["o", "i", "cell", "label"], "left").withColumn("c", F.coalesce("c", F.lit(0))))
    inside = grid.withColumn("t", F.sum("c").over(W.partitionBy("o", "cell", "label")) - F.col("c"))
    seen = _likelihood(inside, ["o", "i"])
    tried = F.explode(F.array(*[F.struct(F.lit(x).alias("threshold"), F.lit(k).alias("k")) for k, x in enumerate(thresholds)]))
    named = grid.where("c > 0").join(seen, ["o", "i", "cell"]).select("o", "label", F.col("c").alias("n"), "p", tried.alias("x")).select("o", "x.threshold", "x.k", "label", _named(F.col("p"), F.col("x.threshold")).alias("named"), "n")
    scores = utility(named, ["o", "threshold", "k"])
    chosen = scores.groupBy("o").agg(F.max_by(F.struct("threshold", "utility"), F.struct("utility", (-F.col("k")).alias("k"))).alias("x")).select("o", "x.threshold", F.col("x.utility").alias("inner_utility"))
    whole = _likelihood(grid.groupBy("o", "cell", "label").agg(F.sum("c").alias("t")), ["o"])
    judged = held.join(whole, ["o", "cell"]).join(chosen, "o").select("o", "label", _named(F.col("p"), F.col("threshold")).alias("named"), F.col("v").alias("n"))
    out = utility(judged, ["o"]).withColumnRenamed("utility", "validation_utility").join(held.groupBy("o").agg(F.sum("v").alias("validation_n")), "o").join(chosen, "o")
    return out.select((F.col("o") + 1).cast("long").alias("fold"), "threshold", "inner_utility", "validation_n", "validation_utility")
