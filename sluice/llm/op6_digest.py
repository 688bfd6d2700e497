"""Canonical exact digests, with DataFrame functions only.

A text is normalised (NFKC), case-folded (Unicode's full folding, so ß is ss) and its white space folded; two XXH64 of the result with unlike seeds
make a fingerprint of 128 bits. Texts group by fingerprint and, inside an equal bucket, by their canonical bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, table

#: White space of any script, as Java's expressions name it.
BLANK = r"[\s\p{Z}\x85]+"
#: At most so many ranges of ids, however large the table: a number and a key of each are broadcast.
MOST_RANGES = 1 << 20


def canonical(text: Column) -> Column:
    """NFKC, case and white space folded and trimmed; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    nfkc = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = lambda x: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(nfkc(fold(nfkc(text))))
    return F.trim(F.regexp_replace(folded, BLANK, " "))


def halves(canon: Column) -> tuple[Column, Column]:
    return F.xxhash64(canon), F.xxhash64(F.lit(0x5EED), canon)


def hex128(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def digest_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fp_a, fp_b, group_id, copies, canon): a row for each canonical text; group_id is its least id.

    Copies are combined before the shuffle, so a text that most rows share costs no task more than its share. canon is null, except where two
    canonical texts share a fingerprint. Null ids count as absent in group_id.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), canonical(F.col(f"`{text_col}`")).alias("canon"))
    a, b = halves(F.col("canon"))
    rows = rows.select("id", a.alias("fp_a"), b.alias("fp_b"), "canon")
    texts = rows.groupBy("fp_a", "fp_b", "canon").agg(F.min("id").alias("group_id"), F.count("*").alias("copies"))
    first = texts.groupBy("fp_a", "fp_b").agg(F.min("group_id").alias("group_id"), F.sum("copies").alias("copies"), F.count("*").alias("variants"))
    first = cut(first)
    if not first.where("variants > 1").take(1):
        return first.select("fp_a", "fp_b", "group_id", "copies", F.lit(None).cast("string").alias("canon"))
    shared = first.where("variants > 1").select("fp_a", "fp_b")
    alone = first.where("variants = 1").select("fp_a", "fp_b", "group_id", "copies", F.lit(None).cast("string").alias("canon"))
    return alone.unionByName(texts.join(shared, ["fp_a", "fp_b"], "left_semi").select("fp_a", "fp_b", "group_id", "copies", "canon"))


def _range_of(x: Column, bounds: list[int], per: int) -> Column:
    """A number that rises with x: which of the bounds' segments it lies in, and where in that segment, `per` steps each."""

    def find(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            start, end = bounds[lo], bounds[hi]
            step = max(1, -(-(end - start + 1) // per))
            inside = F.least(F.lit(per - 1), F.greatest(F.lit(0), F.floor((x - F.lit(start)) / F.lit(step)).cast("int")))
            return F.lit(lo * per) + inside
        mid = (lo + hi) // 2
        return F.when(x < F.lit(bounds[mid]), find(lo, mid)).otherwise(find(mid, hi))

    return find(0, len(bounds) - 1).cast("int")


def with_next(df: DataFrame, id_col: str, text_col: str, carry: list[str], derive: dict[str, Column] | None = None, rows_per_range: int = 500) -> DataFrame:
    """id, text, `carry`, `derive` (columns made of `text`) and, of the row that follows in the order of ids (after the last: the first), next_text and next_<c> of each.

    Ids are cut into ranges, so texts move once and no task holds more than a range; only the first row of each range, of which there are
    `MOST_RANGES` at most, is looked up apart. What is derived is computed once for a row, where it has arrived, and for those first rows.
    Null ids come first; rows of one id follow the order of their texts. Null texts count as empty. An empty table gives no rows.
    """
    derive, carry = derive or {}, list(carry)
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 62)))
    rows = df.select(key.alias("key"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *carry)
    n, lo, hi, cuts = df.select(key.alias("key")).agg(F.count("*"), F.min("key"), F.max("key"), F.percentile_approx("key", [i / 64 for i in range(65)], 1000)).first()
    ranges = max(1, min(MOST_RANGES, -(-n // rows_per_range)))
    bounds = sorted({lo, hi + 1, *cuts}) if n else [0, 1]
    per = max(1, -(-ranges // (len(bounds) - 1)))
    rows = rows.withColumn("range", _range_of(F.col("key"), bounds, per))
    order = [F.col("key"), F.col("text")]
    nearest = W.partitionBy("range").orderBy(*order)
    # the window sorts by itself; the columns between its exchange and the lead are made where the row lies
    placed = rows.repartition("range").withColumns(derive) if derive else rows
    ahead = placed.select("*", F.lead(F.struct("text", *carry, *derive)).over(nearest).alias("ahead"))
    # of each range, where the first row of the one that follows lies; a range has a row here, so there are few
    heads = rows.groupBy("range").agg(F.min("key").alias("key"))
    heads = heads.select(F.col("range").alias("at"), "key", F.lag("range").over(W.orderBy("range")).alias("before"), F.max("range").over(W.partitionBy()).alias("last"))
    heads = F.broadcast(heads.select("at", "key", F.coalesce("before", "last").alias("before")))
    first = rows.join(heads, (rows["range"] == heads["at"]) & (rows["key"] == heads["key"])).groupBy("before").agg(F.min(F.struct("text", *carry)).alias("head"))
    first = first.select("before", "head.*").withColumns(derive).select("before", F.struct("text", *carry, *derive).alias("head"))
    out = ahead.join(first, ahead["range"] == first["before"], "left").withColumn("ahead", F.coalesce("ahead", "head"))
    carry += derive
    return out.select("id", "text", *carry, F.col("ahead.text").alias("next_text"), *[F.col(f"ahead.{c}").alias(f"next_{c}") for c in carry])


def op6_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the whole `documents` and of their edited texts, and the group of equal canonical texts. No SQL: DuckDB has no such folding and no XXH64 of Spark's; tests
    compare it with Python's. Null texts are empty; repeated rows follow each other; very long texts are hashed whole, in the JVM; an empty
    table gives no rows; columns besides, whatever their names, play no part.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = digest_groups(docs, "doc_id", "text")
    collided = bool(groups.where("canon is not null").take(1))
    a, b = halves(canonical(F.col("text")))
    rows = with_next(docs, "doc_id", "text", [], {"fp_a": a, "fp_b": b})
    n = F.char_length("text")
    m = F.floor(n / 4).cast("int")
    rows = rows.select("*", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - m), F.substring("next_text", F.lit(1), m)).alias("edited"))
    a, b = halves(canonical(F.col("edited")))
    rows = rows.select("*", a.alias("ea"), b.alias("eb"))
    same = lambda x, y, other: F.when((F.col("fp_a") == F.col(x)) & (F.col("fp_b") == F.col(y)), (canonical(F.col("text")) == canonical(F.col(other))).cast("double")).otherwise(F.lit(0.0))
    rows = rows.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), hex128(F.col("fp_a"), F.col("fp_b")).alias("fingerprint"), hex128(F.col("ea"), F.col("eb")).alias("edited_fingerprint"),
        same("ea", "eb", "edited").alias("near_edited"), same("next_fp_a", "next_fp_b", "next_text").alias("near_next"), "fp_a", "fp_b", *([canonical(F.col("text")).alias("own")] if collided else []),
    )
    if not collided:
        return rows.join(groups.drop("canon"), ["fp_a", "fp_b"], "left").drop("fp_a", "fp_b")
    # two canonical texts share a fingerprint: such groups are told apart by their bytes
    groups = groups.select(F.col("fp_a").alias("ga"), F.col("fp_b").alias("gb"), "group_id", "copies", "canon")
    met = (F.col("fp_a") == F.col("ga")) & (F.col("fp_b") == F.col("gb")) & (F.col("canon").isNull() | (F.col("canon") == F.col("own")))
    return rows.join(groups, met, "left").drop("fp_a", "fp_b", "own", "ga", "gb", "canon")
