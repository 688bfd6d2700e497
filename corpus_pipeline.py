"""The corpus pipeline: quality, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and gives the columns of `documents`; the last gives the places of
pieces in packed sequences. Rows of null or empty texts are documents like others. SQL can express no stage; tests compare them with brute force.
Columns besides those of `documents`, whatever their names, are dropped by the first stage. Very long texts are read whole, one at a time, by every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import cut, remove, shared_dir, table
from sluice.llm.op2_simhash import similar_components
from sluice.llm.op4_packing import CAPACITIES, pack, word_count
from sluice.llm.op7_substring import drop_repeats
from sluice.llm.op8_toxicity import fit_toxicity, score_toxicity
from sluice.llm.op10_quality import fit_quality, score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.5 or more.

    Null and empty texts have a score like others; repeated rows go or stay together; an empty table stays empty, and without labels all stay.
    """
    docs = docs.select(*COLUMNS)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, "doc_id", "text", model, COLUMNS).where("score >= 0.5").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.7.

    Null and empty texts have no hits and stay; repeated rows go or stay together; an empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, "doc_id", "text", model, COLUMNS).where("score < 0.7").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the least id, once.

    Texts without words, null ones too, are duplicates of each other. Rows without an id stay, once for each text; an empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    gone = similar_components(docs, "doc_id", "text", 5, 0.8).where("id <> component_id").select(F.col("id").alias("doc_id")).distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    often = cut(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")))
    if not often.take(1):
        return kept.select(*COLUMNS)
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    return kept.join(often, same, "left_anti").unionByName(kept.join(often, same, "left_semi").dropDuplicates(["doc_id", "text"])).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 50-word windows that an earlier document has; documents of which nothing is left go.

    Null and empty texts stay as they are; repeated rows of one id take nothing from each other; an empty table stays empty.
    """
    out = drop_repeats(docs.select(*COLUMNS), "doc_id", "text", 50)
    out = out.where("n_removed < n_words or n_words = 0")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of the permitted lengths, in words.

    Null and empty texts have one row without a place; repeated rows are pieces of their own; an empty table gives no rows.
    """
    return pack(docs.select("doc_id", word_count(F.col("text")).alias("n")), "doc_id", "n", CAPACITIES).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next; what a stage has read goes when it has been written."""
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{i}-{name}")
        docs = spark.read.parquet(f"{where}/{i}-{name}")
        if i:
            remove(spark, f"{where}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
