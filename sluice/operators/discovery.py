"""What lies behind a start: sitemaps of sitemaps, and objects within JSON of any depth."""

from __future__ import annotations

import re
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import nfkc, strip
from .rounds import keep

SITEMAP = "struct<index:boolean,locs:array<string>>"


def _read(body: str | bytes | None) -> dict | None:
    try:
        root = ElementTree.fromstring(body if isinstance(body, bytes) else (body or "").encode())
    except ElementTree.ParseError:
        return None
    bare = lambda tag: tag.rpartition("}")[2] if isinstance(tag, str) else ""
    return {"index": bare(root.tag) == "sitemapindex", "locs": [(x.text or "").strip() for x in root.iter() if bare(x.tag) == "loc"]}


def read_sitemap(body: Column) -> Column:
    """(index, locs) of a sitemap, or of an index of sitemaps; null if it is broken."""

    @F.pandas_udf(SITEMAP)
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read(b) or {"index": None, "locs": None} for b in x], columns=["index", "locs"])

    got = run(body)
    return F.when(got["locs"].isNotNull(), got)


def sitemap_pages(seeds: DataFrame, fetched: DataFrame, normalised: Callable[[Column], Column], allowed: Callable[[Column], Column], limit: int = 300, children: int = 20) -> DataFrame:
    """(seed, rank, url): the pages that sitemaps name, for each seed (seed, origin), the first `limit` in the order in which a queue would meet them.

    fetched: (url, body) of what can be fetched. The queue begins with `/sitemap.xml` of the origin and what its `robots.txt` names; an index adds the first `children` that it lists at the end. URLs count in normal form; a
    sitemap that was seen, isn't allowed, isn't there or is broken is passed over, so loops end. Rounds go a level deeper at a time for all seeds at once, and each level is kept; a place in the queue is the
    path to it, and paths of one length compare as the queue would order them. A seed that has its pages asks for no more.
    """
    known = fetched.select(F.col("url").alias("_url"), "body").where("_url is not null and body is not null")
    robots = F.transform(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?im)^[^\S\n]*Sitemap:[^\S\n]*(\S+)"), 1), lambda u: u)
    start = seeds.select("seed", "origin", F.concat("origin", F.lit("/robots.txt")).alias("r")).join(known, F.col("r") == F.col("_url"), "left")
    start = start.select("seed", F.posexplode(F.concat(F.array(F.concat("origin", F.lit("/sitemap.xml"))), robots)).alias("i", "raw"))
    frontier = start.select("seed", F.array("i").alias("path"), "raw")
    seen, found, level = None, None, 0
    while True:
        asked = frontier.select("seed", "path", normalised(F.col("raw")).alias("url")).where(F.col("url").isNotNull()).where(allowed(F.col("url")))
        asked = asked.groupBy("seed", "url").agg(F.min("path").alias("path"))  # the first place of each in this level
        asked = keep(asked if seen is None else asked.join(seen, ["seed", "url"], "left_anti"))
        if not asked.take(1):
            break
        seen = keep(asked.select("seed", "url") if seen is None else seen.unionByName(asked.select("seed", "url")))
        read = keep(asked.join(known, asked["url"] == known["_url"]).select("seed", "path", read_sitemap(F.col("body")).alias("m")).where("m is not null"))
        pages = read.where("not m.index").select("seed", "path", F.posexplode("m.locs").alias("i", "raw")).select("seed", F.lit(level).alias("level"), F.concat("path", F.array("i")).alias("path"), normalised(F.col("raw")).alias("url"))
        pages = pages.where(F.col("url").isNotNull()).where(allowed(F.col("url")))
        found = keep(_first(pages if found is None else found.unionByName(pages), limit))
        open_ = found.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= limit).select("seed")
        frontier = read.where("m.index").join(open_, "seed", "left_anti").select("seed", "path", F.posexplode(F.slice("m.locs", 1, children)).alias("i", "raw")).select("seed", F.concat("path", F.array("i")).alias("path"), "raw")
        level += 1
    if found is None:
        return seeds.limit(0).select("seed", F.lit(0).cast("long").alias("rank"), F.lit("").alias("url"))
    rank = F.row_number().over(W.partitionBy("seed").orderBy("level", "path"))
    return found.select("seed", rank.cast("long").alias("rank"), "url")


def _first(pages: DataFrame, limit: int) -> DataFrame:
    return pages.withColumn("_n", F.row_number().over(W.partitionBy("seed").orderBy("level", "path"))).where(F.col("_n") <= limit).drop("_n")


def json_objects(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, object): every object of a JSON text, at any depth, as VARIANT; path is where it stands. Null and broken texts have none.

    Members of objects and elements of arrays are opened in rounds, a level at a time, as deep as the deepest text; what is neither goes no further.
    """
    kind = lambda v: F.schema_of_variant(v)
    level = df.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.try_parse_json(json_col).alias("v")).where("v is not null")
    out = None
    while True:
        level = level.select("id", "path", "v", F.substring(kind(F.col("v")), 1, 5).alias("k")).where("k in ('OBJEC', 'ARRAY')")
        # VARIANT can't be checkpointed as text could, so levels are kept as JSON
        level = keep(level.select("id", "path", F.to_json("v").alias("j"), (F.col("k") == "OBJEC").alias("o")))
        if not level.take(1):
            break
        objects = level.where("o").select("id", "path", "j")
        out = objects if out is None else out.unionByName(objects)
        opened = level.select("id", "path", "j").lateralJoin(df.sparkSession.tvf.variant_explode(F.parse_json(F.col("j").outer())))
        level = opened.select("id", F.concat("path", F.coalesce(F.concat(F.lit("."), "key"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))).alias("path"), F.col("value").alias("v")).where("v is not null")
    if out is None:
        out = df.limit(0).select(F.col(id_col).alias("id"), F.lit("").alias("path"), F.lit("{}").alias("j"))
    return out.select("id", "path", F.parse_json("j").alias("object"))


#: Members that hold a question, the first that is a text and not blank; and members that name it, the first that isn't empty.
QUESTIONS, NAMES = ("query", "question", "candidate_user_question", "user_question"), ("query_id", "id", "sample_id", "record_id", "check_id")


def excluded_questions(objects: DataFrame, longest: int = 2_000) -> DataFrame:
    """(id, path, query_id, raw_sha256, normalized, normalized_sha256): the questions of objects (id, path, object), as a registry of what may not be used again.

    A question of more than `longest` characters is left out. Normal form: compatibility forms, lower case, letters and digits only.
    """
    member = lambda k: F.try_variant_get("object", f"$.{k}", "variant")
    string = lambda k: F.when(F.schema_of_variant(member(k)) == "STRING", F.try_variant_get("object", f"$.{k}", "string"))
    raw = F.coalesce(*[F.when(strip(string(k)) != "", string(k)) for k in QUESTIONS])
    name = F.coalesce(*[F.nullif(F.try_variant_get("object", f"$.{k}", "string"), F.lit("")) for k in NAMES], F.lit(""))
    rows = objects.select("id", "path", raw.alias("raw"), name.alias("query_id")).where(F.char_length("raw") <= longest)
    normal = F.regexp_replace(F.lower(nfkc(F.col("raw"))), r"[^\p{L}\p{N}]+", "")
    return rows.select("id", "path", "query_id", F.sha2("raw", 256).alias("raw_sha256"), normal.alias("normalized"), F.sha2(normal, 256).alias("normalized_sha256"))
