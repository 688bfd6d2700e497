"""Queries of readers and sinks: each writes a table to the shared folder and reads it back."""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import metadata as M
from ..operators.batches import map_batches
from ..sources import readers as R
from ..operators.rounds import shared_folder
from ..sources import sinks as K
from .registry import query, table


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("s2_csv_round_trip", "select doc_id, lang, source, sha256(text) as text_sha256 from documents")
def s2(spark, sf_dir):
    path = _folder(spark)
    K.write_csv(table(spark, sf_dir, "documents"), path, ["doc_id", "lang", "source", "text"])
    return R.csv(spark, path, "doc_id long, lang string, source string, text string").select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"))


@query("s4_markdown_round_trip", f"select doc_id, department, sha256(regexp_replace(regexp_replace(replace(text, chr(10) || '---', ''), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) as body_sha256 from ({M.META_SQL})")
def s4(spark, sf_dir):
    path = _folder(spark)
    body = F.trim(F.regexp_replace(F.replace("text", F.lit("\n---"), F.lit("")), r"\s+", " "))
    page = F.concat(F.lit("---\ndoc_id: "), F.col("doc_id"), F.lit("\ndepartment: "), F.col("department"), F.lit("\n---\n"), body, F.lit("\n\n---\n\nSource: "), F.col("url"), F.lit("\n"))
    # one file of many documents, parted by a mark, and read as such
    M.sources(table(spark, sf_dir, "documents")).select(page.alias("value")).write.option("lineSep", "\x1e").text(path)
    text = spark.read.option("lineSep", "\x1e").text(path).where("value <> ''").select(F.lit("").alias("path"), F.col("value").alias("t"))
    return R.front_matter(text).select(F.element_at("meta", F.lit("doc_id")).cast("long").alias("doc_id"), F.element_at("meta", F.lit("department")).alias("department"), F.sha2("body", 256).alias("body_sha256"))


@query("k1_jsonl_round_trip", "select event_id, user_id, event_type, value from events")
def k1(spark, sf_dir):
    path = _folder(spark)
    K.write_jsonl(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), path, ["event_id"])
    return R.jsonl(spark, path, "event_id long, user_id long, event_type string, value double")


@query("k2_csv_whitelist", "select 'doc_id,lang' as header, count(*) as rows, sum(doc_id)::bigint as ids from documents")
def k2(spark, sf_dir):
    """Only the listed fields are in the file, in their order."""
    path = _folder(spark)
    K.write_csv(table(spark, sf_dir, "documents"), path, ["doc_id", "lang"])
    back = R.csv(spark, path, "doc_id long, lang string")
    head = spark.read.text(path).where("value like 'doc_id%'").distinct().select(F.col("value").alias("header"))
    return head.join(F.broadcast(back.agg(F.count("*").alias("rows"), F.sum("doc_id").alias("ids"))))


@query("k3_versioned_bundle", "select lang, count(*) as n from documents group by 1")
def k3(spark, sf_dir):
    """The second version is served, in any session, once it is whole."""
    base, rows = _folder(spark), table(spark, sf_dir, "documents")
    K.publish(spark, rows.limit(1), base, "v1")
    K.publish(spark, rows.groupBy("lang").agg(F.count("*").alias("n")), base, "v2")
    return K.served(spark.newSession(), base)


@query("k4_atomic_json", "select 2 as version, 0 as left_over")
def k4(spark, sf_dir):
    """A file that is replaced whole, with nothing left beside it."""
    base = _folder(spark)
    for i in (1, 2):
        K.write_atomic(spark, f"{base}/state.json", f'{{"version": {i}}}')
    files = spark.read.format("binaryFile").load(base)
    return files.agg(F.max(F.get_json_object(F.decode("content", "UTF-8"), "$.version").cast("int")).alias("version"), (F.count("*") - 1).cast("int").alias("left_over"))


@query("k5_manifest", "select sum(1)::bigint as lines, sum(octet_length(encode('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}')) + 1)::bigint as bytes, 64 as digest_chars from events")
def k5(spark, sf_dir):
    path = _folder(spark)
    K.write_jsonl(table(spark, sf_dir, "events").select("event_id", "event_type"), path, ["event_id"])
    files = K.manifest(spark, path).where(F.col("path").contains("part-"))
    return files.agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"), F.max(F.char_length("sha256")).alias("digest_chars"))


_KINDS = ("docx", "xlsx", "pptx", "pdf")


def _office(spark, sf_dir):
    """Files of the benchmark's items, one kind after the other, every ninth broken and every tenth of a kind that no reader is for; the folder they lie in."""
    i = F.col("item_id")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (i % 4 + 1).cast("int"))

    @F.pandas_udf("binary")
    def made(k: pd.Series, t: pd.Series, broken: pd.Series) -> pd.Series:
        files = [K.office_file(a, [[line] for line in b.split("\n")]) for a, b in zip(k, t)]
        return pd.Series([f[: len(f) // 2] if x else f for f, x in zip(files, broken)])

    path = _folder(spark)
    rows = table(spark, sf_dir, "benchmark").select(F.concat(i, F.lit("."), F.when(i % 10 == 9, "odt").otherwise(kind)).alias("name"), made(kind, "text", i % 9 == 0).alias("content"))
    K.write_files(rows, path, "name", "content").agg(F.sum("bytes")).collect()
    return path


_PLAIN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_SHOWN = "case when item_id % 4 = 3 then regexp_replace(" + _PLAIN + r", '[^\x01-\xff]', '?', 'g') else " + _PLAIN + " end"


@query("s9_attachments", f"select item_id, case when item_id % 10 = 9 then 'NO_READER' when item_id % 9 = 0 then 'BROKEN' end as reason, case when item_id % 10 <> 9 and item_id % 9 <> 0 then sha256({_SHOWN}) end as text_sha256 from benchmark")
def s9(spark, sf_dir):
    """Office files and PDFs are written and read back; broken ones and those without a reader keep a null text and a reason."""
    rows = R.attachments(spark, _office(spark, sf_dir))
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    return rows.select(F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("long").alias("item_id"), "reason", F.sha2(text, 256).alias("text_sha256"))


#: Ids of the documents that one sheet holds.
SHEET = 40_000


@query("s3_sheet_rows", "select doc_id, lang, source from documents where doc_id % 7 > 0")
def s3(spark, sf_dir):
    """Sheets of each source, one for `SHEET` ids, with a title, an empty row and a header above its rows, and blank rows among them; the header is found in each."""
    i = F.col("doc_id")
    cells = F.array(i.cast("string"), F.col("lang"), F.col("source"))
    rows = table(spark, sf_dir, "documents").select("source", F.floor(i / SHEET).alias("part"), i.alias("n"), F.when(i % 7 > 0, cells).otherwise(F.array(F.lit(""), F.lit(" "))).alias("cells"))
    sheets = rows.groupBy("source", "part").agg(F.array_sort(F.collect_list(F.struct("n", "cells"))).alias("r"))  # a sheet is read and written whole

    def made(batches):
        for b in batches:
            for i in range(b.num_rows):  # a sheet at a time
                content = K.office_file("xlsx", [["A list of documents"], [], ["doc_id", "lang", "source"], *b.column(1)[i].as_py()])
                yield pa.RecordBatch.from_pydict({"name": b.column(0).slice(i, 1), "content": pa.array([content], pa.binary())})

    path = _folder(spark)
    named = sheets.select(F.concat("source", F.lit("-"), "part", F.lit(".xlsx")).alias("name"), F.transform("r", lambda x: x["cells"]).alias("cells"))
    K.write_files(map_batches(named, made, "name string, content binary"), path, "name", "content").agg(F.sum("bytes")).collect()
    out = R.header_rows(R.xlsx(spark, path), "row_no", "cells", "doc_id", by="path")
    return out.select(F.col("row")["doc_id"].cast("long").alias("doc_id"), F.col("row")["lang"].alias("lang"), F.col("row")["source"].alias("source"))


@query("k7_changed_files", "select item_id, contains(lower(text), 'the') as had, 0 as old_left, true as same_kind from benchmark where item_id % 4 < 3 and item_id % 9 > 0 and item_id % 10 < 9")
def k7(spark, sf_dir):
    """Office files with a word replaced, read again."""

    @F.pandas_udf("struct<new:string,kind:string>")
    def run(k: pd.Series, c: pd.Series) -> pd.DataFrame:
        changed = [K.changed_file(a, K.changed_file(a, bytes(b), "the", "TTHHEE"), "The", "TTHHEE") for a, b in zip(k, c)]
        return pd.DataFrame({"new": [R.office_text(a, b) for a, b in zip(k, changed)], "kind": ["zip" if b[:2] == b"PK" else "" for b in changed]})

    files = spark.read.format("binaryFile").load(_office(spark, sf_dir)).select(F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("long").alias("item_id"), F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("kind"), "content")
    out = files.where("kind in ('docx', 'xlsx', 'pptx') and item_id % 9 > 0").select("item_id", run("kind", "content").alias("r"))
    return out.select("item_id", F.col("r.new").contains("TTHHEE").alias("had"), F.regexp_count("r.new", F.lit("the|The")).alias("old_left"), (F.col("r.kind") == "zip").alias("same_kind"))


@query("s7_paged_source", "select i::bigint as id, (i * i % 97)::bigint as value from range(0, 1037) t(i)")
def s7(spark, sf_dir):
    """A dataset of 1,037 rows that is served by pages of 100, each fetched by an executor."""
    spark.dataSource.register(R.paged_source("sluice_pages", "id long, value long", lambda at, n: ((i, i * i % 97) for i in range(at, at + n))))
    return spark.read.format("sluice_pages").option("total", 1037).option("page_size", 100).load()


@query("s11_bundle_check", "select 'CHANGED' as fault, 1 as n union all select 'MISSING', 1")
def s11(spark, sf_dir):
    """A manifest of what was written, held against the folder after one file was changed and one was lost."""
    path = _folder(spark)
    rows = spark.createDataFrame([(f"f{i}.txt", bytearray(b"body %d" % i)) for i in range(5)], "name string, content binary")
    K.write_files(rows, path, "name", "content").collect()
    before = K.manifest(spark, path).select("path", F.when(F.col("path").endswith("f4.txt"), F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"))
    lost = before.limit(1).select(F.concat("path", F.lit(".gone")).alias("path"), "sha256")
    return R.verify_bundle(K.manifest(spark, path), before.unionByName(lost)).groupBy("fault").agg(F.count("*").cast("int").alias("n"))
