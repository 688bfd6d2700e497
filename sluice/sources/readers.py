"""Readers of files with declared schemas."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import strip
from ..operators.batches import map_batches

BOM = "﻿"


def jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = True) -> DataFrame:
    """A JSON object a line; blank lines and a byte order mark are skipped, a line that isn't JSON fails. A missing path has no rows."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    value = F.regexp_replace("value", f"^{BOM}", "")
    rows = lines.select(value.alias("value")).where(F.trim("value") != "")
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A header and quoted fields, which may hold line ends; a byte order mark isn't part of the first name. A field of nothing is null, and one of two quotes an empty text."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("charToEscapeQuoteEscaping", '"')
    reader = reader.option("nullValue", uuid.uuid4().hex)  # what a field of nothing is taken for: no text that may stand in the file
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.toDF(*[c.removeprefix(BOM) for c in df.columns])


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta, body) of whole files: front matter between --- lines as a map, and the text without it and without a source footer."""
    return front_matter(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", f"^{BOM}", "").alias("t")))


def front_matter(text: DataFrame) -> DataFrame:
    """(path, meta, body) of (path, t)."""
    head = F.regexp_extract("t", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n", 1)
    pairs = F.filter(F.split(head, r"\r?\n"), lambda s: s.contains(":"))
    meta = F.map_from_entries(F.transform(pairs, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("k"), F.trim(F.regexp_replace(s, r"^[^:]*:", "")).alias("v"))))
    body = F.regexp_replace(F.regexp_replace("t", r"(?s)\A---\r?\n.*?\r?\n---\r?\n", ""), r"(?s)\n-{3,}\s*\n+\s*(?:Source|来源)[:：].*\z", "")
    return text.select("path", meta.alias("meta"), strip(body).alias("body"))


def parquet_slice(df: DataFrame, row_id: str, start: int, end: int) -> DataFrame:
    """Rows start to end - 1 in the order of an explicit id; files have no order of their own."""
    return df.where((F.col(row_id) >= start) & (F.col(row_id) < end))


def conversations(df: DataFrame, longest: int = 12_000) -> DataFrame:
    """(conv_id, prompt, response): the first user turn and the next assistant turn after it; tool calls must be JSON objects."""
    user = df.where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("u"))
    after = df.where("role = 'assistant'").join(user, "conv_id").where("turn > u").groupBy("conv_id", "u").agg(F.min("turn").alias("a"))
    text = lambda name, turn: df.select("conv_id", F.col("turn").alias(turn), F.col("text").alias(name))
    rows = after.join(text("prompt", "u"), ["conv_id", "u"]).join(text("response", "a"), ["conv_id", "a"])
    calls = F.regexp_extract_all("response", F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), 1)
    sound = F.forall(calls, lambda c: F.get_json_object(c, "$").isNotNull() & F.trim(c).startswith("{"))
    return rows.where(sound & (F.char_length("response") <= longest)).select("conv_id", "prompt", "response")


def sitemap_urls(xml: Column) -> Column:
    """Locations in a sitemap or a sitemap index."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


#: How files of a kind begin.
MAGIC = {"pdf": b"%PDF", "docx": b"PK\x03\x04", "xlsx": b"PK\x03\x04", "pptx": b"PK\x03\x04"}


def office_text(kind: str, content: bytes, longest: int = 2_000_000) -> str | None:
    """The text of a docx, xlsx, pptx or pdf file; None for other kinds, or if the file isn't what its name says or is broken."""
    if kind not in MAGIC or not content.startswith(MAGIC[kind]):
        return None
    try:
        return re.sub(r"\n{2,}", "\n", pdf_text(content) if kind == "pdf" else _xml_text(kind, content, longest)).strip()[:longest]
    except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, ValueError, EOFError, RuntimeError, NotImplementedError):
        return None


def _xml_text(kind: str, content: bytes, longest: int) -> str:
    out, size = [], 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        want = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "xlsx": r"xl/(?:sharedStrings|worksheets/sheet\d+)\.xml"}[kind]
        for name in sorted(n for n in z.namelist() if re.fullmatch(want, n)):
            for e in ElementTree.fromstring(z.read(name)).iter():
                tag = e.tag.rpartition("}")[2]
                if tag in ("t", "v") and e.text and size < longest:
                    out.append(e.text)
                    size += len(e.text)
                elif tag in ("p", "row", "si"):
                    out.append("\n")
    return "".join(out)


SHOWN = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|\b(?:Tj|TJ|Td|TD|T\*|ET)\b|'|\"", re.S)


def pdf_text(content: bytes) -> str:
    """What a PDF's pages show, where streams are plain or deflated and fonts have one-byte codes: strings in the order of their operators, a line for each move."""
    if b"%%EOF" not in content[-1024:]:
        raise ValueError("the file ends early")
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        head = content[max(0, m.start() - 300) : m.start()].rpartition(b"obj")[2]
        body = m.group(1)
        if b"FlateDecode" in head:  # a stream ends by itself, and its last byte may be one that also ends lines
            unpack = zlib.decompressobj()
            body = unpack.decompress(content[m.start(1) : m.end()])
            if not unpack.eof:
                raise ValueError("a stream ends early")
        if b"BT" not in body:
            continue
        held: list[str] = []
        for t in SHOWN.findall(body):
            if t[:1] == b"(":
                held.append(re.sub(rb"\\(.)", lambda x: {b"n": b"\n", b"r": b"", b"t": b" "}.get(x.group(1), x.group(1)), t[1:-1], flags=re.S).decode("latin-1"))
            elif t[:1] == b"<":
                digits = re.sub(rb"\s", b"", t[1:-1])
                held.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1"))
            elif t in (b"Tj", b"TJ", b"'", b'"'):
                out += held
                held = []
            else:
                out.append("\n")
                held = []
    return "".join(out)


def xlsx_rows(content: bytes) -> list[tuple[int, list[str | None]]]:
    """(row number, cells) of the first sheet; shared and inline strings resolved. Empty where the file is broken."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if si.tag.endswith("}si")] if "xl/sharedStrings.xml" in names else []
            sheet = ElementTree.fromstring(z.read(min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))))
    except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, ValueError, EOFError):
        return []
    rows = []
    for n, row in enumerate((e for e in sheet.iter() if e.tag.endswith("}row")), 1):
        cells: dict[int, str] = {}
        for c in row:
            ref = re.match(r"[A-Z]+", c.get("r", ""))
            at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(ref.group()))) - 1 if ref else len(cells)
            text = "".join(t.text or "" for t in c.iter() if t.tag.rpartition("}")[2] in ("v", "t"))
            cells[at] = shared[int(text)] if c.get("t") == "s" and text.isdigit() and int(text) < len(shared) else text
        rows.append((int(row.get("r", n)), [cells.get(i) for i in range(max(cells, default=-1) + 1)]))
    return rows


def xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_no, cells) of the first sheets of files; `header_rows` finds their header."""

    def read(batches):
        for b in batches:
            for i in range(b.num_rows):  # a sheet at a time, and its rows by thousands
                rows = xlsx_rows(b.column(1)[i].as_buffer().to_pybytes())
                for s in range(0, len(rows), 1_000):
                    n, cells = zip(*rows[s : s + 1_000])
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(n), pa.string()), pa.array(n, pa.int32()), pa.array(cells, pa.list_(pa.string()))], ["path", "row_no", "cells"])

    return map_batches(spark.read.format("binaryFile").load(path).select("path", "content"), read, "path string, row_no int, cells array<string>")


def attachments(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, bytes, sha256, magic_ok, text, reason) of files; text is null where the kind has no reader here or the file is broken, and reason says which."""
    files = spark.read.format("binaryFile").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))

    @F.pandas_udf("string")
    def text(k: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([office_text(a, bytes(b)) for a, b in zip(k, c)], dtype=object)

    ok = F.lit(False)
    for k, m in MAGIC.items():
        ok = ok | ((F.col("kind") == k) & (F.substring("content", 1, 4) == F.lit(bytearray(m))))
    rows = files.select("path", kind.alias("kind"), "content")
    return rows.select("path", "kind", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), ok.alias("magic_ok"), text("kind", "content").alias("text")).withColumn(
        "reason", F.when(~F.col("kind").isin(*MAGIC), "NO_READER").when(~F.col("magic_ok"), "WRONG_KIND").when(F.col("text").isNull(), "BROKEN")
    )


def header_rows(rows: DataFrame, order: str, cells: str, key: str, by: str | None = None) -> DataFrame:
    """Rows of cells below the first row that holds `key`, as maps by its names; blank rows go. With `by`, each sheet has a header of its own. It is found by its place, not by a scan on the driver."""
    first = [F.min_by(cells, order).alias("names"), F.min(order).alias("at")]
    found = rows.where(F.array_contains(cells, key))
    head = found.groupBy(by).agg(*first) if by else F.broadcast(found.agg(*first))  # one row without `by`
    body = (rows.join(head, by) if by else rows.join(head)).where((F.col(order) > F.col("at")) & F.exists(cells, lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
    return body.select(order, F.map_from_arrays("names", F.transform("names", lambda n, i: F.get(F.col(cells), i))).alias("row"))


def replay(rows: DataFrame, key: str, seq: str, success: str) -> DataFrame:
    """The last record of each key, but a failure never takes the place of a success."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(success, seq)).alias("r")).select("r.*")


def verify_bundle(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, fault): manifest entries that are missing or whose digest differs; no row if the bundle is whole."""
    rows = manifest.select("path", F.col("sha256").alias("wanted")).join(files.select("path", "sha256"), "path", "left")
    return rows.select("path", F.when(F.col("sha256").isNull(), "MISSING").when(F.col("sha256") != F.col("wanted"), "CHANGED").alias("fault")).where("fault is not null")


class PagedReader(DataSourceReader):
    """Reads a dataset page by page, one page to a partition; `fetch(offset, limit)` gives the rows of a page."""

    def __init__(self, options: dict, fetch: Callable[[int, int], Iterator[tuple]]):
        self.total, self.size, self.fetch, self.tries = int(options["total"]), int(options.get("page_size", 100)), fetch, int(options.get("tries", 3))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(0, self.total, self.size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for left in reversed(range(self.tries)):
            try:
                rows = list(self.fetch(partition.value, min(self.size, self.total - partition.value)))
                break
            except OSError:
                if not left:
                    raise
        yield from rows


def paged_source(name: str, columns: str, fetch: Callable[[int, int], Iterator[tuple]]) -> type[DataSource]:
    """A data source to register with Spark: `spark.read.format(name).option("total", n)`. A page that fails is fetched again, `tries` times in all; executors fetch, not the driver."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return PagedReader(self.options, fetch)

    return Paged
