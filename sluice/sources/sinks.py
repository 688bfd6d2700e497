"""Writers of canonical files, manifests and versioned bundles."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_json(df: DataFrame) -> Column:
    """Compact JSON with keys in order."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    df.orderBy(*order).select(canonical_json(df).alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """A header and quoted fields, white space at their ends kept; nulls are nothing, and empty texts are quoted."""
    writer = df.select(*fields).write.option("header", True).option("escape", '"').option("charToEscapeQuoteEscaping", '"')  # else a zero character beside quotes goes
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes, lines) of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    lines = F.length(F.regexp_replace(F.decode("content", "UTF-8"), "[^\n]", ""))
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"), lines.cast("long").alias("lines"))


def write_atomic(spark: SparkSession, path: str, text: str) -> None:
    """A small file that others see whole, old or new: it is written beside its place and then renamed over it."""
    jvm = spark._jvm
    names = jvm.org.apache.hadoop.fs
    to, beside = names.Path(path), names.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = beside.getFileSystem(conf).create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(names.Options.Rename, 1)
    over[0] = names.Options.Rename.OVERWRITE
    names.FileContext.getFileContext(beside.toUri(), conf).rename(beside, to, over)


def publish(spark: SparkSession, df: DataFrame, base: str, version: str) -> None:
    """Write a version beside the others, and make it the one that is served when it is whole; a failure leaves the old one in place. Any session sees it by `served`."""
    df.write.parquet(f"{base}/{version}")
    write_atomic(spark, f"{base}/current.json", json.dumps({"version": version}))


def served(spark: SparkSession, base: str) -> DataFrame:
    """The version that is served now."""
    version = json.loads(spark.read.text(f"{base}/current.json", wholetext=True).first()[0])["version"]
    return spark.read.parquet(f"{base}/{version}")


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2026, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + body)
    return out.getvalue()


#: Names that office files are made of.
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MAIN = {"docx": ("word/document.xml", "wordprocessingml.document"), "xlsx": ("xl/workbook.xml", "spreadsheetml.sheet"), "pptx": ("ppt/presentation.xml", "presentationml.presentation")}
NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def office_file(kind: str, rows: list[list[str]]) -> bytes:
    """A docx (a paragraph for each row), an xlsx (a row of cells), a pptx (a line) or a pdf (a line, in Latin-1) of rows of strings."""
    clean = [[escape(NOT_XML.sub("", c or "")) for c in row] for row in rows]
    if kind == "pdf":
        return _pdf([" ".join(c or "" for c in row) for row in rows])
    main, name = MAIN[kind]
    schema = {"docx": "wordprocessingml", "xlsx": "spreadsheetml", "pptx": "presentationml"}[kind]
    ns = f"http://schemas.openxmlformats.org/{schema}/2006/main"
    extra = {"xlsx": ("xl/worksheets/sheet1.xml", "spreadsheetml.worksheet", "worksheet"), "pptx": ("ppt/slides/slide1.xml", "presentationml.slide", "slide")}.get(kind)
    types = f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/{main}" ContentType="application/vnd.openxmlformats-officedocument.{name}.main+xml"/>'
    types += (f'<Override PartName="/{extra[0]}" ContentType="application/vnd.openxmlformats-officedocument.{extra[1]}+xml"/>' if extra else "") + "</Types>"
    relation = lambda to, what: f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{OFFICE}/{what}" Target="{to}"/></Relationships>'
    parts = {"[Content_Types].xml": types, "_rels/.rels": relation(main, "officeDocument")}
    if kind == "docx":
        parts[main] = f'<w:document xmlns:w="{ns}"><w:body>' + "".join('<w:p><w:r><w:t xml:space="preserve">' + " ".join(row) + "</w:t></w:r></w:p>" for row in clean) + "</w:body></w:document>"
        return _zip(parts)
    folder, _, file = main.partition("/")
    parts[f"{folder}/_rels/{file}.rels"] = relation(extra[0].partition("/")[2], extra[2])
    if kind == "xlsx":
        parts[main] = f'<workbook xmlns="{ns}" xmlns:r="{OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>'
        cells = lambda n, row: "".join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t xml:space="preserve">{c}</t></is></c>' for i, c in enumerate(row))
        parts[extra[0]] = f'<worksheet xmlns="{ns}"><sheetData>' + "".join(f'<row r="{n}">{cells(n, row)}</row>' for n, row in enumerate(clean, 1)) + "</sheetData></worksheet>"
    else:
        art = "http://schemas.openxmlformats.org/drawingml/2006/main"
        parts[main] = f'<p:presentation xmlns:p="{ns}" xmlns:r="{OFFICE}"><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>'
        parts[extra[0]] = f'<p:sld xmlns:p="{ns}" xmlns:a="{art}"><p:cSld><p:spTree><p:sp><p:txBody>' + "".join("<a:p><a:r><a:t>" + " ".join(row) + "</a:t></a:r></a:p>" for row in clean) + "</p:txBody></p:sp></p:spTree></p:cSld></p:sld>"
    return _zip(parts)


def _pdf(lines: list[str]) -> bytes:
    shown = b"".join(b"(" + re.sub(rb"([()\\])", rb"\\\1", NOT_XML.sub("", x).replace("\n", " ").encode("latin-1", "replace")) + b") Tj 0 -14 Td\n" for x in lines)
    body = zlib.compress(b"BT /F1 11 Tf 50 780 Td\n" + shown + b"ET")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(body) + body + b"\nendstream", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    out, at = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n" % i + o + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at) + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(at) + 1, start)
    return bytes(out)


def changed_file(kind: str, content: bytes, old: str, new: str) -> bytes:
    """An office file with a string of its text parts replaced; all else stays. A pdf can't be changed so, and is refused."""
    if kind not in MAIN:
        raise ValueError(f"a {kind} file can't be changed")
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for item in z.infolist():
            body = z.read(item)
            w.writestr(item, body.replace(escape(old).encode(), escape(new).encode()) if re.match(r"(?:word/document|ppt/slides/slide|xl/(?:sharedStrings|worksheets/sheet))", item.filename) else body)
    return out.getvalue()


def write_files(df: DataFrame, path: str, name: str, content: str) -> DataFrame:
    """(name, bytes) of the files that were written below a path, one for each row; what a lost task has written is written again under the same name."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        for b in batches:
            names, bodies = b.column(0).to_pylist(), b.column(1)
            for n, body in zip(names, bodies):
                with fs.open_output_stream(f"{root}/{n}", compression=None) as f:
                    f.write(body.as_buffer())
            yield pa.RecordBatch.from_pydict({"name": names, "bytes": pa.array([len(x.as_buffer()) for x in bodies], pa.int64())})

    return df.select(name, content).mapInArrow(write, "name string, bytes long")


def markdown_card(title: Column, meta: list[tuple[str, Column]], body: Column) -> Column:
    lines = [F.concat(F.lit(f"- {name}: "), F.coalesce(c.cast("string"), F.lit(""))) for name, c in meta]
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), *lines, F.lit(""), body)


def ics(df: DataFrame, by: str, uid: Column, summary: Column, day: Column) -> DataFrame:
    """(by, ics): a calendar of all-day entries, in the order of days and ids."""
    event = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(day, "yyyyMMdd")), F.concat(F.lit("SUMMARY:"), F.regexp_replace(summary, r"([,;\\])", r"\\$1")), F.lit("END:VEVENT"))
    rows = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(day.alias("d"), uid.cast("string").alias("u"), event.alias("e")))).alias("es"))
    return rows.select(by, F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.array_join(F.transform("es", lambda x: x["e"]), "\r\n"), F.lit("END:VCALENDAR"), F.lit("")).alias("ics"))
