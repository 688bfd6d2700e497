"""WARC archives as a chunked record table.

Payloads travel as rows of record, chunk number and at most `chunk` bytes, on the way into archives and out of them, so
that no worker allocates a whole record. The reader carries a running SHA-256 from chunk to chunk; the last row of a record bears the
digest of its whole payload, which must be the one that its header states.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, parts, remove, shared_dir, table

CHUNK = 1 << 18
#: WARC-Date of what is written, fixed so that runs give the same bytes.
DATE = "2026-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNKS = "row long, page_id long, url string, n long, digest string, chunk_no int, chunk binary"
TABLE = "page_id long, url string, record_id string, record_type string, refers_to long, chunk_no int, chunk binary, bytes_so_far long, digest_so_far string, is_last boolean, payload_bytes long, payload_digest string"


def _urn(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def _header(r: dict) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if r['refers_to'] is not None else 'response'}", f"WARC-Record-ID: {_urn(r['page_id'], r['digest'])}", f"WARC-Date: {DATE}"]
    if r["url"] is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in r["url"]))
    if r["refers_to"] is not None:
        lines += [f"WARC-Refers-To: {_urn(r['refers_to'], r['digest'])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {r['refers_to']}"]
    if r["page_id"] is not None:
        lines.append(f"X-Page: {r['page_id']}")
    size = len(HTTP) + (r["n"] if r["refers_to"] is None else 0)
    lines += [f"WARC-Payload-Digest: sha256:{r['digest']}", f"X-Payload-Length: {r['n']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {size}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + HTTP


def chunk_rows(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """A row for each `chunk` bytes of each payload, with the digest of the whole; the payload itself is only looked at where Spark has put it."""
    names = CHUNKS.replace(",", "").split()[::2]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary())
    out, size = [], 0
    for b in batches:
        row, page, url = (b.column(i).to_pylist() for i in range(3))
        html = b.column(3).cast(pa.binary())  # the same bytes
        for j in range(b.num_rows):
            view = memoryview(html[j].as_buffer() if html[j].is_valid else b"")
            sha = hashlib.sha256()
            for s in range(0, len(view), chunk):
                sha.update(view[s : s + chunk])
            for no, s in enumerate(range(0, max(1, len(view)), chunk)):
                piece = bytes(view[s : s + chunk])
                out.append((row[j], page[j], url[j], len(view), sha.hexdigest(), no, piece))
                size += len(piece) + 200
                if size > 8 * chunk:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def write_archives(df: DataFrame, where: str, chunk: int = CHUNK, smallest: int = 100, largest: int = 1 << 30, part: int = 1 << 26) -> DataFrame:
    """Write a record per row of (page_id, url, html) to archives in the folder `where`; the manifest (path, start, bytes, records), a row for each part of an archive.

    Of records with equal payloads of `smallest` bytes or more, the one with the least page_id (of those the one with the least url) is the response and the others are revisits of it. Null
    html is an empty payload; a null page_id counts as the largest and is never referred to, so payloads that have no other are all responses. A task goes on in a new archive when one has `largest` bytes,
    and notes a record's start after each `part` bytes, so that archives of any number are read in parts; only a record that is longer by itself makes either larger. Only
    archives in the manifest count: a task that is run again writes to another name. Columns besides, whatever their names, play no part. An empty table gives no archive.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    narrow = cut(df.where(F.octet_length("html") >= smallest).select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha2(F.col("html").cast("binary"), 256).alias("digest")))
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    again = narrow.select("page_id", "digest").join(first, "digest").where("refers_to < coalesce(page_id, 9223372036854775807)").distinct()
    again = again.select(F.coalesce("page_id", F.lit(-1)).alias("k"), F.col("digest").alias("d"), "refers_to")
    rows = map_arrow(rows, lambda batches: chunk_rows(batches, chunk), CHUNKS)
    marked = rows.join(again, (F.coalesce(rows["page_id"], F.lit(-1)) == again["k"]) & (rows["digest"] == again["d"]), "left")
    marked = marked.where("refers_to is null or chunk_no = 0").select("row", "page_id", "url", "n", "digest", "refers_to", "chunk_no", "chunk")
    # repeated rows of the page that the others refer to: what is equal is counted, and one of the copies is the response
    ties = cut(narrow.groupBy("page_id", "digest").agg(F.count("*").alias("c"), F.min("url").alias("least")).where("c > 1 and page_id is not null").join(first.withColumnRenamed("refers_to", "page_id"), ["page_id", "digest"], "left_semi"))
    if ties.take(1):
        one = ties.select("page_id", "digest")
        copies = rows.join(ties, ["page_id", "digest"]).groupBy("page_id", "digest", "url", "chunk_no").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("chunk").alias("chunk"), F.count("*").alias("c"), F.first("least").alias("least"))
        own = F.col("url").eqNullSafe(F.col("least"))
        names = ["row", "page_id", "url", "n", "digest", "refers_to", "chunk_no", "chunk"]
        response = copies.where(own).withColumn("refers_to", F.lit(None).cast("long")).select(*names)
        left = F.col("c") - own.cast("int")
        revisit = copies.where("chunk_no = 0").where(left > 0).withColumn("refers_to", F.col("page_id")).withColumn("copy", F.explode(F.sequence(F.lit(1), left))).withColumn("row", F.lit(-1).cast("long")).select(*names)  # not between the chunks of another
        marked = marked.join(one, ["page_id", "digest"], "left_anti").select(*names).unionByName(response).unionByName(revisit)
    rows = marked.sortWithinPartitions("page_id", "row", "chunk_no")

    def write(batches: Iterator[pa.RecordBatch]):
        fs, path = pafs.FileSystem.from_uri(where)
        t = TaskContext.get()
        stem, archives = f"{path}/part-{t.partitionId():05d}-{t.attemptNumber()}-{uuid.uuid4().hex}", 0
        out, z, name, start, records, made = None, None, "", 0, 0, []

        def end():
            nonlocal z
            if z is not None:
                out.write(z.compress(b"\r\n\r\n") + z.flush())
                z = None

        def note():
            nonlocal start, records
            if records:
                made.append((name, start, out.tell() - start, records))
            start, records = out.tell(), 0

        for b in batches:
            for r in b.to_pylist():
                if r["chunk_no"] == 0:
                    if out is not None:
                        end()
                        if out.tell() - start >= part:
                            note()
                        if out.tell() >= largest:
                            note()
                            out.close()
                            out = None
                    if out is None:
                        fs.create_dir(path, recursive=True)
                        name, archives, start = f"{stem}-{archives:05d}.warc.gz", archives + 1, 0
                        out = fs.open_output_stream(name, compression=None)
                    z, records = zlib.compressobj(3, zlib.DEFLATED, 31), records + 1
                    out.write(z.compress(_header(r)))
                if r["refers_to"] is None:
                    out.write(z.compress(r["chunk"]))
        if out is not None:
            end()
            note()
            out.close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], ["path", "start", "bytes", "records"])

    return cut(map_arrow(rows, write, "path string, start long, bytes long, records long"))


class _Part:
    """`size` bytes of a file from `start` on, as a stream."""

    def __init__(self, file, start: int, size: int):
        self.file, self.left = file, size
        file.seek(start)

    def read(self, n: int) -> bytes:
        got = self.file.read(min(n, self.left))
        self.left -= len(got)
        return got


class _Members:
    """The bytes of a file of gzip members, a bounded piece at a time."""

    def __init__(self, stream, piece: int):
        self.stream, self.piece, self.z, self.raw, self.have = stream, piece, zlib.decompressobj(31), b"", bytearray()

    def fill(self) -> bool:
        while True:
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            self.raw = self.raw or self.stream.read(self.piece)
            ended = not self.raw
            got = self.z.decompress(self.raw, self.piece)  # what it holds back comes with an empty input too
            self.raw = self.z.unconsumed_tail
            if got:
                self.have += got
                return True
            if ended:
                return False

    def until(self, mark: bytes) -> bytes | None:
        """Up to and without `mark`; None at the end of the file."""
        while (at := self.have.find(mark)) < 0:
            if not self.fill():
                if self.have:
                    raise ValueError("an archive ends within a record")
                return None
        out = bytes(self.have[:at])
        del self.have[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.have) < n:
            if not self.fill():
                raise ValueError("an archive ends within a record")
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


def records(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """The rows of the chunked record table that one archive gives."""
    src = _Members(stream, chunk)
    while (head := src.until(b"\r\n\r\n")) is not None:
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        left = int(h["content-length"])
        left -= len(src.until(b"\r\n\r\n")) + 4
        row = {"page_id": int(h["x-page"]) if "x-page" in h else None, "url": h.get("warc-target-uri"), "record_id": h["warc-record-id"], "record_type": h["warc-type"]}
        row |= {"refers_to": int(h["x-refers-to-page"]) if "x-refers-to-page" in h else None, "payload_bytes": int(h["x-payload-length"]), "payload_digest": h["warc-payload-digest"].partition(":")[2]}
        sha, so_far, no = hashlib.sha256(), 0, 0
        while True:
            piece = src.take(min(chunk, left))
            left -= len(piece)
            so_far += len(piece)
            sha.update(piece)
            if not left and row["record_type"] == "response" and (so_far, sha.hexdigest()) != (row["payload_bytes"], row["payload_digest"]):
                raise ValueError(f"{row['record_id']} isn't what its header states")
            yield row | {"chunk_no": no, "chunk": piece, "bytes_so_far": so_far, "digest_so_far": sha.copy().hexdigest(), "is_last": not left}
            no += 1
            if not left:
                break
        src.take(4)


def read_archives(manifest: DataFrame, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunked record table of the archives in a manifest, each part read by itself. Without `payloads`, chunk is null; digests still cover every byte."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("is_last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    uri = shared_dir(manifest.sparkSession)

    def read(batches):
        fs = pafs.FileSystem.from_uri(uri)[0]
        for b in batches:
            for path, start, size in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_input_file(path) as file:
                    rows, held = [], 0
                    for r in records(_Part(file, start, size), chunk):
                        held += len(r["chunk"])
                        rows.append(r if payloads else r | {"chunk": None})
                        if held > 8 * chunk or len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return map_arrow(manifest.select("path", "start", "bytes").repartition(parts(manifest), "path", "start"), read, TABLE)


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of the whole `pages`, written to the shared folder and read back. No SQL: it writes and parses files; tests compare it with reading the table.
    Null and empty html are payloads of no bytes; of equal payloads the least page_id is the response; repeated rows are records of
    their own, one of which is the response; very long html travels in chunks; an empty table gives no rows.
    """
    where = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = read_archives(write_archives(table(spark, sf_dir, "pages"), where), payloads=False).where("is_last")
    whole = F.col("record_type") == "response"
    out = rows.select(
        "page_id", F.when(whole, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(whole, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )
    out = cut(out)
    remove(spark, where)
    return out
