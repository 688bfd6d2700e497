"""Vector code compression: product codes whose nearest entries are found through a VA-file.

Vectors become integers and are cut into equal parts; each part position has a codebook. The entries of a codebook are quantised, a few bits a coordinate, into
cells. A part makes one table for each of its coordinates with the least and the greatest squared distance to every cell; summed over an entry's cells they bound
its distance from both sides. Only entries whose lower bound doesn't exceed the least upper bound are refined, with integer distances. Sums and counts of
a round are added up where the rows lie, so that what travels is as small as the codebooks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, sound_vectors, spread_join, table

#: Parts that are looked up at a time: tables and bounds of so many are held at once.
STEP = 4_096


class VaFile:
    """The entries of one codebook as cells, and the search for the nearest of them."""

    def __init__(self, entries: np.ndarray, bits: int = 3):
        self.entries = entries.astype(np.int64)
        low, high = self.entries.min(0), self.entries.max(0)
        step = np.maximum(1, -(-(high - low + 1) // (1 << bits)))  # integers of a cell, by coordinate
        self.cells = (self.entries - low) // step
        self.low = low[:, None] + step[:, None] * np.arange(1 << bits)[None]
        self.high = self.low + step[:, None] - 1

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper): bounds of the squared distance between each part and each entry, from the tables of the part."""
        lower = np.zeros((len(x), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for d in range(x.shape[1]):
            below, above = self.low[d][None] - x[:, d, None], x[:, d, None] - self.high[d][None]
            least, most = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))
            at = self.cells[:, d]
            lower += (least * least)[:, at]
            upper += (most * most)[:, at]
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of each part's nearest entry, ties to the lower index, and how many entries were refined."""
        index, error, refined = np.empty(len(x), np.int64), np.empty(len(x), np.int64), 0
        for s in range(0, len(x), STEP):
            part = x[s : s + STEP]
            lower, upper = self.bounds(part)
            row, entry = np.nonzero(lower <= upper.min(1)[:, None])
            apart = part[row] - self.entries[entry]
            distance = np.full(lower.shape, np.iinfo(np.int64).max)
            distance[row, entry] = (apart * apart).sum(1)
            index[s : s + STEP] = distance.argmin(1)
            error[s : s + STEP] = distance.min(1)
            refined += len(row)
        return index, error, refined


def integers(column: pa.Array, dim: int, scale: int, parts: int) -> np.ndarray:
    """(rows, parts, width): the floors of the scaled components, filled up with zeros to equal parts."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) * scale).astype(np.int64)
    width = -(-dim // parts)
    if width * parts > dim:
        x = np.concatenate((x, np.zeros((len(x), width * parts - dim), np.int64)), 1)
    return x.reshape(len(x), parts, width)


def train(rows: DataFrame, dim: int, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> np.ndarray:
    """(parts, entries, width): the codebooks after `rounds` rounds over all (id, vec) rows, begun with those of the least ids."""
    first = rows.select("id", "vec").orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).toArrow()
    books = integers(first.column("vec").combine_chunks(), dim, scale, parts).transpose(1, 0, 2).copy()
    width, per = books.shape[2], books.shape[1]

    for _ in range(rounds):
        files = [VaFile(b) for b in books]

        def add(batches):
            sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for b in batches:
                if b.num_rows:
                    x = integers(b.column(0), dim, scale, parts)
                    for p, f in enumerate(files):
                        index = f.nearest(x[:, p])[0]
                        counts[p] += np.bincount(index, minlength=per)
                        for d in range(width):  # doubles hold a batch's sums exactly
                            sums[p, :, d] += np.bincount(index, x[:, p, d], per).astype(np.int64)
            at = np.nonzero(counts.ravel())[0]
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "n": pa.array(counts.ravel()[at]), "s": pa.array(list(sums.reshape(-1, width)[at]), pa.list_(pa.int64()))})

        got = map_arrow(rows.select("vec"), add, "at int, n long, s array<long>").groupBy("at")
        for r in got.agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i].cast("decimal(20, 0)")).alias(f"s{i}") for i in range(width)]).collect():
            books[r["at"] // per, r["at"] % per] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return books


def compress(df: DataFrame, id_col: str, label_col: str, vec_col: str, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error), and the codebooks: the indexes of a vector's nearest entries, two hexadecimal digits each, and their squared distances' sum.

    Vectors that are null, empty, hold null or non-finite components, or are of another length than most (of lengths met alike: the shortest) get no row. A length that
    `parts` doesn't divide is filled up with zeros. Fewer vectors than entries give smaller codebooks; null ids come last among them; rows of one id follow the order of
    their vectors, and each has a row of its own. An empty table gives no rows and empty codebooks. `entries` is 256 at most. Scaled components of 2**27 or
    more are refused with a ValueError, since errors would leave the range of a long. Columns besides play no part.
    """
    rows, dim, _, most = sound_vectors(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").alias("vec")))
    kind = f"id {df.schema[id_col].dataType.simpleString()}, label {df.schema[label_col].dataType.simpleString()}, code string, error long"
    if not dim:
        return df.sparkSession.createDataFrame([], kind), np.zeros((parts, 0, 0), np.int64)
    if most * scale >= 1 << 27:
        raise ValueError("components are too large for errors that fit in a long")
    rows = cut(rows)  # read once a round
    books = train(rows, dim, parts, entries, rounds, scale)
    files = [VaFile(b) for b in books]
    digits = np.array([f"{i:02x}" for i in range(256)])

    def encode(batches):
        for b in batches:
            if b.num_rows:
                x, code, error = integers(b.column(2), dim, scale, parts), np.full(b.num_rows, "", object), np.zeros(b.num_rows, np.int64)
                for p, f in enumerate(files):
                    index, distance, _ = f.nearest(x[:, p])
                    code += digits[index].astype(object)
                    error += distance
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return map_arrow(rows.select("id", "label", "vec"), encode, kind), books


def op12_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the whole `embeddings` in 8 parts, 16 entries each, after 6 rounds; errors by row and by label.

    Vectors that are null or hold null or non-finite components get no row; null labels are summed together; a frequent label is dealt to many tasks; very long texts don't
    occur. Otherwise as `compress` states.
    """
    codes, books = compress(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    codes = cut(codes)
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = spread_join(codes, totals, "label", "n", F.xxhash64("id", "code"))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds written out: every part against every entry of its codebook."""
    out = """with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select vec_id, label, p, v[p * 8 + 1 : p * 8 + 8] x from kept, range(8) t(p)),
seeds as (select vec_id, row_number() over (order by vec_id) - 1 e from kept order by vec_id limit 16),
b0 as materialized (select p, e, x c from parts join seeds using (vec_id))"""
    for r in range(7):
        out += f""",
d{r} as (select vec_id, p, e, list_sum(list_transform(range(1, 9), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::bigint d from parts join b{r} using (p)),
a{r} as materialized (select vec_id, p, e, d from d{r} qualify row_number() over (partition by vec_id, p order by d, e) = 1)"""
        if r < 6:
            out += f""",
s{r} as (select p, e, i, sum(x[i])::bigint s, count(*) n from a{r} join parts using (vec_id, p), range(1, 9) t(i) group by all),
m{r} as (select p, e, list((s - ((s % n) + n) % n) // n order by i) c from s{r} group by all),
b{r + 1} as materialized (select p, e, coalesce(m{r}.c, b{r}.c) c from b{r} left join m{r} using (p, e))"""
    return out + """,
books as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) h from b6),
codes as (select vec_id, string_agg(printf('%02x', e), '' order by p) code, sum(d)::bigint error from a6 group by vec_id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, h codebooks_sha256 from codes join kept using (vec_id), books"""


SQL = _sql()
