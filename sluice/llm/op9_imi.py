"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised apart, each by its own centroids; a pair of centroids is a cell. A query walks pairs in the
order of their summed distances, with a heap, until the cells hold the wanted share of all vectors, and what the cells hold is
ranked by exact distance. The share is learned: the true neighbours of some rows are found by brute force, and the share is the one whose
cells hold `recall` of them. Cells grow with the number of vectors, so the share falls. Vectors move once and meet queries by the
first half's centroid, in packed blocks; no pair of rows is ever emitted.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, FloatType

from .common import cut, map_arrow, parts, sample_at_most, table

#: Vectors that are packed together, queries of a block, vectors of a centroid that lie in one task.
PACK, BLOCK, VECTORS = 16_384, 256, 1 << 17
ROWS = "part long, salt long, kind int, payload binary"
TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
NAMES = ["part", "salt", "kind", "payload"]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances between rows, in double precision."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        own = distances(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def walk(a: np.ndarray, b: np.ndarray, held: np.ndarray, wanted: float) -> list[int]:
    """Cells (i * len(b) + j) by rising a[i] + b[j], until they hold `wanted` vectors; held counts each cell's."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb, la, lb = a[ia].tolist(), b[ib].tolist(), ia.tolist(), ib.tolist()
    heap, out, have, width = [(sa[0] + sb[0], 0, 0)], [], 0, len(lb)
    while heap and have < wanted:
        _, i, j = heapq.heappop(heap)
        cell = la[i] * width + lb[j]
        if held[cell]:
            out.append(cell)
            have += held[cell]
        if j + 1 < width:
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
        if not j and i + 1 < len(la):
            heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
    return out


def visited(a: np.ndarray, b: np.ndarray, held: np.ndarray, wanted: float, width: int, step: int = 16) -> np.ndarray:
    """(query, first half's centroid, bytes of bits): the cells that each query walks, `step` queries spread out at a time."""
    out = np.zeros((len(a), len(held) // width, -(-width // 8)), np.uint8)
    for s in range(0, len(a), step):
        cells = np.zeros((len(a[s : s + step]), len(held)), bool)
        for i in range(len(cells)):
            cells[i, walk(a[s + i], b[s + i], held, wanted)] = True
        out[s : s + step] = np.packbits(cells.reshape(len(cells), -1, width), axis=2)
    return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def packed(*arrays: np.ndarray) -> bytes:
    return np.array([len(arrays[0])], "<i8").tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpacked(payload: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """The arrays of `packed`, for (type, width) of each; a width of 0 is one number a row."""
    n, at, out = int(np.frombuffer(payload, "<i8", 1)[0]), 8, []
    for kind, width in kinds:
        x = np.frombuffer(payload, kind, n * max(1, width), at)
        at += x.nbytes
        out.append(x.reshape(n, width) if width else x)
    return out


def meet(rows: Iterator[tuple], dim: int, width: int, k: int, kind: str = "<f4") -> Iterator[pa.RecordBatch]:
    """The k nearest that each query finds among the vectors of a part; rows come by part and salt, vectors first."""
    at, held, ready = None, [], None
    bits = -(-width // 8)
    for part, salt, what, payload in rows:
        if (part, salt) != at:
            at, held, ready = (part, salt), [], None
        if what == 0:
            held.append(unpacked(payload, ("<i8", 0), ("<i4", 0), (kind, dim)))
            continue
        if ready is None:
            ready = [np.concatenate(x) for x in zip(*held)] if held else []
            held = []
        if not ready:
            continue
        ids, cell, vectors = ready
        qid, q, visits = unpacked(payload, ("<i8", 0), (kind, dim), ("u1", bits))
        q, visits = q.astype(np.float64), np.unpackbits(visits, axis=1)[:, :width]
        some = np.nonzero(visits.any(0)[cell])[0]  # queries of a block are alike, so that this is little more than each needs
        if not len(some):
            continue
        x, near, mask = vectors[some].astype(np.float64), ids[some], visits[:, cell[some]] == 0
        d2 = distances(q, x)
        d2[mask] = np.inf
        least = np.partition(d2, min(k, len(some) - 1), axis=1)[:, min(k, len(some) - 1)]  # one more than wanted: the query's own row may be there
        least = np.where(np.isfinite(least), least * (1 + 1e-9) + 1e-9, np.finfo(float).max)
        row, col = np.nonzero(d2 <= least[:, None])
        exact = np.sqrt(((x[col] - q[row]) ** 2).sum(1))
        other = near[col] != qid[row]
        row, col, exact = row[other], col[other], exact[other]
        order = np.lexsort((near[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        if keep.any():
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(qid[row[keep]], pa.int64()), "vec_id": pa.array(near[col[keep]], pa.int64()), "score": pa.array(exact[keep])})


def nearest_of_some(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, assign) -> DataFrame:
    """(i, cell): the cells of the k true nearest of each of a few vectors, by brute force over all rows."""
    dim = q.shape[1]

    def run(batches):
        best_d, best_c = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)
        for b in batches:
            if b.num_rows:
                v, vid = matrix(b.column(1), dim), b.column(0).to_numpy()
                d = distances(q, v)
                d[ids[:, None] == vid[None]] = np.inf
                top = np.argpartition(d, min(k, len(v)) - 1, axis=1)[:, :k]
                near, c = np.take_along_axis(d, top, 1), assign(v)[top]
                near, c = np.concatenate((best_d, near), 1), np.concatenate((best_c, c), 1)
                top = np.argpartition(near, k - 1, axis=1)[:, :k]
                best_d, best_c = np.take_along_axis(near, top, 1), np.take_along_axis(c, top, 1)
        i, j = np.nonzero(np.isfinite(best_d))
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "cell": pa.array(best_c[i, j], pa.int32()), "d": pa.array(best_d[i, j])})

    found = map_arrow(rows.select("id", "vec"), run, "i int, cell int, d double")
    return found.withColumn("r", F.row_number().over(W.partitionBy("i").orderBy("d", "cell"))).where(F.col("r") <= k).select("i", "cell")


def multi_index_search(
    df: DataFrame, id_col: str, vec_col: str, is_query, k: int = 10, cells: int | None = None, recall: float = 0.95, sample: int = 20_000, trials: int = 256, share: float | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that `is_query` (a condition on the id) holds for, by Euclidean distance.

    cells: centroids of a half; if None, 0.57 times the square root of the number of vectors, 1,024 at most, so that there is a cell for every three vectors.
    share: the part of all vectors that a query's cells must hold, 16 (k + 1) vectors at least; if None, the one that brings `recall` of the true neighbours of
    `trials` rows. sample bounds the rows that centroids are fitted on; every row is indexed. Vectors that are null, zero, of another length than most, or have
    null or non-finite components take no part. Fewer than k others: all of them. Rows that share an id are candidates of each other's queries no more than a
    row of its own. Ties go to smaller ids. Columns besides, whatever their names, play no part. An empty table gives no rows.
    """
    x, kind = F.col(f"`{vec_col}`"), "<f4" if df.schema[vec_col].dataType == ArrayType(FloatType()) else "<f8"  # vectors stay as exact as they are
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.cast("array<float>" if kind == "<f4" else "array<double>").alias("vec")).where("id is not null and vec is not null")
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = cut(rows.where(F.coalesce(fine, F.lit(False))))
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    out = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return df.sparkSession.createDataFrame([], out)
    dim, n = sizes["dim"], sizes["count"]
    half = max(1, dim // 2)
    rows = rows.where(F.size("vec") == dim)
    seen = sample_at_most(rows, "id", sample, n).orderBy("id").toArrow()
    if not seen.num_rows:
        seen = rows.limit(sample).toArrow()
    seen = seen.combine_chunks()
    seen_ids, seen = seen.column(0).to_numpy(), np.array(seen.column(1).to_pylist(), np.float64).reshape(-1, dim)
    wide = min(max(2, int(0.57 * n**0.5)) if cells is None else cells, 1024, max(2, len(seen) // 16))
    books = [centroids(seen[:, :half], wide), centroids(seen[:, half:], wide) if dim > half else np.zeros((1, 0))]
    width = len(books[1])

    def assign(v: np.ndarray) -> np.ndarray:
        return distances(v[:, :half], books[0]).argmin(1) * width + (distances(v[:, half:], books[1]).argmin(1) if width > 1 else 0)

    def tally(batches):
        held = np.zeros(len(books[0]) * width, np.int64)
        for b in batches:
            held += np.bincount(assign(matrix(b.column(0), dim)), minlength=len(held))
        full = np.nonzero(held)[0]
        yield pa.RecordBatch.from_pydict({"cell": pa.array(full, pa.int32()), "n": pa.array(held[full])})

    held = np.zeros(len(books[0]) * width, np.int64)
    for r in map_arrow(rows.select("vec"), tally, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        held[r["cell"]] = r["n"]
    groups = held.reshape(-1, width).sum(1)
    salts = np.maximum(1, -(-groups // VECTORS))
    least = 16 * (k + 1)
    wanted = least if share is None else max(share * n, least)
    if share is None and n > least:
        pick = np.random.default_rng(5).permutation(len(seen))[:trials]
        q = seen[pick]
        a, c = distances(q[:, :half], books[0]), distances(q[:, half:], books[1])
        near: dict[int, list[int]] = {}
        for r in nearest_of_some(rows, seen_ids[pick], q, k, assign).collect():
            near.setdefault(r["i"], []).append(r["cell"])
        need = []  # what lies before the cell of each true neighbour
        for i, wish in near.items():
            order = np.argsort((a[i][:, None] + c[i][None]).ravel(), kind="stable")  # as the heap would walk
            before = np.empty(len(held), np.int64)
            before[order] = np.cumsum(held[order]) - held[order]
            need += before[wish].tolist()
        wanted = max(least, float(np.quantile(need, recall)) + 1)
    asked = rows.where(is_query(F.col("id")))

    def blocks(batches):
        count, ids, v = 0, [], []

        def flush():
            nonlocal count, ids, v
            i, x = np.concatenate(ids), np.concatenate(v)
            cell = assign(x)
            group, out = cell // width, []
            order = np.argsort(group, kind="stable")
            full, starts = np.unique(group[order], return_index=True)
            for g, p in zip(full.tolist(), np.split(order, starts[1:])):
                out.append((g, count % int(salts[g]), 0, packed(i[p].astype("<i8"), (cell[p] % width).astype("<i4"), x[p].astype(kind))))
            count, ids, v = count + 1, [], []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)

        for b in batches:
            if b.num_rows:
                ids.append(b.column(0).to_numpy())
                v.append(matrix(b.column(1), dim))
                if sum(map(len, ids)) >= PACK:
                    yield from flush()
        if ids:
            yield from flush()

    def probes(batches):
        for b in batches:
            for s in range(0, b.num_rows, 4 * BLOCK):
                part = b.slice(s, 4 * BLOCK)
                ids, v = part.column(0).to_numpy(), matrix(part.column(1), dim)
                a, c = distances(v[:, :half], books[0]), distances(v[:, half:], books[1])
                order = np.argsort(c.argmin(1), kind="stable")  # neighbours in a block visit much the same cells
                ids, v, a, c = ids[order], v[order], a[order], c[order]
                for t in range(0, len(ids), BLOCK):
                    yield from ask(ids[t : t + BLOCK], v[t : t + BLOCK], a[t : t + BLOCK], c[t : t + BLOCK])

    def ask(ids: np.ndarray, v: np.ndarray, a: np.ndarray, c: np.ndarray):
        visits = visited(a, c, held, wanted, width)
        out = []
        for g in np.nonzero(visits.any((0, 2)))[0].tolist():
            p = np.nonzero(visits[:, g].any(1))[0]
            payload = packed(ids[p].astype("<i8"), v[p].astype(kind), visits[p, g])
            out += [(g, salt, 1, payload) for salt in range(int(salts[g]))]
            if len(out) >= 64:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)

    def run(batches):
        return meet((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), dim, width, k, kind)

    together = map_arrow(rows, blocks, ROWS).unionByName(map_arrow(asked, probes, ROWS))
    together = together.repartition(parts(df), "part", "salt").sortWithinPartitions("part", "salt", "kind")
    found = map_arrow(together, run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op9_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`multi_index_search` of the whole `embeddings` for the rows whose vec_id is divisible by 100. No SQL: what is found depends on the trained index; tests measure its
    recall against brute force. Vectors that are null, zero or not finite take no part, ties go to smaller ids, an empty table gives no rows.
    """
    return multi_index_search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: i % 100 == 0)
