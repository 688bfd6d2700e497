"""Sharding by histogram sort.

Keys are 128 bits wide: the XXH64 of the grouping column, then the row's id, so that equal texts lie together and no
two rows tie. Rounds of probes narrow an interval around each wanted splitter: every partition counts the bytes and rows between
probes, the counts are summed, and the driver, which only ever holds a few numbers for each splitter, places the next
probes. When all splitters meet the tolerance, or no key lies inside their interval, one exchange deals the rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, map_arrow, table

SPAN = 1 << 128


def _keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Big-endian 16-byte keys in the order of (high, low), both signed."""
    out = np.empty((len(high), 2), ">u8")
    for i, x in enumerate((high, low)):
        out[:, i] = x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view("S16").reshape(-1)


def _wide(points: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(p.to_bytes(16, "big") for p in points), "S16")


def _below(points: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many of the sorted points are at or below each key."""
    return np.searchsorted(points, keys, "right")


def _count(narrow: DataFrame, points: list[int]) -> tuple[list[int], list[int]]:
    """Bytes and rows below each of the sorted points, in one pass."""
    wide = _wide(points).tobytes()

    def partial(batches):
        p = np.frombuffer(wide, "S16")
        size, rows = np.zeros(len(p) + 1, np.int64), np.zeros(len(p) + 1, np.int64)
        for b in batches:
            at = _below(p, _keys(b.column(0).to_numpy(), b.column(1).to_numpy()))
            np.add.at(size, at, b.column(2).to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        full = np.nonzero(rows)[0]
        yield pa.RecordBatch.from_pydict({"at": pa.array(full.astype(np.int32)), "size": pa.array(size[full]), "n": pa.array(rows[full])})

    got = map_arrow(narrow.select("_h", "_id", "_size"), partial, "at int, size long, n long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    size, rows = [0] * (len(points) + 1), [0] * (len(points) + 1)
    for r in got:
        size[r["at"]], rows[r["at"]] = r["size"], r["n"]
    return list(np.cumsum(np.array(size, object)))[:-1], list(np.cumsum(np.array(rows, object)))[:-1]


def splitters(narrow: DataFrame, targets: list[int], total: int, rows: int, tolerance: float, probes: int = 16, max_rounds: int = 140) -> list[tuple[int, int, int]]:
    """(key, bytes below, rows below) for each of the ascending byte targets.

    A splitter is done when it is within `tolerance` bytes of its target, or when its interval holds one row at most: then the nearer side
    is taken and no key could be nearer.
    """
    state = [[0, 0, 0, SPAN, total, rows] for _ in targets]  # key, bytes and rows at or below the target; the same above it
    done: list[tuple[int, int, int] | None] = [None] * len(targets)
    for _ in range(max_rounds):
        for i, (lo, lb, lr, hi, hb, hr) in enumerate(state):
            if done[i] is None:
                near = min(((abs(b - targets[i]), k, b, r) for k, b, r in ((lo, lb, lr), (hi, hb, hr))), key=lambda x: (x[0], x[1]))
                if near[0] <= tolerance or hr - lr <= 1 or hi - lo <= 1:
                    done[i] = near[1:]
        if None not in done:
            break
        points = set()
        for i, (lo, lb, _, hi, hb, _) in enumerate(state):
            if done[i] is None:
                n = min(probes, hi - lo - 1)
                points.update(lo + (hi - lo) * (j + 1) // (n + 1) for j in range(n))
                guess = lo + (hi - lo) * (targets[i] - lb) // max(1, hb - lb)  # keys are hashes: their bytes rise evenly
                step = max(1, (hi - lo) >> 8)
                points.update(p for p in (guess - step, guess, guess + step) if lo < p < hi)
        points = sorted(points)
        size, n = _count(narrow, points)
        for i, s in enumerate(state):
            if done[i] is None:  # points and the bytes below them both ascend
                first, last = bisect.bisect_right(points, s[0]), bisect.bisect_left(points, s[3])
                at = bisect.bisect_right(size, targets[i], first, last)
                if at < last:
                    s[3], s[4], s[5] = points[at], size[at], n[at]
                if at > first:
                    s[0], s[1], s[2] = points[at - 1], size[at - 1], n[at - 1]
    return [x if x is not None else (s[0], s[1], s[2]) for x, s in zip(done, state)]


def histogram_shards(
    df: DataFrame, shards: int, row_id: Column, group: Column, size: Column, tolerance: float = 0.002, probes: int = 16, rows_per_task: int = 2_000_000, keep: list[str] | None = None
) -> DataFrame:
    """`df` with shard (0 to `shards` - 1) and slot (gapless from 0 in each shard); shards hold near-equal sums of `size`.

    row_id is a long that tells rows apart, group the value whose equal rows shall lie together, size a long of 0 or more. Nulls are groups or
    ids like others (a null id counts as -1; rows with one id and one group tie, and are then kept together). An empty table gives no rows.
    tolerance is a share of a mean shard; beyond it, shards differ by no more than one row, or by the rows that tie. `keep` names the columns to carry.
    """
    keep = df.columns if keep is None else keep
    narrow = df.select(*[F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(keep)], F.xxhash64(group).alias("_h"), F.coalesce(row_id.cast("long"), F.lit(-1)).alias("_id"), size.cast("long").alias("_size"))
    narrow = cut(narrow)
    total, rows = narrow.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-rows // (shards * rows_per_task)))  # sub-shards keep tasks small where shards are few
    cuts = shards * parts
    targets = [total * i // cuts for i in range(1, cuts)]
    found = splitters(narrow, targets, total, rows, tolerance * total / shards, probes) if rows and cuts > 1 else []
    wide = _wide([min(k, SPAN - 1) for k, _, _ in found]).tobytes()
    shut = [i for i, (k, _, _) in enumerate(found) if k >= SPAN]  # nothing lies beyond these
    opens = len(found) - len(shut)
    before = np.array([0] + [r for _, _, r in found], np.int64)
    offset = before[np.arange(cuts)] - before[np.arange(cuts) // parts * parts] if found else np.zeros(cuts, np.int64)

    def deal(batches):
        p = np.frombuffer(wide, "S16")[:opens]
        for b in batches:
            names = b.schema.names
            at = _below(p, _keys(b.column(names.index("_h")).to_numpy(), b.column(names.index("_id")).to_numpy())).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(offset[at])], [*names, "_at", "_offset"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema)
    dealt = map_arrow(narrow, deal, f"{types}, _at int, _offset long")
    rank = F.row_number().over(W.partitionBy("_at").orderBy("_h", "_id")) - 1
    return dealt.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], (F.col("_at") / parts).cast("int").alias("shard"), (rank + F.col("_offset")).cast("long").alias("slot"))


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`histogram_shards` of the whole `documents` into 40 shards of near-equal bytes. No SQL: splitters come from rounds of probes, and XXH64 is Spark's; tests hold the law of bytes.
    Null texts have the size 16; equal texts, null ones too, lie together; repeated rows have slots of their own; a very long text is one
    row, which no shard splits; an empty table gives no rows; columns besides, whatever their names, play no part.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("text_h"))
    out = histogram_shards(rows, 40, F.col("doc_id"), F.col("text_h"), F.col("size"), keep=["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
