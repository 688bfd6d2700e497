"""Best-fit packing into bins of several permitted lengths.

Pieces of one length are alike, so best fit runs on the histogram of lengths, whose size the longest permitted length bounds, and not on
documents. Longer lengths come first; a piece goes to the open bin that it leaves the least room in, else to a new bin of the size
that costs least for each piece of this length. Several rules for opening are tried on the histogram, every bin is cut down to the least permitted length that
holds its contents, and the cheapest plan is taken. Documents then find their places by their rank among equal lengths.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, map_arrow, parts, table

#: Pieces of one length that are ranked in one task, at most.
RANKED = 250_000


def cost_of(capacity: int, per_bin: float = 16.0) -> float:
    """Tokens that a sequence takes, and a fixed part for each."""
    return capacity + per_bin


def best_fit(histogram: dict[int, int], opens) -> list[list]:
    """Groups of like bins [capacity, room left, count, contents]; contents are (length, pieces of it) in the order of placing."""
    rooms: list[int] = []  # rooms left, ascending
    held: dict[int, list[list]] = {}

    def keep(capacity: int, room: int, count: int, contents: tuple):
        if room not in held:
            bisect.insort(rooms, room)
            held[room] = []
        held[room].append([capacity, count, contents])

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                capacity = opens(length, n)
                q = capacity // length
                if n // q:
                    keep(capacity, capacity - q * length, n // q, ((length, q),))
                if n % q:
                    keep(capacity, capacity - n % q * length, 1, ((length, n % q),))
                break
            room = rooms[at]
            group = held[room][-1]
            q = min(room // length, n)  # the fullest bin stays the best fit until it is too full
            bins = min(group[1], n // q)
            keep(group[0], room - q * length, bins, (*group[2], (length, q)))
            group[1] -= bins
            n -= bins * q
            if not group[1]:
                held[room].pop()
                if not held[room]:
                    del held[room], rooms[bisect.bisect_left(rooms, room)]
    return [[c, room, n, contents] for room in rooms for c, n, contents in held[room]]


def plan(histogram: dict[int, int], capacities: list[int], cost=cost_of) -> list[list]:
    """The cheapest of the plans that the rules for opening give, bins cut down to their contents: [capacity, count, contents]."""
    capacities = sorted(capacities)

    def least(length: int, n: int) -> int:
        return min((c for c in capacities if c >= length), key=lambda c: (cost(c) / min(c // length, n), -c))

    rules = [least, *(lambda length, n, c=c: c if c >= length else next(x for x in capacities if x >= length) for c in capacities)]
    best = None
    for rule in rules:
        got = []
        for c, room, n, contents in best_fit(histogram, rule):
            got.append([capacities[bisect.bisect_left(capacities, c - room)], n, contents])
        total = sum(cost(c) * n for c, n, _ in got)
        if best is None or total < best[0]:
            best = (total, got)
    return best[1] if best else []


def places(groups: list[list]) -> dict[str, np.ndarray]:
    """For ranges of ranks of each length, sorted: the first rank, bin, pieces of that length in a bin, offset in the bin, capacity."""
    rows, ranks, base = [], {}, 0
    for capacity, n, contents in groups:
        at = 0
        for length, q in contents:
            rows.append((length, ranks.get(length, 0), base, q, at, capacity))
            ranks[length] = ranks.get(length, 0) + n * q
            at += length * q
        base += n
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "first", "base", "q", "at", "capacity"))}


def pack(df: DataFrame, id_col: str, length_col: str, capacities: list[int], cost=cost_of, ranked: int | None = None) -> DataFrame:
    """(id, piece, start, length, bin_id, capacity, offset): where each piece of each row lies.

    A row longer than the longest capacity is cut into pieces of that length and a rest; no token is dropped. A row of null or no length has one row,
    whose length is 0 and whose place is null. Null ids are ids like others; repeated rows are pieces of their own. An empty table gives no rows.
    Pieces of one length are ranked `ranked` to a task, however many there are; if None, `RANKED` at most, and a quarter of a task's even share of all.
    """
    top = max(capacities)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.greatest(F.coalesce(F.col(f"`{length_col}`").cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    rows = cut(rows)
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / top).cast("int"))
    pieces = rows.select("id", "n", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    pieces = pieces.select("id", "piece", (F.col("piece").cast("long") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece").cast("long") * top).cast("int").alias("length"))
    full = pieces.where("length > 0")
    totals = {r["length"]: r["count"] for r in full.groupBy("length").count().collect()}  # a row for each length
    ranked = ranked or max(16, min(RANKED, sum(totals.values()) // (4 * parts(df))))
    hot = {length: -(-n // ranked) for length, n in totals.items() if n > ranked}
    salts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col("length")), F.lit(1)) if hot else F.lit(1)
    full = full.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), salts).cast("int"))
    tally = np.zeros((top + 1, max(hot.values(), default=1)), np.int64)
    for r in full.groupBy("length", "salt").count().collect():  # a row for each length, and one for each `ranked` pieces
        tally[r["length"], r["salt"]] = r["count"]
    table_ = places(plan(dict(sorted(totals.items())), capacities, cost))
    before = np.cumsum(tally, axis=1) - tally
    rank = F.row_number().over(W.partitionBy("length", "salt").orderBy("id", "piece")) - 1

    def place(batches):
        wide = 1 << 44
        starts = table_["length"] * wide + table_["first"]
        for b in batches:
            length, salt, r = (b.column(i).to_numpy().astype(np.int64) for i in (3, 4, 5))
            r = r + before[length, salt]
            at = np.searchsorted(starts, length * wide + r, "right") - 1
            k, q = r - table_["first"][at], table_["q"][at]
            put = [table_["base"][at] + k // q, table_["capacity"][at].astype(np.int32), (table_["at"][at] + k % q * length).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *map(pa.array, put)], ["id", "piece", "start", "length", "bin_id", "capacity", "offset"])

    kind = df.schema[id_col].dataType.simpleString()
    placed = map_arrow(full.select("id", "piece", "start", "length", "salt", rank.cast("long").alias("rank")), place, f"id {kind}, piece int, start long, length int, bin_id long, capacity int, offset int")
    none = lambda t: F.lit(None).cast(t)
    return placed.unionByName(pieces.where("length = 0").select("id", "piece", "start", "length", none("long").alias("bin_id"), none("int").alias("capacity"), none("int").alias("offset")))


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


#: Sequence lengths, in words, that the query and the pipeline pack for.
CAPACITIES = [256, 512, 1024, 2048, 4096]


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pack` of the words of the whole `documents`. No SQL: best fit is a loop; tests hold it against fitting piece by piece. Null and empty texts have one row without a place;
    repeated rows are pieces of their own; very long texts are cut into pieces of the greatest length; an empty table gives no rows; columns besides play no part."""
    docs = table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("n"))
    return pack(docs, "doc_id", "n", CAPACITIES).withColumnRenamed("id", "doc_id")
