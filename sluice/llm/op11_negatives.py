"""Hard-negative mining over k-means inverted lists.

Vectors are dealt to the lists of their nearest centroids, which are fitted on a bounded sample; each list stores the greatest distance of any of its vectors from the
centroid, over all rows. By Cauchy and Schwarz, an anchor's score with a vector of a list lies within |anchor| * radius of its score with the centroid. So an anchor visits
lists by falling upper bounds, skips those whose bounds lie outside the wanted window of scores, and stops when the bound falls strictly below its kth score.

On Spark, lists are packed into shards of bounded size, a long list into several. Anchors travel in blocks to the shards that they need, in two turns: the first visits a few lists
of the best bounds and finds a first kth score; the second visits what that score doesn't rule out. Only the leaders of a shard leave its task. Positives are found so, and then
negatives, whose windows follow from the positives' scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, map_arrow, parts, sample_at_most, sound_vectors, table
from .op9_imi import centroids, distances

#: Vectors that are packed together, anchors of a block, vectors of a shard, vectors that are scored at a time.
PACK, BLOCK, SHARD, STEP = 8_192, 512, 65_536, 8_192
ROWS = "shard long, kind int, payload binary"
FOUND = "uid long, win int, id long, score long"
NONE = np.iinfo(np.int64).min


def pack(*arrays: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    for a in arrays:
        pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(a)), sink)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes, n: int) -> list[np.ndarray]:
    source = pa.BufferReader(payload)
    return [pa.ipc.read_tensor(source).to_numpy() for _ in range(n)]


class Lists:
    """What the driver and every task know of the lists: centroids, radii, sizes, and the shards that hold them."""

    def __init__(self, centres: np.ndarray, radii: np.ndarray, sizes: np.ndarray, shards: int, kind: type):
        self.centres, self.radii, self.sizes, self.kind = centres, radii, sizes, kind
        self.norms = np.sqrt((centres * centres).sum(1))
        per = max(1, -(-int(sizes.sum()) // max(1, shards)))
        self.first, self.split, at, held = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // per)), 0, 0
        for i, n in enumerate(sizes.tolist()):  # small lists share a shard, long ones have several
            if held and held + n > per:
                at, held = at + 1, 0
            self.first[i] = at
            at, held = (at + int(self.split[i]), 0) if self.split[i] > 1 else (at, held + n)
        self.shards = at + 1

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of the scores of each anchor with the vectors of each list; the slack covers what doubles round."""
        norm = np.sqrt((a * a).sum(1))[:, None]
        middle, reach = a @ self.centres.T, norm * self.radii[None]
        slack = 1e-9 * (norm * (self.norms + self.radii)[None]) + 1e-6
        return middle - reach - slack, middle + reach + slack

    def needed(self, a: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(wanted, upper): whether each anchor must visit each list, for any of its windows; a bound that equals the kth score may still bring a smaller id."""
        lower, upper = self.bounds(a)
        wanted = np.zeros(upper.shape, bool)
        for w in range(low.shape[1]):
            least = np.maximum(low[:, w], floor[:, w])[:, None].astype(np.float64)
            wanted |= (upper >= least) & (lower <= high[:, w, None]) & (low[:, w] <= high[:, w])[:, None]
        return wanted & (self.sizes > 0)[None], upper

    def seeds(self, wanted: np.ndarray, upper: np.ndarray, rows: int) -> np.ndarray:
        """Of the lists that an anchor must visit, the first by falling bound, until they hold `rows` vectors."""
        order = np.argsort(np.where(wanted, -upper, np.inf), axis=1, kind="stable")
        held = np.where(np.take_along_axis(wanted, order, 1), self.sizes[order], 0)
        out = np.zeros(wanted.shape, bool)
        np.put_along_axis(out, order, held.cumsum(1) - held < rows, 1)
        return out & wanted

    def of_turn(self, a: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, rows: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """(wanted, upper) of a turn: the seeds, which don't depend on scores, or what `floor` leaves of the rest."""
        wanted, upper = self.needed(a, low, high, np.full(low.shape, NONE))
        seeds = self.seeds(wanted, upper, rows)
        return (seeds if first else self.needed(a, low, high, floor)[0] & ~seeds), upper


class Leaders:
    """The k best of each (anchor, window) of a block: higher scores first, then smaller ids."""

    def __init__(self, anchors: int, windows: int, k: int):
        self.k, self.slots = k, anchors * windows
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.concatenate((self.slot, slot)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        keep = np.arange(len(slot)) - np.searchsorted(slot, slot) < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]

    def kth(self) -> np.ndarray:
        """The kth score of each slot, or the least number where it has fewer."""
        out, full = np.full(self.slots, NONE), np.arange(len(self.slot)) - np.searchsorted(self.slot, self.slot) == self.k - 1
        out[self.slot[full]] = self.score[full]
        return out


def visit(rows: Iterator[tuple], lists: Lists, same: bool, k: int, seed_rows: int, first: bool) -> Iterator[pa.RecordBatch]:
    """What the anchors' blocks find in each shard; rows come by shard, vectors first."""
    at, held, ready = None, [], {}
    for shard, kind, payload in rows:
        if shard != at:
            at, held, ready = shard, [], {}
        if kind == 0:
            held.append(unpack(payload, 5))
            continue
        if held:
            own, uid, ids, label, v = (np.concatenate(x) for x in zip(*held))
            held, order = [], np.lexsort((ids, label, own)) if same else np.lexsort((ids, own))
            own, uid, ids, label, v = own[order], uid[order], ids[order], label[order], v[order]
            full, starts = np.unique(own, return_index=True)
            ready = {c: x for c, *x in zip(full.tolist(), *(np.split(y, starts[1:]) for y in (uid, ids, label, v)))}
        if not ready:
            continue
        a_uid, a_label, a, low, high, floor = unpack(payload, 6)
        wanted, upper = lists.of_turn(a.astype(np.float64), low, high, floor, seed_rows, first)
        leaders, scored = Leaders(len(a), low.shape[1], k), a.astype(lists.kind)
        for c in sorted(ready, key=lambda c: -upper[:, c].max()):
            least = np.maximum(low, floor)
            some = np.nonzero(wanted[:, c] & ((upper[:, c, None] >= least) & (low <= high)).any(1))[0]
            if not len(some):
                continue
            c_uid, c_ids, c_label, c_v = ready[c]
            for s in range(0, len(c_ids), STEP):
                x_uid, x_ids, x_label, x = c_uid[s : s + STEP], c_ids[s : s + STEP], c_label[s : s + STEP], c_v[s : s + STEP].astype(lists.kind)
                if same:  # slices of one label, so that other rows aren't scored
                    groups = [(some[a_label[some] == y], slice(*np.searchsorted(x_label, [y, y + 1]))) for y in np.intersect1d(a_label[some], x_label).tolist()]
                else:
                    groups = [(some, slice(0, len(x_ids)))]
                for who, cols in groups:
                    score = scored[who] @ x[cols].T
                    fine = x_uid[cols][None] != a_uid[who, None] if same else x_label[cols][None] != a_label[who, None]
                    for w in range(low.shape[1]):
                        hit = fine & (score >= least[who, w, None].astype(lists.kind)) & (score <= high[who, w, None].astype(lists.kind))
                        many = np.nonzero(hit.sum(1) > k)[0]
                        if len(many):  # a slice lies by ids, so of equal scores the first ones lead
                            part = np.where(hit[many], score[many], lists.kind(NONE))
                            kth = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k, None]
                            above, tie = part > kth, part == kth
                            hit[many] = above | tie & (tie.cumsum(1) <= k - above.sum(1)[:, None])
                        i, j = np.nonzero(hit)
                        if len(i):
                            leaders.add(who[i] * low.shape[1] + w, score[i, j].astype(np.int64), x_ids[cols][j])
                floor = np.maximum(floor, leaders.kth().reshape(floor.shape))
                least = np.maximum(low, floor)
        if len(leaders.slot):
            width = low.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(a_uid[leaders.slot // width]), pa.array((leaders.slot % width).astype(np.int32)), pa.array(leaders.id), pa.array(leaders.score)], ["uid", "win", "id", "score"])


def _numbers(column: pa.Array, n: int, width: int = -1) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, width)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], ["shard", "kind", "payload"])


def _search(vectors: DataFrame, anchors: DataFrame, lists: Lists, same: bool, k: int, seed_rows: int) -> DataFrame:
    """(uid, win, id, score): the k best of each window of each anchor (uid, label, vec, low, high), in two turns."""

    def ask(first: bool):
        def run(batches):
            for b in batches:
                for s in range(0, b.num_rows, BLOCK):
                    part = b.slice(s, BLOCK)
                    uid, label = part.column(0).to_numpy(), part.column(1).to_numpy()
                    a, low, high, floor = (_numbers(part.column(i), len(uid)) for i in (2, 3, 4, 5))
                    order = np.argsort(distances(a.astype(np.float64), lists.centres).argmin(1), kind="stable")  # neighbours need much the same lists
                    uid, label, a, low, high, floor = (x[order] for x in (uid, label, a, low, high, floor))
                    wanted = lists.of_turn(a.astype(np.float64), low, high, floor, seed_rows, first)[0]
                    some = np.zeros((len(uid), lists.shards), bool)
                    for c in np.nonzero(wanted.any(0))[0]:
                        some[:, lists.first[c] : lists.first[c] + lists.split[c]] |= wanted[:, c, None]
                    out = []
                    for shard in np.nonzero(some.any(0))[0].tolist():
                        p = np.nonzero(some[:, shard])[0]
                        out.append((shard, 1, pack(uid[p], label[p], a[p].astype(vector_type), low[p], high[p], floor[p])))
                        if len(out) >= 64:
                            yield _batch(out)
                            out = []
                    if out:
                        yield _batch(out)

        return run

    vector_type = np.int16 if lists.kind is np.float32 else np.int64

    def lay(batches):
        held, have = [], 0

        def flush():
            uid, ids, label, shard, own = (np.concatenate([x[i] for x in held]) for i in range(5))
            v = np.concatenate([x[5] for x in held])
            order = np.argsort(shard, kind="stable")
            full, starts = np.unique(shard[order], return_index=True)
            out = [(g, 0, pack(own[p], uid[p], ids[p], label[p], v[p])) for g, p in zip(full.tolist(), np.split(order, starts[1:]))]
            yield _batch(out)

        for b in batches:
            if b.num_rows:
                uid, ids, label, own = (b.column(i).to_numpy() for i in range(4))
                v = _numbers(b.column(4), len(uid)).astype(vector_type)
                held.append((uid, ids, label, lists.first[own] + (uid * 0x9E3779B1 >> 7) % lists.split[own], own, v))
                have += len(uid)
                if have >= PACK:
                    yield from flush()
                    held, have = [], 0
        if held:
            yield from flush()

    def turn(anchors: DataFrame, first: bool) -> DataFrame:
        asked = map_arrow(anchors.select("uid", "label", "vec", "low", "high", "floor"), ask(first), ROWS)
        together = map_arrow(vectors.select("uid", "id", "label", "own", "vec"), lay, ROWS).unionByName(asked)
        together = together.repartition(parts(vectors), "shard").sortWithinPartitions("shard", "kind")
        found = map_arrow(together, lambda bs: visit((r for b in bs for r in zip(*(c.to_pylist() for c in b.columns))), lists, same, k, seed_rows, first), FOUND)
        return best(found, k)

    nothing = F.transform("low", lambda x: F.lit(NONE))
    seen = cut(turn(anchors.withColumn("floor", nothing), True))
    kth = seen.where(F.col("rank") == k).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("win", "score"))).alias("kth"))  # as many as an anchor has windows
    floors = F.transform("low", lambda x, i: F.coalesce(F.try_element_at("kth", i), F.lit(NONE)))
    raised = anchors.join(kth, "uid", "left").withColumn("floor", floors)
    return best(seen.unionByName(turn(raised, False)), k)


def _hundredths(x: Column) -> Column:
    """floor(x / 100) of a long, without a detour over doubles."""
    return F.floor(x.cast("decimal(20, 0)") / 100).cast("long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each window with their ranks; what a task passes on is k rows a window at most."""
    rank = F.row_number().over(W.partitionBy("uid", "win").orderBy(F.desc("score"), "id"))
    return found.drop("rank").withColumn("rank", rank).where(F.col("rank") <= k)


def mine(
    df: DataFrame, id_col: str, label_col: str | Column, vec_col: str, is_anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    lists: int | None = None, sample: int = 20_000, seed_rows: int = 2_048,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id `is_anchor` holds for, and each of its first `positives` other rows of the same
    label, the first `negatives` rows of another label whose score is from `low` to `high` hundredths of the positive's. Exact: bounds only save work.

    A component x counts as floor(scale * x); a score is the inner product; higher scores come first, then smaller ids. Labels are integers (a column, or an expression over the input's).
    Fewer positives or negatives: all of them; windows of negative scores are empty. Rows whose id, label or vector is null, whose vector is empty, has null or non-finite components, or is of
    another length than most, take no part. A repeated row is an anchor, a candidate and another row of its own. An empty table gives no rows. Scores of 2**56 or more can't be compared
    with hundredths in a long and are refused with a ValueError. Columns besides play no part.

    lists: centroids; if None, half the square root of the number of vectors, 1,024 at most; `sample` bounds the rows that they are fitted on. seed_rows: what an anchor's first turn looks at, at least.
    """
    label = F.col(f"`{label_col}`") if isinstance(label_col, str) else label_col
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vec_col}`").alias("vec")).where("id is not null and label is not null")
    rows, dim, n, most = sound_vectors(rows)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not dim:
        return df.sparkSession.createDataFrame([], out)
    greatest = dim * (most * scale + 1) ** 2
    if greatest >= 1 << 56:
        raise ValueError("components are too large for scores that fit in a long")
    kind = np.float32 if greatest < 1 << 24 else np.float64 if greatest < 1 << 53 else np.int64  # the narrowest that holds every sum exactly
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "id", "label", F.transform("vec", lambda x: F.floor(x * scale)).alias("vec"))
    rows = cut(rows)
    some = sample_at_most(rows, "uid", sample, n).select("uid", "vec").orderBy("uid").toArrow().combine_chunks()
    seen = _numbers(some.column("vec").combine_chunks(), some.num_rows, dim).astype(np.float64)
    wanted = min(1024, max(1, int(0.5 * n**0.5)), max(1, len(seen) // 16)) if lists is None else lists
    centres = centroids(seen, wanted)

    def place(batches):
        for b in batches:
            if b.num_rows:
                v = _numbers(b.column(3), b.num_rows).astype(np.float64)
                own = distances(v, centres).argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(np.sqrt(((v - centres[own]) ** 2).sum(1)))], ["uid", "id", "label", "vec", "own", "apart"])

    rows = cut(map_arrow(rows, place, "uid long, id long, label long, vec array<long>, own long, apart double"))
    radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in rows.groupBy("own").agg(F.max("apart").alias("radius"), F.count("*").alias("n")).collect():  # a row a list
        radii[r["own"]], sizes[r["own"]] = r["radius"], r["n"]
    held = Lists(centres, radii, sizes, max(parts(df), -(-n // SHARD)), kind)
    anchors = rows.where(is_anchor(F.col("id"))).select("uid", "label", "vec")
    whole = anchors.withColumns({"low": F.array(F.lit(NONE + 1)), "high": F.array(F.lit(np.iinfo(np.int64).max))})
    found = cut(_search(rows, whole, held, True, positives, seed_rows))

    ends = F.array_sort(F.collect_list(F.struct("rank", "score")))  # `positives` rows at most
    windows = found.groupBy("uid").agg(ends.alias("ends"))
    fill = F.array_repeat(F.lit(0).cast("long"), F.lit(positives) - F.size("ends"))
    lows = F.concat(F.transform("ends", lambda x: -_hundredths(-x["score"] * low)), F.transform(fill, lambda x: x + 1))
    highs = F.concat(F.transform("ends", lambda x: _hundredths(x["score"] * high)), fill)
    asked = anchors.join(windows.withColumns({"low": lows, "high": highs}).drop("ends"), "uid")
    against = _search(rows, asked, held, False, negatives, seed_rows)
    names = rows.where(is_anchor(F.col("id"))).select("uid", F.col("id").alias("anchor_id"))
    pairs = found.select("uid", (F.col("rank") - 1).alias("win"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = pairs.join(against.select("uid", "win", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), ["uid", "win"]).join(names, "uid")
    return pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_bounded_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives from the whole `embeddings` for the rows whose vec_id is divisible by 50, where every seventh label is wrong: as `mine` states.

    Null ids, labels and vectors take no part, ties go to smaller ids, repeated rows are rows of their own, an empty table gives no rows.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding", lambda i: i % 50 == 0)


#: Every anchor against every row.
SQL = """with kept as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as materialized (select a.vec_id a, b.vec_id b, a.l = b.l same, list_inner_product(a.v, b.v)::bigint s from kept a join kept b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
pos as (select a, b, s from scored where same qualify row_number() over (partition by a order by s desc, b) <= 5)
select p.a anchor_id, p.b positive_id, row_number() over (partition by p.a, p.b order by n.s desc, n.b)::int rank, n.b negative_id, p.s positive_score, n.s negative_score
from pos p join scored n on n.a = p.a and not n.same and 50 * p.s <= 100 * n.s and 100 * n.s <= 95 * p.s qualify rank <= 3"""
