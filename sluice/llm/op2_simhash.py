"""SimHash near-duplicates by vantage-point trees.

Fingerprints are parted by Hamming distance from vantage points. A node keeps what lies within its radius mu of its
point inside and the rest outside; by the triangle inequality, a fingerprint outside can be within r of one inside only where its
distance is mu + r at most, and such ones go to the inside as well. So both ends of every link meet in at least one leaf,
and no more than the boundary is copied. The upper tree, grown from a bounded sample, deals fingerprints to shards;
each shard grows its own tree below and compares exactly in the leaves. A leaf gives one edge for each fingerprint that has a link, to
the least fingerprint that it is connected with there, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, cut, map_arrow, parts, sample_at_most, table, utf8, words_of
from .components import connected_components

#: Pairs of fingerprints that are compared at a time: their distances take 32 MB.
PAIRS = 1 << 22
LANE = np.uint64(0x0101010101010101)
#: Odd multipliers that turn one hash into further ones.
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of n words of the text, A-Z lower-cased, joined by spaces; fewer words make one run, none no run."""
    words = words_of(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    line, k, x = b" ".join(words), max(1, len(words) - n + 1), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:k].tolist()
    ends = ends[min(n, len(words)) - 1 :].tolist()
    return np.frombuffer(b"".join([x(line[s:e], 42) for s, e in zip(starts, ends)]), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each run of `lengths` hashes, a word whose bits are those that over half of the run's hashes have; 0 for an empty run."""
    out = np.zeros(len(lengths), np.uint64)
    full = np.nonzero(lengths)[0]
    if not len(full):
        return out
    at = np.concatenate(([0], np.cumsum(lengths[full])))
    pieces = [np.arange(s, e, 255) for s, e in zip(at[:-1], at[1:])]  # eight counters of eight bits in a word hold 255
    owner = np.repeat(np.arange(len(full)), [len(p) for p in pieces])
    cuts = np.concatenate(pieces)
    first = np.concatenate(([0], np.nonzero(np.diff(owner))[0] + 1))
    half = lengths[full][:, None]
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & LANE, cuts)
        lanes = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        set_ = (2 * lanes > half).astype(np.uint64)
        for lane in range(8):
            out[full] |= set_[:, lane] << np.uint64(8 * lane + k)
    return out


def spread(hashes: np.ndarray, i: int) -> np.ndarray:
    """The i-th word of further bits for each hash; the 0th is the hash itself."""
    if not i:
        return hashes
    x = hashes + np.uint64((i * 0x9E3779B97F4A7C15) & (2**64 - 1))
    for m in MIX:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(m)
    return x ^ (x >> np.uint64(33))


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, lanes: int = 1) -> DataFrame:
    """(id, f0, f1, ...): SimHash words of each row's whole text; zero where the text is null or has no word."""
    schema = "id long, " + ", ".join(f"f{i} long" for i in range(lanes))

    def run(batches):
        for b in by_bytes(batches, "text"):
            h = [shingle_hashes(t, shingle) for t in utf8(b.column(1))]
            n, h = np.array([len(x) for x in h], np.int64), np.concatenate(h)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(majority(spread(h, i), n).view(np.int64)) for i in range(lanes)]], ["id", *[f"f{i}" for i in range(lanes)]])

    return map_arrow(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")), run, schema)


def split(points: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 4) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """(vantage point, mu, inside or on its boundary, outside) that leaves least in the fuller child; None where nothing is gained."""
    best = None
    for p in rng.choice(points, min(tries, len(points)), replace=False):
        d = np.bitwise_count(points ^ p).astype(np.int64)
        mu = int(np.partition(d, len(d) // 2)[len(d) // 2])
        for m in (mu - 1, mu):
            inner, outer = int((d <= m + radius).sum()), int((d > m).sum())
            if m >= 0 and outer and (best is None or max(inner, outer) < best[0]):
                best = (max(inner, outer), int(p), m, d)
    if best is None or best[0] > 0.95 * len(points):
        return None
    _, p, m, d = best
    return p, m, d <= m + radius, d > m


def grow(sample: np.ndarray, radius: int, leaf: float, seed: int = 7) -> list[tuple[int, int, int, int]]:
    """A tree as (vantage point, mu, inside child, outside child); a child below 0 is shard -child - 1. Leaves hold about `leaf` of the sample."""
    rng, nodes, shards = np.random.default_rng(seed), [], 0

    def add(points: np.ndarray) -> int:
        nonlocal shards
        got = split(points, radius, rng) if len(points) > max(leaf, 8) else None
        if got is None:
            shards += 1
            return -shards
        p, mu, inner, outer = got
        nodes.append((p, mu, 0, 0))
        at = len(nodes) - 1
        nodes[at] = (p, mu, add(points[inner]), add(points[outer]))
        return at

    root = add(np.unique(sample))
    return nodes if root == 0 and nodes else []


def route(nodes: list[tuple[int, int, int, int]], values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, shards): every shard that each value belongs to."""
    if not nodes:
        return np.arange(len(values)), np.zeros(len(values), np.int64)
    where, shard, todo = [], [], [(0, np.arange(len(values)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            where.append(rows)
            shard.append(np.full(len(rows), -at - 1, np.int64))
            continue
        p, mu, inside, outside = nodes[at]
        d = np.bitwise_count(values[rows] ^ np.uint64(p))
        todo += [(inside, rows[d <= mu + radius]), (outside, rows[d > mu])]
    if not where:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(where), np.concatenate(shard)


def settle(pairs_a: np.ndarray, pairs_b: np.ndarray, label: np.ndarray) -> None:
    """Give both ends of each pair, and whatever hangs on them, the least label."""
    while len(pairs_a):
        la, lb = label[pairs_a], label[pairs_b]
        differ = la != lb
        if not differ.any():
            return
        pairs_a, pairs_b, la, lb = pairs_a[differ], pairs_b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (up := label[label]) is not label and (up != label).any():
            label[:] = up


def meet(values: np.ndarray, rows: np.ndarray, radius: int, label: np.ndarray, also=None) -> None:
    """Settle all pairs of `rows` (positions that ascend) that lie within `radius` bits and meet the further condition."""
    s = 0
    while s < len(rows):
        step = max(1, min(256, PAIRS // (len(rows) - s)))
        block, rest = rows[s : s + step], rows[s:]
        s += step
        i, j = np.nonzero(np.bitwise_count(values[block][:, None] ^ values[rest][None, :]) <= radius)
        keep = i < j
        a, b = block[i[keep]], rest[j[keep]]
        for t in range(0, len(a), 200_000):
            x, y = a[t : t + 200_000], b[t : t + 200_000]
            x, y = (z[label[x] != label[y]] for z in (x, y))  # the others are connected as it is
            if also is not None and len(x):
                ok = also(x, y)
                x, y = x[ok], y[ok]
            settle(x, y, label)


def local_links(values: np.ndarray, radius: int, also=None, leaf: int = 384, seed: int = 11) -> np.ndarray:
    """For each value, the position of the least one that it is connected with by links of `radius` bits at most.

    also(rows, columns): a further condition on pairs of positions, as a Boolean array.
    """
    rng, label = np.random.default_rng(seed), np.arange(len(values))
    todo = [np.arange(len(values))]
    while todo:
        rows = todo.pop()
        if len(rows) < 2:
            continue
        got = split(values[rows], radius, rng) if len(rows) > leaf else None
        if got:
            todo += [rows[got[2]], rows[got[3]]]
            continue
        meet(values, rows, radius, label, also)  # a leaf, or a knot of fingerprints that no vantage point parts
    return label


def block_links(values: np.ndarray, radius: int, also=None, bits: int = 32) -> np.ndarray:
    """As `local_links`, for values of few bits, where trees copy too much: of `radius` + 1 blocks of bits, two values this near share one."""
    label, edges = np.arange(len(values)), np.linspace(0, bits, radius + 2).astype(int)
    for low, high in zip(edges[:-1], edges[1:]):
        block = (values >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)
        order = np.argsort(block, kind="stable")
        for rows in np.split(order, np.nonzero(np.diff(block[order]))[0] + 1):
            meet(values, rows, radius, label, also)
    return label


def hamming_components(distinct: DataFrame, column: str, radius: int = 2, sample: int = 65_536, per_shard: int = 20_000) -> DataFrame:
    """(node, root) of the distinct fingerprints that link with another at `radius` bits or fewer.

    sample bounds what the driver sees to grow the upper tree; it decides only how shards are cut, not which links are found. A shard of more than twice `per_shard` fingerprints,
    which no vantage point parts, is dealt in chunks of `per_shard`, and each two of them meet in a task of their own.
    """
    fps = distinct.select(F.col(column).alias("fp"))
    n = fps.count()
    seen = np.array([r[0] for r in sample_at_most(fps, "fp", sample, n).collect()], np.int64).view(np.uint64)
    nodes = grow(seen, radius, per_shard * len(seen) / max(1, n)) if len(seen) else []

    def tally(batches):
        for b in batches:
            shard, n = np.unique(route(nodes, b.column(0).to_numpy().view(np.uint64), radius)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(n.astype(np.int64))], ["shard", "n"])

    full = map_arrow(fps, tally, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * per_shard)
    knots = {r["shard"]: -(-r["n"] // per_shard) for r in full.collect()}  # one for each 2 * per_shard of what is dealt, at most

    def deal(batches):
        for b in batches:
            v = b.column(0).to_numpy()
            where, shard = route(nodes, v.view(np.uint64), radius)
            pair = np.zeros(len(where), np.int64)
            for knot, k in knots.items():
                if (some := shard == knot).any():
                    c = np.repeat((spread(v[where[some]].view(np.uint64), 1) % np.uint64(k)).astype(np.int64), k)
                    o = np.tile(np.arange(k), int(some.sum()))
                    where, shard = np.concatenate((where[~some], np.repeat(where[some], k))), np.concatenate((shard[~some], np.full(len(c), knot)))
                    pair = np.concatenate((pair[~some], np.minimum(c, o) * k + np.maximum(c, o)))
            for s in range(0, len(where), 16_384):
                yield pa.RecordBatch.from_arrays([pa.array(shard[s : s + 16_384]), pa.array(pair[s : s + 16_384]), pa.array(v[where[s : s + 16_384]])], ["shard", "pair", "fp"])

    def link(t: pa.Table) -> pa.Table:
        v = np.sort(t.column("fp").to_numpy().view(np.uint64))
        root = v[local_links(v, radius)]
        hung = root != v
        return pa.table({"a": pa.array(v[hung].view(np.int64)), "b": pa.array(root[hung].view(np.int64))})

    edges = map_arrow(fps, deal, "shard long, pair long, fp long").groupBy("shard", "pair").applyInArrow(link, "a long, b long")
    return connected_components(edges)


def simhash_components(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component_id) of each row: component_id is the least id that links reach, the row's own included.

    Rows with equal fingerprints are linked, those without words (zero) too. Null texts have no words. Very long texts are read whole, one at a time. Columns besides, whatever their names,
    play no part. An empty table gives no rows.
    """
    rows = cut(fingerprints(df, id_col, text_col, shingle).select("id", F.col("f0").alias("fp")))
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = hamming_components(distinct, "fp", radius)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))  # by itself, so that the join below can be split
    of = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("id", "fp", "component_id")


#: Texts of so many distinct shingles at most also meet by exact prefixes: votes of so few are too coarse for SimHash's estimate.
SHORT = 40
#: Members of a chunk of an unfinished group; two chunks are compared in one task.
CHUNK = 256
#: Words of a fingerprint that travel with a view, at most: enough to tell a pair that bears a link from chance.
CARRIED = 4
#: Dealt rows for each fingerprint in one pass over the views, of about 50 bytes each.
DEALT = 48


def set_fingerprints(df: DataFrame, shingle: int, lanes: int, similarity: float) -> DataFrame:
    """(id, key, short, f0, f1, ...) of (id, key, text): SimHash words of the set of shingles, each counted once.

    short: of a set of `SHORT` shingles at most, the least hashes, one of which any set with this Jaccard similarity has among its own.
    """
    schema = "id long, key long, short array<long>, " + ", ".join(f"f{i} long" for i in range(lanes))

    def run(batches):
        for b in by_bytes(batches, "text"):
            h = [np.unique(shingle_hashes(t, shingle)) for t in utf8(b.column(2))]
            n = np.array([len(x) for x in h], np.int64)
            first = [x[: len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1].view(np.int64) if 0 < len(x) <= SHORT else x[:0].view(np.int64) for x in h]
            h = np.concatenate(h)
            words = [pa.array(majority(spread(h, i), n).view(np.int64)) for i in range(lanes)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(first, pa.list_(pa.int64())), *words], ["id", "key", "short", *[f"f{i}" for i in range(lanes)]])

    return map_arrow(df.select("id", "key", "text"), run, schema)


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have this Jaccard similarity or more."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def exact_links(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set, the position of the least one that it is connected with by links of this Jaccard similarity or more; all pairs are compared."""
    n, label = np.array([len(x) for x in sets], np.int64), np.arange(len(sets))
    full = np.nonzero(n)[0]
    if len(full) < 2:
        return label
    n = n[full]
    _, flat = np.unique(np.concatenate([sets[i] for i in full]), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    has = np.zeros(flat.max() + 1, np.int64)
    for i in range(len(full) - 1):
        own = flat[starts[i] : starts[i] + n[i]]
        has[own] = 1
        both = np.add.reduceat(has[flat[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        has[own] = 0
        j = i + 1 + np.nonzero(both >= similarity * (n[i] + n[i + 1 :] - both) - 1e-9)[0]
        settle(np.full(len(j), full[i]), full[j], label)
    return label


def verified_edges(texts: DataFrame, members: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b) that connect what exact Jaccard similarity connects within each group of `members` (id, key, root); `texts` has (id, key, text).

    Each member is compared with its group's root first. Where some aren't like it, these are compared with the whole group, two chunks to a task,
    so that no task takes a large group alone, and groups that their root holds together cost no pairs.
    """
    def run(batches):
        for b in by_bytes(batches, "text"):
            sets = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in utf8(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], ["id", "root", "shingles"])

    found = texts.join(members, ["id", "key"]).dropDuplicates(["id", "key"]).select("id", "root", "text")
    sets = cut(map_arrow(found, run, "id long, root long, shingles binary"))

    def compare(batches):
        for b in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in b.column(i).to_pylist()] for i in (2, 3))
            ok = pa.array([alike(p, q, similarity) for p, q in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(ok)

    pivots = sets.where("id = root").select("root", F.col("shingles").alias("pivot"))
    star = cut(map_arrow(sets.where("id <> root").join(pivots, "root").select("id", "root", "shingles", "pivot"), compare, "a long, b long").distinct())

    held = sets.join(star.select(F.col("a").alias("id"), F.lit(True).alias("held")), "id", "left").withColumn("held", F.coalesce("held", F.col("id") == F.col("root")))
    counts = held.groupBy("root").agg(F.count_if(~F.col("held")).alias("loose"), F.count_if("held").alias("tied")).where("loose > 0 and loose + tied > 2")
    width = lambda c: F.ceil(F.col(c) / CHUNK)
    chunk = F.when(F.col("held"), width("loose") + F.pmod(F.xxhash64("id"), F.greatest(width("tied"), F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), width("loose")))
    dealt = held.join(counts, "root").select("root", "id", "shingles", "held", chunk.cast("int").alias("c"), width("loose").cast("int").alias("k"), (width("loose") + width("tied")).cast("int").alias("all"))
    others = F.sequence(F.lit(0), F.when(F.col("held"), F.col("k") - 1).otherwise(F.col("all") - 1))
    dealt = dealt.select("root", "id", "shingles", "c", F.explode(others).alias("o")).select("root", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "id", "shingles")

    def link(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        packed, ids = t.column("shingles").to_pylist(), ids[order]
        root = exact_links([np.frombuffer(packed[i], np.uint64) for i in order], similarity)
        hung = root != np.arange(len(root))
        return pa.table({"a": pa.array(ids[hung]), "b": pa.array(ids[root[hung]])})

    return star.unionByName(dealt.groupBy("root", "i", "j").applyInArrow(link, "a long, b long"))


def similar_components(df: DataFrame, id_col: str, text_col: str, shingle: int = 5, similarity: float = 0.8, lanes: int = 12, radius: int = 3, sample: int = 65_536, per_shard: int = 100_000, dealt_rows: int = DEALT) -> DataFrame:
    """(id, component_id) of each row, with links by exact Jaccard similarity of shingle sets.

    SimHash only finds candidates. Each set has `lanes` * 64 bits. They are read as 2 * lanes views of 32 bits, and a vantage-point tree for each view
    finds the pairs that lie within `radius` bits in it; such a pair is a candidate unless the bits of `CARRIED` words, the view's among them, are together five standard
    deviations beyond what `similarity` lets expect. Copies at the trees' boundaries grow faster than the rows, so views are gone through in passes that deal
    `dealt_rows` rows for each fingerprint at most, or one view by itself, and what a pass has shuffled is dropped. A shard that the tree couldn't part is cut into chunks of `per_shard` rows, and each two of them meet in a task of their own. By the binomial model, 24 views of radius 3 bring 99.9 % of pairs at 0.8 together. Sets too small for that model also meet
    by exact prefixes. Groups of candidates are then linked by exact Jaccard similarity (`verified_edges`), so a candidate costs no link and a link that
    a chain of candidates stands for is still seen. Equal fingerprints are linked; texts without words are equal.
    Rows of one id are one document: their links join. A row without an id has a component only with an equal text that has one. An empty table gives no rows.
    """
    names = [f"f{i}" for i in range(lanes)]
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("key", F.xxhash64("text"))
    rows = cut(set_fingerprints(texts, shingle, lanes, similarity))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "key", "short"))).alias("m")
    distinct = cut(rows.groupBy(*names).agg(first).where("m is not null").select(*names, F.col("m.id").alias("least"), "m.key", "m.short"))
    carried = min(lanes, CARRIED)
    bits = 64 * carried
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    n, most = distinct.count(), int(bits * p + 5 * np.sqrt(bits * p * (1 - p)))
    seen = sample_at_most(distinct, "least", sample, n).select(*names).toArrow()
    views = []
    for i in range(2 * lanes if seen.num_rows else 0):
        v = seen.column(i // 2).to_numpy().view(np.uint64)
        views.append(grow((v >> np.uint64(32 * (i % 2))) & np.uint64(0xFFFFFFFF), radius, per_shard * seen.num_rows / n, seed=i))

    def view_of(f: np.ndarray, i: int) -> np.ndarray:
        return (f[:, i // 2] >> np.uint64(32 * (i % 2))) & np.uint64(0xFFFFFFFF)

    def tally(batches):
        for b in batches:
            f = np.stack([b.column(i).to_numpy().view(np.uint64) for i in range(lanes)], 1)
            for i, nodes in enumerate(views):
                shard, n = np.unique(route(nodes, view_of(f, i), radius)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), i, np.int32)), pa.array(shard), pa.array(n.astype(np.int64))], ["view", "shard", "n"])

    tallied = map_arrow(distinct.select(*names), tally, "view int, shard long, n long").groupBy("view", "shard").agg(F.sum("n").alias("n"))
    tallied = cut(tallied.withColumn("k", F.when(F.col("n") > 2 * per_shard, F.ceil(F.col("n") / per_shard)).otherwise(1)))
    knots = {(r["view"], r["shard"]): r["k"] for r in tallied.where("k > 1").collect()}  # no more than there are rows for each 2 * per_shard of what is dealt
    passes, held = [], dealt_rows * n  # each view in one pass
    for r in tallied.groupBy("view").agg(F.sum(F.col("n") * F.col("k")).alias("n")).orderBy("view").collect():
        if not passes or held + r["n"] > dealt_rows * n:
            passes.append([])
            held = 0
        passes[-1].append(r["view"])
        held += r["n"]

    def dealing(some: list[int]):
        def deal(batches):
            for b in batches:
                f = np.stack([b.column(i).to_numpy().view(np.uint64) for i in range(lanes)], 1)
                ids = b.column(lanes).to_numpy()
                for i in some:
                    where, shard = route(views[i], view_of(f, i), radius)
                    pair = np.zeros(len(where), np.int64)
                    for (view, knot), k in knots.items():
                        if view == i and (there := shard == knot).any():  # each two chunks of a knot meet in a task
                            c, o = np.repeat((spread(ids[where[there]].view(np.uint64), 1) % np.uint64(k)).astype(np.int64), k), np.tile(np.arange(k), int(there.sum()))
                            where, shard = np.concatenate((where[~there], np.repeat(where[there], k))), np.concatenate((shard[~there], np.full(len(c), knot)))
                            pair = np.concatenate((pair[~there], np.minimum(c, o) * k + np.maximum(c, o)))
                    mine = np.ascontiguousarray(f[:, [(i // 2 + j) % lanes for j in range(carried)]])  # the view's word first
                    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * carried), len(f), [None, pa.py_buffer(mine)]).cast(pa.binary())
                    for s in range(0, len(where), 16_384):
                        at = pa.array(where[s : s + 16_384])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(shard[s : s + 16_384]), pa.array(pair[s : s + 16_384]), b.column(lanes).take(at), packed.take(at)], ["view", "shard", "pair", "id", "bits"])

        return deal

    def link(t: pa.Table) -> pa.Table:
        f = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, carried)
        ids, i = t.column("id").to_numpy(), t.column("view")[0].as_py()
        order = np.argsort(ids, kind="stable")
        ids, f = ids[order], f[order]
        root = block_links(view_of(f, i % 2), radius, lambda x, y: np.bitwise_count(f[x] ^ f[y]).sum(1) <= most)
        hung = root != np.arange(len(root))
        return pa.table({"a": pa.array(ids[hung]), "b": pa.array(ids[root[hung]])})

    def linked(batches):
        at, held = None, []
        for b in batches:  # sorted by view, shard and pair
            keys = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
            starts = np.concatenate(([0], np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
                if held and tuple(keys[s]) != at:
                    yield from link(pa.Table.from_batches(held)).to_batches()
                    held = []
                at = tuple(keys[s])
                held.append(b.slice(s, e - s))
        if held:
            yield from link(pa.Table.from_batches(held)).to_batches()

    # groups are dealt in turn, so that no task has many of them by chance
    first = np.cumsum([0, *(len(nodes) + 1 for nodes in views)]).tolist()
    turn = F.element_at(F.array(*map(F.lit, first)), F.col("view") + 1) + F.col("shard") + F.col("pair")
    met = None
    for some in passes or [[]]:
        dealt = map_arrow(distinct.select(*names, "least"), dealing(some), "view int, shard long, pair long, id long, bits binary")
        dealt = dealt.repartitionById(parts(df), F.pmod(turn, F.lit(parts(df))).cast("int")).sortWithinPartitions("view", "shard", "pair")
        found = map_arrow(dealt, linked, "a long, b long")
        found = found if len(passes) < 2 else cut(found.distinct())  # what was dealt goes before the next pass
        met = found if met is None else met.unionByName(found)
    short = distinct.select(F.col("least").alias("a"), F.explode("short").alias("s"))
    heads = short.groupBy("s").agg(F.min("a").alias("b"))
    groups = connected_components(met.unionByName(short.join(heads, "s").where("a <> b").select("a", "b")))
    lowest = groups.groupBy("root").agg(F.min("node").alias("low"))
    members = groups.join(lowest, "root").select(F.col("node").alias("least"), "low").join(distinct, "least").select(F.col("least").alias("id"), "key", F.col("low").alias("root"))
    roots = connected_components(verified_edges(texts, cut(members), shingle, similarity))
    rooted = distinct.join(roots.withColumnRenamed("node", "least"), "least", "left").withColumn("root", F.coalesce("root", "least"))
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    of = rooted.select(*names, "root").join(least, "root")
    return rows.join(of.select(*names, "component_id"), names, "left").select("id", "component_id")


def op2_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`simhash_components` of the whole `documents`: three words, two bits. No SQL: components are found in rounds; tests compare it with all pairs.
    Null texts and texts without words have the fingerprint zero and are linked; repeated rows share a component.
    """
    out = simhash_components(table(spark, sf_dir, "documents"), "doc_id", "text", 3, 2)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
