"""Duplicates and contamination."""

from __future__ import annotations

import difflib
import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import jaccard as similarity
from ..functions.text import casefold, nfkc, ngrams, norm, strip, trigram_set
from .acceptance import accepted
from .batches import map_batches, shares
from .cosine import have_similar, most_similar, tfidf
from .matching import blocks as blocks_of
from .matching import common
from .rounds import keep


def two_pass(df: DataFrame, hash_col: str, url_col: str, order: list[str]) -> DataFrame:
    """The first row of each hash, then of those the first of each URL."""
    first = lambda d, key: d.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return first(first(df, hash_col), url_col)


def greedy(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Rows kept one after the other, in the order of ids, unless a kept row has one of the keys. Null keys don't count; ids tell rows apart.

    As `acceptance.accepted`: exact for chains of any length, and no group of equal keys meets in one task.
    """
    named = F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(k).cast("string"))) for i, k in enumerate(keys)])
    pairs = df.select(F.col(id_col).alias("id"), F.explode(F.array_compact(named)).alias("key"))
    free = df.where(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNull()).select(F.col(id_col).alias("id"))
    return df.join(accepted(pairs).unionByName(free).withColumnRenamed("id", id_col), id_col, "left_semi")


def duplicate_of(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """Every row with the least id of its key; minima are combined before the shuffle."""
    rows = df.withColumn("_key", key)
    return rows.join(rows.groupBy("_key").agg(F.min(id_col).alias("duplicate_of")), "_key").drop("_key")


def canonical_rows(df: DataFrame, id_col: str, keys: list[str], length: Column) -> DataFrame:
    """canonical_id: the longest row of each group of equal keys, ties to the least id."""
    best = df.groupBy(*keys).agg(F.min_by(id_col, F.struct((-length).alias("l"), F.col(id_col))).alias("canonical_id"), F.count("*").alias("members"))
    return best


def repeated_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n) of values that stand in two rows or more."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
    return df.select(pairs).select("p.*").where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n")).where("n > 1")


def in_core(df: DataFrame, core: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """in_core: any of the keys is one of the core's; a flag for each key, so no join has an OR."""
    out = df
    for k in keys:
        out = out.join(core.select(F.col(k)).distinct().withColumn(f"_has_{k}", F.lit(True)), k, "left")
    found = F.coalesce(*[F.col(f"_has_{k}") for k in keys], F.lit(False))
    return out.withColumn("in_core", found).drop(*[f"_has_{k}" for k in keys])


#: What counts as a word of a page, a Han letter or a run of Latin letters and digits.
PAGE_WORDS = "[\u4e00-\u9fff]|[a-z0-9]+"


def simhash_blake(df: DataFrame, id_col: str, text_col: str, words: int = 3, pattern: str = r"\S+", glue: str = " ") -> DataFrame:
    """(id, simhash): 64 votes by BLAKE2b of runs of words, which `pattern` finds in the lower-cased text and `glue` joins; a tie sets the bit."""
    find = re.compile(pattern).findall

    def one(text: str) -> str:
        w = find((text or "").lower())
        runs = [glue.join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
        h = np.frombuffer(b"".join(hashlib.blake2b(r.encode(), digest_size=8).digest() for r in runs), ">u8")
        votes = 2 * np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) - len(runs)
        return np.packbits(votes >= 0).tobytes().hex()

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(one)

    return df.select(id_col, run(F.col(text_col)).alias("simhash"))


def as_long(digest: Column) -> Column:
    """16 hex digits as the long of the same bits."""
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def blocks(fp: Column, most: int, spare: int = 3, bits: int = 64) -> Column:
    """Keys of a fingerprint, one of which any other within `most` bits has too: all choices of `spare` of its `most` + `spare` blocks."""
    n = most + spare
    edges = [i * bits // n for i in range(n + 1)]
    block = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])]
    key = lambda some: F.struct(F.lit(sum(1 << i for i in some)).alias("blocks"), F.array(*[block[i] for i in some]).alias("value"))
    return F.array(*[key(some) for some in itertools.combinations(range(n), spare)])


def near_pairs(df: DataFrame, id_col: str, fp_col: str, most: int) -> DataFrame:
    """(a, b, distance) of distinct fingerprints within `most` bits. Each fingerprint stands for all its rows, by their least id; null ones take no part.

    Two of them agree on three of `most` + 3 blocks of bits, so such choices of blocks give candidates, 24 bits of each at 5, and the distance decides.
    """
    fps = df.where(F.col(fp_col).isNotNull()).groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("id"))
    rows = fps.select("id", "fp", F.explode(blocks(F.col("fp"), most)).alias("b")).select("id", "fp", "b.blocks", "b.value")
    x, y = rows.alias("x"), rows.alias("y")
    distance = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")))
    pairs = x.join(y, (F.col("x.blocks") == F.col("y.blocks")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.id") < F.col("y.id")) & (distance <= most))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), distance.cast("int").alias("distance")).distinct()


def overlap_pairs(rows: DataFrame, row_id: str, pool: DataFrame, pool_id: str, least: float) -> DataFrame:
    """(a, b, jaccard) of rows and pool rows whose `tokens`, arrays without repeats, have this Jaccard similarity or more; the pool is the smaller side.

    Of each pool row only the tokens that are rare in the pool are indexed, as many as make sure that one of them is shared. Rows whose size fits no pool row go
    first, and what is left of both sides is kept, so that texts are cut into tokens once. Empty sets are like none.
    """
    sizes = lambda d, i: d.select(F.col(i).alias("id"), "tokens", F.size("tokens").alias("n")).where("n > 0")
    b = keep(sizes(pool, pool_id))
    lo, hi = b.agg(F.min("n"), F.max("n")).first()
    a = keep(sizes(rows, row_id).where(F.col("n").between((lo or 0) * least - 1e-9, (hi or 0) / least + 1e-9)))
    held = b.select("id", "n", F.explode("tokens").alias("t"))
    held = held.join(held.groupBy("t").agg(F.count("*").alias("df")), "t")
    rank = F.row_number().over(W.partitionBy("id").orderBy("df", "t"))
    index = held.withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select(F.col("id").alias("b"), F.col("n").alias("bn"), "t")
    near = a.select(F.col("id").alias("a"), "n", F.explode("tokens").alias("t")).join(index, "t").where((F.col("n") >= F.col("bn") * least - 1e-9) & (F.col("bn") >= F.col("n") * least - 1e-9))
    both = near.select("a", "b").distinct().join(a.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(b.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.select("a", "b", F.round(shared / (F.size("ta") + F.size("tb") - shared), 6).alias("jaccard")).where(F.col("jaccard") >= least)


def best_overlap(rows: DataFrame, row_id: str, pool: DataFrame, pool_id: str, least: float) -> DataFrame:
    """(row, match_id, jaccard): of `overlap_pairs`, the most similar pool row of each row, ties to the least id."""
    pairs = overlap_pairs(rows, row_id, pool, pool_id, least)
    return pairs.groupBy("a").agg(F.max_by(F.struct("b", "jaccard"), F.struct("jaccard", (-F.col("b")).alias("o"))).alias("m")).select(F.col("a").alias(row_id), F.col("m.b").alias("match_id"), F.col("m.jaccard").alias("jaccard"))


def ratio_pairs(rows: DataFrame, row_id: str, pool: DataFrame, pool_id: str, text_col: str, least: float) -> DataFrame:
    """(a, b, ratio) of texts whose matching-blocks ratio is `least`, over two thirds, or more; ids that are equal don't count.

    Texts of S letters together with this ratio have `least` / 2 * S letters in matching blocks, and between the blocks (1 - `least`) * S at most, so they share
    (1.5 * `least` - 1) * S - 1 pairs of letters, repeats told apart; and the shorter has least / (2 - least) of the longer's letters. Rare pairs of letters
    give candidates by that bound, lengths and the letters as such cut them down, and matching blocks decide. Nulls take no part.
    """

    def grams(d: DataFrame, i: str) -> DataFrame:
        d = d.where(F.char_length(text_col) > 0).select(F.col(i).alias("id"), F.char_length(text_col).alias("n"), F.explode(ngrams(F.concat(F.lit("\u0002"), text_col), 2)).alias("g"))
        d = d.groupBy("id", "n", "g").agg(F.count("*").alias("k"))  # the mark at the start gives a text of one letter a pair too
        return d.select("id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("k").cast("int")), lambda k: F.concat("g", k.cast("string")))).alias("t"))

    b = keep(grams(pool, pool_id))
    lo, hi = b.agg(F.min("n"), F.max("n")).first()
    part = least / (2 - least)
    a = grams(rows.where(F.char_length(text_col).between((lo or 0) * part - 1e-9, (hi or 0) / part + 1e-9)), row_id)
    need = F.greatest(F.lit(1), F.ceil((1.5 * least - 1) * F.col("n") * 2 / (2 - least) - 1 - 1e-9))
    counts = b.groupBy("t").agg(F.count("*").alias("df"))
    rank = F.row_number().over(W.partitionBy("id").orderBy("df", "t"))
    index = b.join(counts, "t").withColumn("r", rank).where(F.col("r") <= F.col("n") - need + 1).select(F.col("id").alias("b"), F.col("n").alias("bn"), "t")
    met = a.join(index, "t").where((F.col("id") != F.col("b")) & (F.col("n") >= F.col("bn") * part - 1e-9) & (F.col("bn") >= F.col("n") * part - 1e-9))
    met = met.select(F.col("id").alias("a"), "b").distinct()
    texts = lambda d, i, name: d.select(F.col(i).alias(name), F.col(text_col).alias(f"_{name}"))
    return block_ratio(met.join(texts(rows, row_id, "a"), "a").join(texts(pool, pool_id, "b"), "b"), "_a", "_b", "ratio", least).where(F.col("ratio") >= least).select("a", "b", "ratio")

#: Letters of texts whose runs meet in one pass, about; a pass's shuffle is dropped before the next.
LETTERS_A_PASS = 32_000_000
#: Texts from which it is learned which runs are frequent, at most, and the places of their counts.
RUN_TEXTS, RUN_PLACES = 100_000, 1 << 20
#: Letters of a run, at most.
RUN = 7


def like_pairs(df: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """(a, b, ratio) of texts of one table whose matching-blocks ratio is `least` or more, in both orders; texts and ids are distinct, nulls and empty texts take no part.

    Two texts of S letters together with this ratio have (1 - `least`) * S letters outside a common subsequence at most. Each of these spoils one at most of disjoint runs of
    the longer text, so of one run more than they are, one stands in the shorter text whole, and moved by no more letters than that. The longer text is cut into so
    many slots, the rarest run of each is its key, and all runs of the shorter text meet it; the length and the place cut candidates down, and matching blocks decide. Which
    runs are rare affects the time only. Texts of like length meet in a class, and runs meet in passes, so that what is shuffled at once doesn't grow with the texts.
    """
    low = least - 1e-6
    part = low / (2 - low)
    rows = keep(df.where(F.char_length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    total, letters, longest = rows.agg(F.count("*"), F.sum(F.char_length("text")), F.max(F.char_length("text"))).first()
    edges = [1]
    while edges[-1] <= (longest or 0):
        edges.append(max(edges[-1] + 1, int(edges[-1] / part)))
    edges = np.array(edges)

    def spoilt(n, shortest, most):
        """Letters outside a common subsequence, at most, of a text of n letters and one of `shortest` to `most`; their number is odd where the letters of both are. Below 0 where there are no such texts."""
        sound = lambda m: (d := np.floor((1 - low) * (n + m) + 1e-6)) - (d - n - m) % 2
        return np.where(shortest > most, -1, np.maximum(sound(most), sound(np.maximum(shortest, most - 1)))).astype(np.int64)

    def shorter(n, c):
        """How many letters a text of class c has that is like one of n letters and no longer."""
        return np.maximum(edges[c], np.ceil(part * n - 1e-6)), np.minimum(edges[c + 1] - 1, n)

    run_of = []
    for c in range(len(edges) - 1):
        n = np.arange(edges[c], int((edges[c + 1] - 1) / part) + 1)
        slots = spoilt(n, *shorter(n, c)) + 1
        run_of.append(min(RUN, *(n[slots > 0] // slots[slots > 0]), RUN))
    run_of = np.array(run_of, np.int64)
    salt = np.arange(1, len(edges), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def hashed(batches):
        """(ids, lengths, first places, hashes by length of a run) of some texts at a time."""
        for x in batches:
            texts = x.column(1).to_pylist()
            n = np.array([len(t) for t in texts], np.int64)
            for s, e in shares(n, 500_000):
                codes = np.frombuffer("".join(texts[s:e]).encode("utf-32-le"), "<u4").astype(np.uint64)
                h, of = np.zeros(len(codes), np.uint64), {}
                for j in range(RUN):
                    h = h * np.uint64(0x9E3779B97F4A7C15)
                    h[: len(codes) - j] += codes[j:]
                    of[j + 1] = h
                yield x.column(0).slice(s, e - s), n[s:e], np.cumsum(n[s:e]) - n[s:e], of

    def keyed(h: np.ndarray, c) -> np.ndarray:
        h = (h ^ salt[c]) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ h >> np.uint64(32)

    def all_runs(n, first, of):
        """(own, place, key) of all runs of texts, as the shorter ones."""
        c = np.searchsorted(edges, n, "right") - 1
        own = np.repeat(np.arange(len(n)), n)
        place, key = np.arange(len(own)) - first[own], np.zeros(len(own), np.uint64)
        for r in np.unique(run_of[c]):
            mine = run_of[c][own] == r
            key[mine] = keyed(of[r][mine], c[own[mine]])
        whole = place + run_of[c][own] <= n[own]
        return own[whole], place[whole], key[whole]

    def count(batches):
        n_of = np.zeros(RUN_PLACES, np.int64)
        for _, n, first, of in hashed(batches):
            n_of += np.bincount((all_runs(n, first, of)[2] % np.uint64(RUN_PLACES)).astype(np.int64), minlength=RUN_PLACES)
        at = np.nonzero(n_of)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n_of[at])], ["at", "n"])

    some = rows if (total or 0) <= RUN_TEXTS else rows.where(F.pmod(F.xxhash64("id"), F.lit(total)) < RUN_TEXTS)
    found = map_batches(some, count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # `RUN_PLACES` numbers at most
    often = np.zeros(RUN_PLACES, np.int64)
    often[found.column("at").to_numpy()] = found.column("n").to_numpy()
    passes = max(1, -(-(letters or 0) // LETTERS_A_PASS))

    def rows_of(i: int, ids, n, own, place, key) -> pa.RecordBatch:
        own, place, key = (x[key % np.uint64(passes) == i] for x in (own, place, key))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids.take(pa.array(own)), pa.array(place), pa.array(n[own])], ["key", "id", "p", "n"])

    def runs(i: int):
        def of_shorter(batches):
            for ids, n, first, of in hashed(batches):
                yield rows_of(i, ids, n, *all_runs(n, first, of))

        return of_shorter

    def rare_runs(i: int):
        def of_longer(batches):
            known: dict[int, list[tuple[int, int, int]]] = {}
            for ids, n, first, of in hashed(batches):
                own, place, key = [], [], []
                for t, (size, s) in enumerate(zip(n.tolist(), first.tolist())):
                    if size not in known:
                        classes = range(np.searchsorted(edges, np.ceil(part * size - 1e-6), "right") - 1, np.searchsorted(edges, size, "right"))
                        known[size] = [(c, int(run_of[c]), k) for c in classes if (k := int(spoilt(size, *shorter(size, c))) + 1) > 0]
                    for c, r, slots in known[size]:
                        wide = size // slots
                        k = keyed(of[r][s : s + slots * wide], c).reshape(slots, wide)[:, : wide - r + 1]
                        at = often[(k % np.uint64(RUN_PLACES)).astype(np.int64)].argmin(1)
                        own.append(np.full(slots, t))
                        place.append(np.arange(slots) * wide + at)
                        key.append(k[np.arange(slots), at])
                if own:
                    yield rows_of(i, ids, n, *map(np.concatenate, (own, place, key)))

        return of_longer

    schema = f"key long, id {rows.schema['id'].dataType.simpleString()}, p long, n long"
    moved = F.col("y.p") - F.col("x.p")
    near = F.abs(moved) + F.abs(F.col("y.n") - F.col("x.n") - moved) <= (1 - low) * (F.col("x.n") + F.col("y.n")) + 1e-6
    once = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.id") > F.col("x.id")))
    met = None
    for i in range(passes):
        x, y = map_batches(rows, rare_runs(i), schema).alias("x"), map_batches(rows, runs(i), schema).alias("y")
        pairs = keep(x.join(y, (F.col("x.key") == F.col("y.key")) & once & near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
        met = pairs if met is None else met.unionByName(pairs)
    met = met.distinct() if passes > 1 else met
    texts = lambda name: rows.select(F.col("id").alias(name), F.col("text").alias(f"_{name}"))
    both = met.join(texts("a"), "a").join(texts("b"), "b")
    there, back = (block_ratio(both, x, y, "ratio", least).where(F.col("ratio") >= least) for x, y in (("_a", "_b"), ("_b", "_a")))
    return there.select("a", "b", "ratio").unionByName(back.select(F.col("b").alias("a"), F.col("a").alias("b"), "ratio"))



#: Pairs of letters of two texts from which runs are found by hashes.
LONG = 40_000


def block_ratio(df: DataFrame, a: str, b: str, name: str = "ratio", least: float = 0.0) -> DataFrame:
    """The matching-blocks ratio of two texts, after candidates were found by other means; 0 where bounds show that it is less than `least`."""

    def one(p: str, q: str) -> float:
        total = len(p) + len(q)
        if len(p) * len(q) > LONG:
            if least and (2 * min(len(p), len(q)) / total < least - 1e-9 or 2 * sum((Counter(p) & Counter(q)).values()) / total < least - 1e-9):
                return 0.0
            return round(2 * blocks_of(p, q, int(least * total / 2 - 1e-6)) / total, 6)
        m = difflib.SequenceMatcher(None, p, q, autojunk=False)
        if least and total and (min(m.real_quick_ratio(), m.quick_ratio()) < least - 1e-9 or 2 * common(p)(q) / total < least - 1e-9):
            return 0.0  # blocks are a common subsequence
        return round(m.ratio(), 6)

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(p or "", q or "") for p, q in zip(x, y)], dtype=float)

    return df.withColumn(name, run(F.col(a), F.col(b)))


def contamination(items: DataFrame, item_id: str, docs: DataFrame, doc_id: str, text_col: str, ratio: float, jaccard: float) -> DataFrame:
    """(item, exact, normalised, match_id, ratio, jaccard, near, contaminated): whether each item stands in the documents.

    match_id is the document with the greatest (ratio, jaccard) of those that reach either bound, ties to the least id; null, with zeros, where there is none. Null texts match nothing.
    """
    flag = lambda k: F.coalesce(F.col(k), F.lit(False)).alias(k)
    keyed = lambda d, i: d.select(F.col(i).alias("id"), text_col, F.sha2(text_col, 256).alias("e"), F.sha2(norm(F.col(text_col)), 256).alias("m"))
    a, b = keyed(items, item_id), keyed(docs, doc_id)
    out = a.join(b.select("e").distinct().withColumn("exact", F.lit(True)), "e", "left").join(b.select("m").distinct().withColumn("normalised", F.lit(True)), "m", "left")
    grams = lambda d, i: d.where(F.col(text_col).isNotNull()).select(F.col(i).alias("id"), trigram_set(F.col(text_col)).alias("tokens"))
    like = overlap_pairs(grams(docs, doc_id), "id", grams(items, item_id), "id", jaccard).select(F.col("b").alias("item"), F.col("a").alias("doc"))
    # ids of the two sides are of different kinds, and an equal one means nothing
    other = docs.select(F.concat(F.lit("d"), F.col(doc_id).cast("string")).alias("k"), text_col)
    own = items.select(F.concat(F.lit("i"), F.col(item_id).cast("string")).alias("k"), text_col)
    alike = ratio_pairs(other, "k", own, "k", text_col, ratio)
    plain = lambda c, d, i: F.substring(c, F.lit(2), F.char_length(c)).cast(d.schema[i].dataType)
    met = like.unionByName(alike.select(plain(F.col("b"), items, item_id).alias("item"), plain(F.col("a"), docs, doc_id).alias("doc"))).distinct()
    pairs = met.join(items.select(F.col(item_id).alias("item"), F.col(text_col).alias("_p")), "item").join(docs.select(F.col(doc_id).alias("doc"), F.col(text_col).alias("_q")), "doc")
    pairs = block_ratio(pairs, "_p", "_q").withColumn("jaccard", F.round(similarity(trigram_set(F.col("_p")), trigram_set(F.col("_q"))), 6))
    best = pairs.groupBy("item").agg(F.max_by(F.struct("doc", "ratio", "jaccard"), F.struct("ratio", "jaccard", (-F.col("doc")).alias("o"))).alias("b"))
    out = out.join(best, out["id"] == best["item"], "left").select(F.col("id").alias(item_id), flag("exact"), flag("normalised"), F.col("b.doc").alias("match_id"), F.coalesce("b.ratio", F.lit(0.0)).alias("ratio"), F.coalesce("b.jaccard", F.lit(0.0)).alias("jaccard"))
    near = F.col("match_id").isNotNull()
    return out.select("*", near.alias("near"), (F.col("exact") | F.col("normalised") | near).alias("contaminated"))


def superseded(df: DataFrame, key: str, day: str, id_col: str) -> DataFrame:
    """superseded_by: of a key with two dated rows or more, the newest; older rows bear it, and undated ones too, as they rank below any date."""
    w = W.partitionBy(key)
    newest = F.max(F.when(F.col(day).isNotNull(), F.struct(F.col(day), F.col(id_col)))).over(w)
    old = (F.count(day).over(w) >= 2) & (F.col(day).isNull() | (F.col(day) < newest[day]))
    return df.withColumn("superseded_by", F.when(old, newest[id_col]))


def seen_before(df: DataFrame, key: str, order: str, accepted: Column, policy: str = "kept") -> DataFrame:
    """duplicate: an earlier row has the key; under `kept` only accepted rows count as seen, under `all` every row does."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    counts = F.lit(1) if policy == "all" else accepted.cast("int")
    return df.withColumn("duplicate", F.coalesce(F.max(counts).over(before), F.lit(0)) > 0)


def cascade(candidates: DataFrame, protected: DataFrame, evaluation: DataFrame, id_col: str, text_col: str, least: float = 0.985, longest: int = 12_000, features: int = 60_000) -> DataFrame:
    """(id, reason, max_reference_tfidf_cosine): why each candidate is left out, the first of these that holds; null if it stays.

    EMPTY_PROMPT, MALFORMED (a replacement character), TOO_LONG (over `longest` characters); EXACT_DUPLICATE and NORMALIZED_DUPLICATE of a protected text or of a candidate that was accepted before, in
    the order of ids; EVALUATION_EXACT_OR_NORMALIZED; then, for what has passed so far, a TF-IDF cosine of `least` or more with a protected or evaluation text: SEMANTIC_NEAR_DUPLICATE_EVAL or
    _TRAINING by the side of the most similar one, protected first where they tie. The cosine is null below `least`: nothing below it is computed. Null texts are empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    folded = lambda x: F.sha2(F.trim(F.regexp_replace(casefold(nfkc(x)), r"[^\p{L}\p{N}_]+", " ")), 256)
    keyed = lambda d: d.select(text.alias("text"), F.sha2(text, 256).alias("e"), folded(text).alias("n"))
    rows = candidates.select(F.col(id_col).alias("id"), text.alias("text"), F.sha2(text, 256).alias("e"), folded(text).alias("n"))
    own = F.when(strip(F.col("text")) == "", "EMPTY_PROMPT").when(F.contains("text", F.lit("\ufffd")), "MALFORMED").when(F.char_length("text") > longest, "TOO_LONG")
    rows = keep(rows.withColumn("own", own))
    held = keyed(evaluation).select("n").distinct().withColumn("in_evaluation", F.lit(True))
    known = keyed(protected).groupBy("n").agg(F.lit(True).alias("known"))
    exact = keyed(protected).select("e").distinct().withColumn("known_exact", F.lit(True))
    # of each normalised text the first candidate that nothing else rules out stands for those that follow
    groups = rows.where("own is null").groupBy("n").agg(F.min_by(F.struct("id", "e"), "id").alias("first")).join(known, "n", "left").join(held, "n", "left")
    seen = rows.select("id", "e", "n", "own").join(groups, "n", "left").join(exact, "e", "left")
    yes = lambda k: F.coalesce(F.col(k), F.lit(False))
    taken = ~yes("known") & ~yes("in_evaluation")  # whether the first one was accepted
    reason = F.coalesce(
        "own", F.when(yes("known_exact") | (taken & (F.col("id") != F.col("first.id")) & (F.col("e") == F.col("first.e"))), "EXACT_DUPLICATE").when(yes("known") | (taken & (F.col("id") != F.col("first.id"))), "NORMALIZED_DUPLICATE").when(yes("in_evaluation"), "EVALUATION_EXACT_OR_NORMALIZED"),
    )
    seen = keep(seen.select("id", reason.alias("reason")))
    passed = keep(rows.select("id", "text").join(seen.where("reason is null").select("id"), "id", "left_semi"))
    side = lambda d, k: d.select(F.struct(F.lit(k).alias("side"), F.sha2(text, 256).alias("e")).alias("reference"), text.alias("text")).dropDuplicates(["reference"])
    plain = lambda d: d.select(text.alias("text"))
    pool = keep(side(protected, 0).unionByName(side(evaluation, 1)))
    near = most_similar(passed, pool, "id", "text", "reference", least, features, corpus=plain(protected).unionByName(plain(evaluation)).unionByName(passed.select("text")))
    out = seen.join(near, "id", "left")
    semantic = F.when(F.col("reference.side") == 1, "SEMANTIC_NEAR_DUPLICATE_EVAL").when(F.col("reference.side") == 0, "SEMANTIC_NEAR_DUPLICATE_TRAINING")
    return out.select(F.col("id").alias(id_col), F.coalesce("reason", semantic).alias("reason"), F.round("cosine", 6).alias("max_reference_tfidf_cosine"))


#: Places of the counts by which rare tokens are told, and texts that they are learned from, about.
TOKEN_PLACES, TOKEN_ROWS = 1 << 18, 20_000
#: Pairs of sets whose tokens meet in one pass, about; a pass's shuffle is dropped before the next.
PAIRS_A_PASS = 100_000


def like_sets(rows: DataFrame, pool: DataFrame, least: float, some: DataFrame) -> DataFrame:
    """(a, b) of sets of tokens (s, tokens), without repeats and by a digest `s`, whose Jaccard similarity is `least` or more, a set of rows and one of the pool.

    Both sides send only numbers: of each set the rarest tokens' hashes, as many as make sure that two such sets share one. Sizes and places cut down what meets, and the tokens themselves decide. Equal
    sets meet by their digests. Which tokens are rare is learned from `some` sets, and affects the time only. Empty sets are like none.
    """
    spark, low = rows.sparkSession, least - 1e-6  # similarities are rounded
    counted = some.select(F.explode("tokens").alias("t")).select(F.pmod(F.xxhash64("t"), F.lit(TOKEN_PLACES)).alias("at")).groupBy("at").count().toArrow()  # `TOKEN_PLACES` numbers at most
    often = np.zeros(TOKEN_PLACES, np.int64)
    often[counted.column("at").to_numpy()] = counted.column("count").to_numpy()
    often = spark.sparkContext.broadcast(often)

    def rarest(batches):
        many = often.value
        for b in batches:
            n = np.array(b.column(1).value_lengths(), np.int64)
            h, of = b.column(1).flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, many[h % TOKEN_PLACES], of))
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            first = place <= (n - np.ceil(n * low - 1e-9))[of]
            yield pa.RecordBatch.from_arrays([pa.array(h[order][first]), b.column(0).take(pa.array(of[first])), pa.array(n[of][first].astype(np.int32)), pa.array(place[first].astype(np.int32))], ["t", "s", "n", "p"])

    def sent(d: DataFrame) -> DataFrame:
        return map_batches(d.where(F.size("tokens") > 0).select("s", F.transform("tokens", lambda t: F.xxhash64(t)).alias("h")), rarest, f"t long, s {d.schema['s'].dataType.simpleString()}, n int, p int").distinct()

    x, y = sent(rows).alias("x"), sent(pool).alias("y")
    need = F.ceil(low / (1 + low) * (F.col("x.n") + F.col("y.n")) - 1e-6)  # tokens that both have
    rest = F.least(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p"))  # at most, where this is the first that both have
    met = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.n") >= F.col("y.n") * low - 1e-6) & (F.col("y.n") >= F.col("x.n") * low - 1e-6) & (rest >= need))
    met = keep(met.select(F.col("x.s").alias("a"), F.col("y.s").alias("b")).distinct())
    unlike = met.where("a <> b")

    def texts(d: DataFrame, k: str) -> DataFrame:
        wanted = unlike.select(F.col(k).alias("s")).distinct()
        wanted = F.broadcast(wanted) if wanted.count() <= 500_000 else wanted  # so that not all sets are shuffled
        return keep(d.join(wanted, "s", "left_semi").dropDuplicates(["s"]).select(F.col("s").alias(k), F.col("tokens").alias(f"t{k}")))

    of_a, of_b, passes = texts(rows, "a"), texts(pool, "b"), max(1, -(-unlike.count() // PAIRS_A_PASS))
    shared = F.size(F.array_intersect("ta", "tb"))
    similar = F.round(shared / (F.size("ta") + F.size("tb") - shared), 6) >= least
    out = met.where("a = b")
    for i in range(passes):
        some = unlike.where(F.pmod(F.xxhash64("a", "b"), F.lit(passes)) == i)
        out = out.unionByName(keep(some.join(of_a, "a").join(of_b, "b").where(similar).select("a", "b")))
    return out


def split_audit(train: DataFrame, validation: DataFrame, id_col: str, text_col: str, jaccard: float = 0.90, cosine: float = 0.985, features: int = 60_000) -> DataFrame:
    """One row: how many texts two splits share exactly and normalised, how many validation rows have a training row at `jaccard` or more of their words of two letters or more, or at
    `cosine` or more by TF-IDF, and PASS where nothing is shared. Null texts are empty, and sets without words are like none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.trim(F.regexp_replace(casefold(nfkc(text)), r"[^\p{L}\p{N}_]+", " "))
    keyed = lambda d, v: d.select(F.lit(v).alias("v"), F.sha2(text, 256).alias("e"), F.sha2(plain, 256).alias("n"))
    both = keep(keyed(train, False).unionByName(keyed(validation, True)))
    shared = lambda k: both.groupBy(k).agg(F.bool_or("v").alias("a"), F.bool_or(~F.col("v")).alias("b")).where("a and b").count()
    words = lambda d: d.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.filter(F.split(plain, " "), lambda w: F.char_length(w) > 1))).alias("tokens")).where(F.size("tokens") > 0)
    # equal sets are compared once
    named_sets = lambda d: words(d).select(F.unhex(F.sha2(F.array_join("tokens", " "), 256)).alias("s"), "tokens")
    like = keep(like_sets(named_sets(validation), named_sets(train), jaccard, words(train.where(F.pmod(F.xxhash64(id_col), F.lit(max(1, train.count() // TOKEN_ROWS))) == 0))).select(F.col("a").alias("s")).distinct())
    lexical = named_sets(validation).join(like, "s", "left_semi").count()
    corpus = train.select(text.alias("text")).unionByName(validation.select(text.alias("text")))
    weigh = tfidf(corpus, "text", features)
    named = lambda d: d.select(F.col(id_col).alias("id"), text.alias("text"))
    semantic = have_similar(named(validation), named(train), "id", "text", cosine, weigh, features).count()
    found = (shared("e"), shared("n"), lexical, semantic)
    return train.sparkSession.createDataFrame([("PASS" if not any(found) else "FAIL", *found)], "status string, exact_overlap long, normalized_overlap long, lexical_near_overlap long, semantic_near_overlap long")


def accept_pages(pages: DataFrame, history: DataFrame, most: int = 1, least_history: int = 150) -> DataFrame:
    """(id, decision) of new pages (id, url, title, text), in the order of ids: historical_url, repeated_url (an earlier page, accepted or not, has it), historical_content, internal_content, accepted.

    Content repeats if its hash, its title's letters and digits, or its SimHash within `most` bits is one of the history's or of a page accepted before. Texts of history of `least_history`
    characters or fewer lend no SimHash. Titles without letters and null texts take part as empty ones. Exact: acceptance goes as one page after the other would.
    """
    tidy = lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}_]+", "")
    text = F.coalesce(F.col("text"), F.lit(""))

    def facts(d: DataFrame) -> DataFrame:
        d = d.select("id", "url", F.sha2(text, 256).alias("hash"), tidy(F.col("title")).alias("title"), text.alias("text"))
        prints = simhash_blake(d, "id", "text", 3, PAGE_WORDS, "").select("id", as_long(F.col("simhash")).alias("fp"))
        return keep(d.withColumn("n", F.char_length("text")).drop("text").join(prints, "id"))

    old = history.withColumn("id", F.monotonically_increasing_id())
    new, old = facts(pages), facts(keep(old))
    first = new.groupBy("url").agg(F.min("id").alias("first"))
    mark = lambda d, k: d.where(F.col(k).isNotNull()).select(k).distinct().withColumn(f"old_{k}", F.lit(True))
    rows = new.join(first, "url", "left")
    for k in ("url", "hash", "title"):
        rows = rows.join(mark(old, k), k, "left")
    # prints that lie within the bound of each other, of both sides at once
    prints = new.select("fp").unionByName(old.where(F.col("n") > least_history).select("fp")).distinct()
    near = keep(near_pairs(prints.withColumn("id", F.col("fp")), "id", "fp", most))
    gone = old.where(F.col("n") > least_history).select("fp").distinct()
    met = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    gone = gone.unionByName(met.join(gone, met["b"] == gone["fp"], "left_semi").select(F.col("a").alias("fp"))).distinct()
    rows = rows.join(gone.withColumn("old_fp", F.lit(True)), "fp", "left")
    yes = lambda k: F.coalesce(F.col(k), F.lit(False))
    before = F.when(yes("old_url"), "historical_url").when(F.col("first") < F.col("id"), "repeated_url").when(yes("old_hash") | yes("old_title") | yes("old_fp"), "historical_content")
    rows = keep(rows.select("id", "hash", "title", "fp", before.alias("decision")))
    left = rows.where("decision is null")
    keys = left.select("id", F.explode(F.array(F.concat(F.lit("h"), "hash"), F.concat(F.lit("t"), "title"), F.concat(F.lit("f"), F.col("fp").cast("string")))).alias("key"))
    # two prints that are near are one key of all rows that bear either
    pair = met.select(F.col("a").alias("fp"), F.concat_ws("/", F.lit("p"), F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string")).alias("key"))
    taken = accepted(keys.unionByName(left.select("id", "fp").join(pair, "fp").select("id", "key")))
    out = rows.join(taken.withColumn("taken", F.lit(True)), "id", "left")
    return out.select("id", F.coalesce("decision", F.when(yes("taken"), "accepted").otherwise("internal_content")).alias("decision"))
