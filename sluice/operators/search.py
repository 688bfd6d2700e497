"""Lexical and dense search, fusion and reranking of ranked lists."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .batches import map_batches, shares
from .rounds import keep, spread

#: Query vectors of a pass over the index; queries that are held in every task.
QUERIES_A_PASS = 4096
#: Query terms that are held in every task, at most.
TERMS_A_PASS = 200_000
#: Weights of queries that are held in every task, at most.
MATRIX = 16_000_000
#: Meetings of a document's term and a query's that are weighed at a time.
MEETINGS = 1_000_000
#: Words of documents that are looked up among the query terms at a time.
WORDS = 250_000


def postings(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(term, id, tf, len): the inverted index. Rows without tokens are absent."""
    terms = df.select(F.col(id_col).alias("id"), tokens.alias("t")).select("id", F.size("t").alias("len"), F.explode("t").alias("term"))
    return terms.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def term_counts(df: DataFrame, tokens: Column) -> DataFrame:
    """(term, df, cf): in how many rows each term stands, and how often; one pass, whose exchange moves a row for each term of a task."""
    one = lambda t, df_, cf: F.struct(t.alias("term"), F.lit(df_).alias("df"), F.lit(cf).alias("cf"))
    both = F.concat(F.transform("t", lambda t: one(t, 0, 1)), F.transform(F.array_distinct("t"), lambda t: one(t, 1, 0)))
    return spread(df).select(tokens.alias("t")).select(F.explode(both).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"), F.sum("x.cf").alias("cf"))


def statistics(df: DataFrame, tokens: Column) -> DataFrame:
    """One row: n_docs and avg_len over all rows."""
    n = df.select(F.size(tokens).alias("n"))
    return n.agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_len"))


def pool_size(top_k: int) -> int:
    """How many rows each method gives to fusion and reranking."""
    return max(30, 5 * top_k)


def bm25_top(
    queries: DataFrame, query_id: str, query_tokens: Column, docs: DataFrame, id_col: str, tokens: Column, k: int, by: tuple[str, ...] = ("score",), k1: float = 1.5, b: float = 0.75
) -> DataFrame:
    """(query_id, id, score, matched): of what `bm25` gives, the k rows of each query that lead by any of the columns `by`, ties to smaller ids, and some more.

    Documents are read and cut into tokens once. What is kept of each is a row: its length, and the query terms that it has with their counts; document
    frequencies and the mean length come from there. Each task scores its documents against all queries and passes on its own leaders only, so the one
    exchange moves k rows a query and task at most. Beyond `QUERIES_A_PASS` queries or `TERMS_A_PASS` terms, postings are joined instead.
    """
    q = keep(queries.select(F.col(query_id).alias("query_id"), F.explode(query_tokens).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")))
    n_queries, n_terms = q.agg(F.count_distinct("query_id"), F.count("*")).first()
    if n_queries > QUERIES_A_PASS or n_terms > TERMS_A_PASS:
        return bm25(queries, query_id, query_tokens, docs, id_col, tokens, k1, b)
    held = q.toArrow()
    names = pc.unique(held.column("query_id").combine_chunks())
    terms = pc.unique(held.column("term").combine_chunks())
    asked = pc.index_in(held.column("query_id").combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
    of = pc.index_in(held.column("term").combine_chunks(), terms).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(of, kind="stable")
    asked, times, first = asked[order], held.column("qtf").to_numpy()[order].astype(float), np.searchsorted(of[order], np.arange(len(terms) + 1))

    def count(batches):
        for x in batches:
            lists = x.column(1)
            n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            words, ends, pairs = lists.flatten(), np.cumsum(n), [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for s in range(0, len(words), WORDS):  # of a long text too, so that what is held doesn't follow its words
                at = pc.index_in(words.slice(s, WORDS), terms).fill_null(-1).to_numpy(zero_copy_only=False)
                there = np.nonzero(at >= 0)[0]
                pairs.append(np.unique(np.searchsorted(ends, s + there, "right") * max(1, len(terms)) + at[there], return_counts=True))
            pair, same = np.unique(np.concatenate([p for p, _ in pairs]), return_inverse=True)
            tf = np.zeros(len(pair), np.int64)
            np.add.at(tf, same, np.concatenate([c for _, c in pairs]))
            starts = pa.array(np.searchsorted(pair // max(1, len(terms)), np.arange(len(n) + 1)), pa.int32())
            of_term = pa.ListArray.from_arrays(starts, pa.array(pair % max(1, len(terms)), pa.int32()))
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(n), of_term, pa.ListArray.from_arrays(starts, pa.array(tf, pa.int32()))], ["id", "len", "terms", "tfs"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    index = keep(map_batches(spread(docs).select(F.col(id_col).alias("id"), tokens.alias("t")), count, f"id {kind}, len long, terms array<int>, tfs array<int>"))
    n_docs, avg_len = index.agg(F.count("*"), F.avg("len")).first()
    df_ = np.zeros(len(terms))
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each query term
        df_[r["t"]] = r["count"]
    weight = times * np.repeat(np.log1p((n_docs - df_ + 0.5) / (df_ + 0.5)), np.diff(first))

    def lead(found: list[tuple]) -> list[tuple]:
        """The leaders among (query, id, score, matched) arrays."""
        own, ids, score, matched = (np.concatenate(x) for x in zip(*found))
        some = np.zeros(len(own), bool)
        for c in by:
            line = np.lexsort((ids, -np.round(score, 6) if c == "score" else -matched, own))
            some[line[np.arange(len(own)) - np.searchsorted(own[line], own[line]) < k]] = True
        return [(own[some], ids[some], score[some], matched[some])]

    def score(batches):
        found, size = [], 0
        for x in batches:
            terms_of = pc.list_value_length(x.column(2)).to_numpy(zero_copy_only=False)
            met = np.concatenate(([0], np.cumsum(np.diff(first)[x.column(2).flatten().to_numpy()])))[np.concatenate(([0], np.cumsum(terms_of)))]
            for s, e in shares(np.maximum(np.diff(met), n_queries), MEETINGS):
                part = x.slice(s, e - s)
                ids, length = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy()
                n = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
                doc, term, tf = np.repeat(np.arange(len(n)), n), part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(float)
                own = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / avg_len))
                each = first[term + 1] - first[term]
                rep = np.repeat(np.arange(len(term)), each)
                at = np.arange(len(rep)) - np.repeat(np.cumsum(each) - each, each) + first[term][rep]
                cell = asked[at] * len(n) + doc[rep]
                total, matched = np.bincount(cell, weight[at] * own[rep], n_queries * len(n)), np.bincount(cell, minlength=n_queries * len(n))
                hit = np.nonzero(matched)[0]
                found.append((hit // len(n), ids[hit % len(n)], total[hit], matched[hit]))
                size += len(hit)
                if size > 8 * k * n_queries + 200_000:
                    found = lead(found)
                    size = len(found[0][0])
        if found:
            own, ids, total, matched = lead(found)[0]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), pa.array(ids), pa.array(total), pa.array(matched.astype(np.int64))], ["query_id", "id", "score", "matched"])

    out = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {kind}, score double, matched long"
    return map_batches(index.where(F.size("terms") > 0), score, out).withColumn("score", F.round("score", 6))


def bm25(queries: DataFrame, query_id: str, query_tokens: Column, docs: DataFrame, id_col: str, tokens: Column, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, matched) of every document that shares a term with a query.

    Postings are cut down to the queries' terms before they meet; scores are sums of partial sums, so a common term doesn't gather in one task.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.explode(query_tokens).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    p = postings(docs, id_col, tokens).join(q.select("term").distinct(), "term", "left_semi")
    df_ = p.groupBy("term").agg(F.count("*").alias("df"))
    stats = F.broadcast(statistics(docs, tokens))  # one row
    hits = q.join(df_, "term").join(p, "term").join(stats)
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return hits.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("matched"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """rank (from 1) and only ranks to k; WindowGroupLimit prunes before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def ranked(hits: DataFrame, score: str, k: int) -> DataFrame:
    return top_k(hits, ["query_id"], [F.desc(score), F.asc("id")], k)


def tfidf_top(queries: DataFrame, query_id: str, docs: DataFrame, id_col: str, text: str, k: int, sizes: tuple[int, ...] = (2, 3, 4), max_features: int = 60_000) -> DataFrame:
    """(query_id, rank, id, score): the k documents nearest to each query by the cosine of TF-IDF weights of character n-grams.

    The features are those most frequent in the documents; queries are weighted by the documents' frequencies. Texts are read twice, to count features and to
    score; each task combines its counts, and passes on its own leaders only. What tasks hold is `max_features` features and `MATRIX` weights of queries at most; more
    queries are taken in further passes. Ties go to smaller ids. Null texts are empty; a text without features is like none.
    """
    items = queries.select(F.col(query_id).alias("q"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = spread(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")))
    passes = -(-items.count() // QUERIES_A_PASS)

    def grams(t: str) -> Counter:
        return Counter(g for n in sizes for g in map("".join, zip(*(t[i:] for i in range(n)))))

    def count(batches):
        cf, df_ = Counter(), Counter()

        def flush():
            yield pa.RecordBatch.from_pydict({"term": list(cf), "cf": pa.array(list(cf.values()), pa.int64()), "df": pa.array([df_[t] for t in cf], pa.int64())})
            cf.clear()
            df_.clear()

        for x in batches:
            for t in x.column(0).to_pylist():
                c = grams(t)
                cf.update(c)
                df_.update(c.keys())
                if len(cf) > 500_000:
                    yield from flush()
        yield from flush()

    terms = map_batches(rows.select("t"), count, "term string, cf long, df long").groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
    found = terms.orderBy(F.desc("cf"), "term").limit(max_features).toArrow()
    at = {t: i for i, t in enumerate(found.column("term").to_pylist())}
    n_docs = rows.count()
    idf = np.log((1 + n_docs) / (1 + found.column("df").to_numpy())) + 1

    def weights(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, weight) of each feature of each text."""
        own, feature, tf = [], [], []
        for i, t in enumerate(texts):
            c = [(at[g], n) for g, n in grams(t).items() if g in at]
            own += [i] * len(c)
            feature += [f for f, _ in c]
            tf += [n for _, n in c]
        own, feature = np.array(own, np.int64), np.array(feature, np.int64)
        w = (1 + np.log(np.array(tf, float))) * idf[feature]
        return own, feature, w / np.sqrt(np.bincount(own, w * w, len(texts)))[own]

    def one_pass(ids: list, own: np.ndarray, feature: np.ndarray, w: np.ndarray) -> DataFrame:
        used, at_row = np.unique(feature, return_inverse=True)
        asked = np.zeros((len(used), len(ids)))
        asked[at_row, own] = w
        row_of = np.full(len(at), -1, np.int64)
        row_of[used] = np.arange(len(used))
        at_once = max(1, 1_000_000 // max(1, len(ids)))

        def score(batches):
            for x in batches:
                for s in range(0, x.num_rows if len(ids) else 0, at_once):
                    part = x.slice(s, at_once).sort_by("id")
                    total = np.zeros((part.num_rows, len(ids)))
                    doc, f, dw = weights(part.column(1).to_pylist())
                    known = row_of[f] >= 0
                    doc, f, dw = doc[known], row_of[f[known]], dw[known]
                    ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
                    for i in range(part.num_rows):  # a product of a row and a matrix for each document
                        total[i] = dw[ends[i] : ends[i + 1]] @ asked[f[ends[i] : ends[i + 1]]]
                    total = np.round(total.T, 6)
                    lead = np.argsort(-total, axis=1, kind="stable")[:, :k]
                    q, j = np.repeat(np.arange(len(ids)), lead.shape[1]), lead.ravel()
                    some = total[q, j] > 0
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q[some]], kind), part.column(0).take(pa.array(j[some])), pa.array(total[q, j][some])], ["query_id", "id", "score"])

        return map_batches(rows, score, f"query_id {items.schema['q'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double")

    hits = None
    for i in range(max(1, passes)):
        share = (items if passes <= 1 else items.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == i)).toArrow()
        kind, ids = share.schema.field("q").type, share.column("q").to_pylist()
        own, feature, w = weights(share.column("t").to_pylist())
        step = max(1, MATRIX // max(1, len(np.unique(feature))))
        for s in range(0, max(1, len(ids)), step):
            mine = (own >= s) & (own < s + step)
            one = one_pass(ids[s : s + step], own[mine] - s, feature[mine], w[mine])
            hits = one if hits is None else hits.unionByName(one)
    return ranked(hits, "score", k)


def _best_products(ids: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> pa.RecordBatch:
    s = np.round(q @ v.T, 6)
    order = np.lexsort((np.broadcast_to(vid, s.shape), -s), axis=1)[:, :k]
    return pa.RecordBatch.from_pydict({"query_id": np.repeat(ids, order.shape[1]), "id": vid[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})


def dense_search(queries: DataFrame, query_id: str, vectors: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(query_id, rank, id, score) by dot product, ties to the smaller id; every vector is looked at.

    Up to `QUERIES_A_PASS` queries are held in every task, and vectors are read once. More are packed into blocks, and so are vectors; blocks meet pairwise, each pair in
    one product of matrices, so the plan doesn't grow with the queries. Both are of one length; null vectors take no part.
    """
    found = "query_id long, id long, score double"
    pick = lambda d, i: d.where(F.col(vec_col).isNotNull()).select(F.col(i).cast("long").alias("i"), F.col(vec_col).alias("v"))
    asked, rows = pick(queries, query_id), pick(vectors, id_col)
    matrix = lambda c, n: c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    if asked.count() <= QUERIES_A_PASS:
        held = asked.toArrow()
        ids = held.column(0).to_numpy()
        q = np.array(held.column(1).to_pylist(), np.float64).reshape(len(ids), -1) if len(ids) else np.empty((0, 0))

        def run(batches):
            for b in batches:
                if len(ids) and b.num_rows:
                    yield _best_products(ids, q, b.column(0).to_numpy(), matrix(b.column(1), b.num_rows), k)

        return ranked(map_batches(rows, run, found), "score", k)

    def pack(batches):
        for b in batches:
            for s in range(0, b.num_rows, QUERIES_A_PASS):
                part = b.slice(s, QUERIES_A_PASS)
                yield pa.RecordBatch.from_pydict({"ids": pa.array([part.column(0).to_numpy().astype("<i8").tobytes()]), "vs": pa.array([matrix(part.column(1), part.num_rows).astype("<f8").tobytes()])})

    def meet(batches):
        for b in batches:
            for i, v, j, w in zip(*(c.to_pylist() for c in b.columns)):
                ids, vid = np.frombuffer(i, "<i8"), np.frombuffer(j, "<i8")
                yield _best_products(ids, np.frombuffer(v, "<f8").reshape(len(ids), -1), vid, np.frombuffer(w, "<f8").reshape(len(vid), -1), k)

    blocks = keep(asked.mapInArrow(pack, "ids binary, vs binary"))
    return ranked(blocks.crossJoin(rows.mapInArrow(pack, "vid binary, vv binary")).mapInArrow(meet, found), "score", k)


def reciprocal_ranks(lists: list[tuple[str, DataFrame, float]], constant: int = 60) -> DataFrame:
    """(query_id, id, rrf, best, methods): the sum of weight / (constant + rank) over ranked lists of (query_id, id, rank, score)."""
    rows = None
    for name, df, weight in lists:
        one = df.select("query_id", "id", "rank", "score", F.lit(name).alias("method"), F.lit(weight).alias("weight"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") / (constant + F.col("rank"))), 9).alias("rrf"), F.max("score").alias("best"), F.array_sort(F.collect_set("method")).alias("methods"))


def rerank(pairs: DataFrame, query: str, text: str, scorer: Callable[[list[str], list[str]], list[float]], order: list[Column], k: int, most: int = 32) -> DataFrame:
    """rank (from 1, to k) and rerank_score of (query_id, ...) rows: `scorer` takes lists of queries and texts, `most` pairs at a time, and gives a number for each.

    It stands where a cross-encoder does; whole texts reach it. `order` breaks ties. Null texts count as empty.
    """

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        a, b = a.fillna("").tolist(), b.fillna("").tolist()
        return pd.Series([float(x) for s in range(0, len(a), most) for x in scorer(a[s : s + most], b[s : s + most])], dtype=float)

    return top_k(pairs.drop("rank").withColumn("rerank_score", score(F.col(query), F.col(text))), ["query_id"], [F.desc("rerank_score"), *order], k)


def encode(df: DataFrame, text: str, encoder: Callable[[list[str]], list[list[float]]], prefix: str = "", most: int = 16, name: str = "embedding") -> DataFrame:
    """The column `name`: what `encoder` makes of the texts, `most` at a time, each with `prefix` before it (queries bear an instruction), scaled to length 1.

    A vector of zeros stays as it is. Null texts count as empty.
    """

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        x = [prefix + t for t in x.fillna("")]
        out = []
        for s in range(0, len(x), most):
            v = np.asarray(encoder(x[s : s + most]), np.float64)
            n = np.sqrt((v * v).sum(1, keepdims=True))
            out += list((v / np.where(n > 0, n, 1)).astype(np.float32))
        return pd.Series(out, dtype=object)

    return df.withColumn(name, run(F.col(text)))


def answer(queries: DataFrame, planner, retriever, gate, composer) -> DataFrame:
    """The whole way from questions to answers, each step a callable that the caller supplies: planner(queries), retriever(plans), gate(plans, hits), composer(plans, hits, verdicts)."""
    plans = planner(queries)
    hits = retriever(plans)
    return composer(plans, hits, gate(plans, hits))


def cap_per_source(df: DataFrame, source: str, order: list[Column], cap: int, k: int) -> DataFrame:
    """At most `cap` rows of a source for each query, then the first k; the greedy choice in order is the same."""
    return top_k(top_k(df, ["query_id", source], order, cap).drop("rank"), ["query_id"], order, k)


def evidence_blocks(hits: DataFrame, text: str) -> DataFrame:
    """(query_id, evidence): numbered blocks in the order of ranks."""
    block = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col(text))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    return rows.select("query_id", F.array_join(F.transform("bs", lambda x: x["b"]), "\n---\n").alias("evidence"))


def lookup(x: Column, values: dict[str, float], default: float = 0.35) -> Column:
    """The number that a small table has for x."""
    out = F.when(F.lit(False), F.lit(0.0))
    for k, v in values.items():
        out = out.when(x == k, v)
    return out.otherwise(default)


def case_sql(x: str, values: dict[str, float], default: float = 0.35) -> str:
    """The same as SQL."""
    return f"(case {x} " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + f" else {default} end)::double"


def gap_filled(atoms: DataFrame, hits: DataFrame, search: Callable[[DataFrame], DataFrame], first: int = 3, more: int = 2, shortest: int = 120) -> DataFrame:
    """(query, covered_atoms, missing_atoms, stage2, sources): which pieces of knowledge the sources of a query cover, after a second search for the first one that none of the first sources does.

    atoms: (query, atom, terms), terms an array. hits: (query, url, tier, score, content, snippet) of the first search; of each URL its best row counts, and the `first` sources are taken, tier A before B, then by score,
    ties to the least URL. A source covers an atom if its content, of `shortest` characters at least, or its snippet holds one of the terms, in either case. search: takes (query, atom, terms) of the first missing
    atoms, and gives hits; `more` of these, with URLs that the first search didn't meet, fill the gap, and cover further atoms too. Null contents are empty.
    """
    order = [F.asc("tier"), F.desc("score"), F.asc("url")]
    rank = lambda d: d.withColumn("_n", F.row_number().over(W.partitionBy("query").orderBy(*order)))
    once = lambda d: d.withColumn("_u", F.row_number().over(W.partitionBy("query", "url").orderBy(*order))).where("_u = 1").drop("_u")

    def covers(sources: DataFrame) -> DataFrame:
        said = F.lower(F.concat_ws("\n", "content", "snippet"))
        sound = sources.where(F.char_length("content") >= shortest).select("query", said.alias("_said"))
        return sound.join(atoms, "query").where(F.exists("terms", lambda t: F.contains(F.col("_said"), F.lower(t)))).select("query", "atom").distinct()

    met = keep(once(hits))
    taken = keep(rank(met).where(F.col("_n") <= first).drop("_n"))
    covered = keep(covers(taken))
    open_ = atoms.join(covered, ["query", "atom"], "left_anti")
    gaps = keep(open_.groupBy("query").agg(F.min_by(F.struct("atom", "terms"), "atom").alias("g")).select("query", "g.atom", "g.terms"))
    further = once(search(gaps)).join(met.select("query", "url"), ["query", "url"], "left_anti")
    further = keep(rank(further).where(F.col("_n") <= more).drop("_n"))
    now = covered.unionByName(covers(further)).distinct().withColumn("_has", F.lit(True))
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("atom"))))
    out = atoms.join(now, ["query", "atom"], "left").groupBy("query").agg(names(F.col("_has").isNotNull()).alias("covered_atoms"), names(F.col("_has").isNull()).alias("missing_atoms"))
    count = taken.unionByName(further.select(*taken.columns)).groupBy("query").agg(F.count("*").alias("n"))
    out = out.join(gaps.select("query", F.lit(True).alias("_gap")), "query", "left").join(count, "query", "left")
    return out.select("query", "covered_atoms", "missing_atoms", F.coalesce("_gap", F.lit(False)).alias("stage2"), F.coalesce("n", F.lit(0)).alias("sources"))
