"""Queries of search, fusion, reranking and query planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import AUTHORITY, RECENCY
from ..operators import metadata as M
from ..operators import planning as PL
from ..operators import search as S
from ..operators.pages import first_rule
from ..operators.rounds import ResultCache, files_state, keep
from .registry import query, table

#: Leaders of the search, which many queries start from, by session, folder and what its files are.
CACHE = ResultCache()

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
#: BM25 of the benchmark's items over documents: hits(query_id, id, score, matched).
_BM25 = f"""
dt as (select doc_id as id, {_TOK} as ts from documents), d as (select id, len(ts) as len, unnest(ts) as term from dt), p as (select term, id, count(*) as tf, any_value(len) as len from d group by 1, 2), st as (select count(*) as n_docs, avg(len(ts)) as avg_len from dt),
qt as (select item_id as query_id, unnest({_TOK}) as term from benchmark), q as (select query_id, term, count(*) as qtf from qt group by 1, 2), df as (select term, count(*) as df from p group by 1),
hits as (select query_id, id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) as score, count(*) as matched from q join df using (term) join p using (term) cross join st group by 1, 2)"""
_FUSED = _BM25 + """, a as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from hits), b as (select query_id, id, matched::double as score, row_number() over (partition by query_id order by matched desc, id) as rank from hits),
l as (select *, 'bm25' as method, 1.0 as weight from a where rank <= 30 union all select *, 'overlap', 1.25 from b where rank <= 30), fused as (select query_id, id, round(sum(weight / (60 + rank))::double, 9) as rrf, max(score) as best, array_to_string(list_sort(list(distinct method)), '+') as methods from l group by 1, 2)"""


#: Rows that each method gives to fusion.
POOL = S.pool_size(6)


def _pool(spark, sf_dir):
    """Of each benchmark item, the documents that lead by BM25 or by the number of shared terms, `POOL` each and some more."""
    tokens = T.word_tokens(F.col("text"))
    make = lambda: S.bm25_top(table(spark, sf_dir, "benchmark"), "item_id", tokens, table(spark, sf_dir, "documents"), "doc_id", tokens, POOL, ("score", "matched"))
    state = files_state(spark, f"{sf_dir}/benchmark.parquet", f"{sf_dir}/documents.parquet")
    return CACHE.get((spark.sparkContext.applicationId, sf_dir, state), make)


def _top(spark, sf_dir, k: int):
    """(query_id, rank, id, score, matched): the k best by BM25, no more than `POOL`."""
    return S.ranked(_pool(spark, sf_dir), "score", k)


def _fused(spark, sf_dir):
    hits = _pool(spark, sf_dir)
    overlap = hits.select("query_id", "id", F.col("matched").cast("double").alias("score"))
    return S.reciprocal_ranks([("bm25", S.ranked(hits.select("query_id", "id", "score"), "score", POOL), 1.0), ("overlap", S.ranked(overlap, "score", POOL), 1.25)])


@query("r1_index_build", f"with t as (select doc_id, {_TOK} as ts from documents), e as (select doc_id, unnest(ts) as term from t) select term, count(distinct doc_id) as df, count(*) as cf from e group by 1")
def r1(spark, sf_dir):
    return S.term_counts(table(spark, sf_dir, "documents"), T.word_tokens(F.col("text")))


@query("r2_bm25_search", f"with {_BM25}, r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from hits) select query_id, rank, id, score, matched from r where rank <= 10")
def r2(spark, sf_dir):
    return _top(spark, sf_dir, 10).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score", "matched")


_GRAM = "list_concat(" + ", ".join("list_transform(range(1, length(text) - {0}), lambda i: substring(text, i, {1}))".format(n - 2, n) for n in (2, 3, 4)) + ")"


def _weights(name: str, source: str, i: str) -> str:
    return f"""{name}g as (select {i} as id, unnest({_GRAM}) as term from {source}), {name}f as (select id, term, count(*) as tf from {name}g group by 1, 2),
{name}w as (select id, term, (1 + ln(tf)) * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1) as w from {name}f join features using (term)), {name} as (select term, id, w / sqrt(sum(w * w) over (partition by id)) as weight from {name}w)"""


_TFIDF = f"features as (select term, count(*) as df, sum(tf) as cf from (select id, term, count(*) as tf from (select doc_id as id, unnest({_GRAM}) as term from documents) group by 1, 2) group by 1 order by cf desc, term limit 60000), {_weights('q', 'benchmark', 'item_id')}, {_weights('d', 'documents', 'doc_id')}"


@query("r3_tfidf_cosine", f"with {_TFIDF}, s as (select q.id as query_id, d.id, round(sum(q.weight * d.weight), 6) as score from q join d using (term) group by 1, 2), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s where score > 0) select query_id, rank, id, score from r where rank <= 5")
def r3(spark, sf_dir):
    """Benchmark items against an index of all documents, character 2- to 4-grams."""
    out = S.tfidf_top(table(spark, sf_dir, "benchmark"), "item_id", table(spark, sf_dir, "documents"), "doc_id", "text", 5)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score")


_DENSE = "with q as (select vec_id as query_id, embedding::double[] as qv from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id as id, round(list_inner_product(qv, embedding::double[]), 6) as score from q, embeddings), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s)"


@query("r4_dense_search", _DENSE + " select query_id, rank, id, score from r where rank <= 5")
def r4(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return S.dense_search(e.where("vec_id % 100 = 0"), "vec_id", e, "vec_id", "embedding", 5).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score")


@query("r6_reciprocal_rank_fusion", f"with {_FUSED} select query_id, id, rrf, best, methods from fused")
def r6(spark, sf_dir):
    return _fused(spark, sf_dir).withColumn("methods", F.array_join("methods", "+"))


_WORDS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'))"
_STATUS = "case when expiry_date < date '2025-06-01' then 'expired' when effective_date > date '2025-06-01' then 'upcoming' when expiry_date is null and effective_date is null then 'unknown' else 'active' end"
_RERANK = _FUSED + f""", m as ({M.META_SQL}), x as (select f.*, max(rrf) over (partition by query_id) as top from fused f), y as (select x.query_id, x.id, m.department, m.topics, m.audience, rrf / top as fusion, {_WORDS.format('b.text')} as q, {_WORDS.format('m.title')} as tw, {_WORDS.format('m.text')} as bw,
 {S.case_sql('authority_level', AUTHORITY)} as auth, {S.case_sql(_STATUS, RECENCY)} as recency from x join m on m.doc_id = x.id join benchmark b on b.item_id = x.query_id where admission_status = 'serving' and access_level = 'public'),
z as (select query_id, id, department, round(0.42 * fusion + 0.24 * len(list_intersect(q, tw)) / greatest(1, len(q)) + 0.10 * len(list_intersect(q, bw)) / greatest(1, len(q)) + 0.10 * auth + 0.07 * recency + 0.07 * (case when list_contains(topics, 'foreign') then 1 else 0.15 end + case when len(audience) = 0 or list_contains(audience, 'staff') then 1 else 0.3 end) / 2, 6)::double as score from y)"""


def _reranked(spark, sf_dir):
    fused = _fused(spark, sf_dir)
    top = fused.groupBy("query_id").agg(F.max("rrf").alias("top"))  # over all candidates, before filters
    meta = M.sources(table(spark, sf_dir, "documents")).where("admission_status = 'serving' and access_level = 'public'")
    words = lambda c: F.array_distinct(T.word_tokens(F.col(c))).alias(f"{c}_words")
    # each document of the pool is cut into words once, before it meets the queries that it leads for
    meta = meta.join(fused.select("id").distinct(), F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "department", "effective_date", "expiry_date", "authority_level", "topics", "audience", "title", "text").repartition(spark.sparkContext.defaultParallelism)  # the pool's documents, each once
    meta = meta.select("doc_id", "department", "effective_date", "expiry_date", "authority_level", "topics", "audience", words("title"), words("text"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words("text").alias("q_words"))
    rows = fused.join(top, "query_id").join(meta, F.col("id") == F.col("doc_id")).join(items, "query_id")
    status = M.temporal_status(F.col("effective_date"), F.col("expiry_date"), "2025-06-01")
    share = lambda c: T.coverage(F.col("q_words"), F.col(f"{c}_words"))
    score = 0.42 * F.col("rrf") / F.col("top") + 0.24 * share("title") + 0.10 * share("text") + 0.10 * S.lookup(F.col("authority_level"), AUTHORITY) + 0.07 * S.lookup(status, RECENCY) + 0.07 * _meta_match()
    return rows.select("query_id", "id", "department", F.round(score, 6).alias("score"))


def _meta_match():
    topic = F.when(F.array_contains("topics", "foreign"), 1.0).otherwise(0.15)
    audience = F.when((F.size("audience") == 0) | F.array_contains("audience", "staff"), 1.0).otherwise(0.3)
    return (topic + audience) / 2


@query("r8_metadata_rerank", f"with {_RERANK} select query_id, id, score from z")
def r8(spark, sf_dir):
    return _reranked(spark, sf_dir).select("query_id", "id", "score")


@query("r9_metadata_match", f"select source_id, round(((case when list_contains(topics, 'foreign') then 1 else 0.15 end + case when len(audience) = 0 or list_contains(audience, 'staff') then 1 else 0.3 end) / 2)::double, 6) as match from ({M.META_SQL})")
def r9(spark, sf_dir):
    return M.sources(table(spark, sf_dir, "documents")).select("source_id", F.round(_meta_match(), 6).alias("match"))


@query("r10_source_cap", f"with {_RERANK}, c as (select *, row_number() over (partition by query_id, department order by score desc, id) as n from z), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from c where n <= 2) select query_id, rank, id, department from r where rank <= 8")
def r10(spark, sf_dir):
    out = S.cap_per_source(_reranked(spark, sf_dir), "department", [F.desc("score"), F.asc("id")], 2, 8)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "department")


def word_coverage(queries: list[str], texts: list[str]) -> list[float]:
    """A scorer in place of a cross-encoder, as no model is at hand: the share of a query's words that the text has."""
    out = []
    for q, t in zip(queries, texts):
        asked, there = set(q.lower().split()), set(t.lower().split())
        out.append(len(asked & there) / max(1, len(asked)))
    return out


@query("r11_pair_scorer", rf"with {_BM25}, r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from hits), wd as (select query_id, rank, id, list_distinct(regexp_split_to_array(trim(lower(b.text), ' ' || chr(10) || chr(9)), '\s+')) as q, list_distinct(regexp_split_to_array(trim(lower(d.text), ' ' || chr(10) || chr(9)), '\s+')) as t from r join benchmark b on b.item_id = query_id join documents d on d.doc_id = id where rank <= 20), pairs as (select query_id, rank as first, id, round(len(list_intersect(q, t)) / greatest(1, len(q)), 6) as score from wd), k as (select *, row_number() over (partition by query_id order by score desc, first, id) as rank from pairs) select query_id, rank, id, score from k where rank <= 10")
def r11(spark, sf_dir):
    """Any scorer of lists of queries and whole texts takes the place of a cross-encoder; ties keep the order of the search."""
    hits = _top(spark, sf_dir, 20).withColumn("first", F.col("rank"))
    pairs = hits.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("a")), "query_id").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("b")), "id")
    out = S.rerank(pairs, "a", "b", word_coverage, [F.asc("first"), F.asc("id")], 10)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("rerank_score", 6).alias("score"))


def letter_shares(texts: list[str]) -> list[list[float]]:
    """An encoder in place of a model: how often each letter from a to z occurs."""
    return [[float(t.lower().count(chr(97 + i))) for i in range(26)] for t in texts]


_LETTERS = "[" + ", ".join(f"length(t) - length(replace(t, '{chr(97 + i)}', ''))" for i in range(26)) + "]::double[]"


@query("r5_encode", f"with v as (select item_id, {_LETTERS} as v from (select item_id, lower('query: ' || text) as t from benchmark)), n as (select item_id, v, sqrt(list_inner_product(v, v)) as n from v) select item_id, round((v[5] / n)::float::double, 4) as e, round((v[20] / n)::float::double, 4) as t, 26::bigint as dim from n")
def r5(spark, sf_dir):
    """Any encoder of lists of texts takes the place of a model; queries bear an instruction, vectors have length 1."""
    v = S.encode(table(spark, sf_dir, "benchmark"), "text", letter_shares, "query: ")
    at = lambda i: F.round(F.element_at("embedding", i).cast("double"), 4)
    return v.select("item_id", at(5).alias("e"), at(20).alias("t"), F.size("embedding").cast("long").alias("dim"))


@query("r12_web_rank", "select page_id, round(0.4 * case when contains(url, '.org') then 0.8 else 0.5 end + 0.6 * least(1.0, length(html) / 5000.0) + 0.05 * (page_id % 10) / 10.0, 6)::double as rank_score from pages")
def r12(spark, sf_dir):
    authority = F.when(F.contains("url", F.lit(".org")), 0.8).otherwise(0.5)
    score = 0.4 * authority + 0.6 * F.least(F.lit(1.0), F.char_length("html") / 5000.0) + 0.05 * (F.col("page_id") % 10) / 10.0
    return table(spark, sf_dir, "pages").select("page_id", F.round(score, 6).alias("rank_score"))


@query("r13_tiered_rank", "with t as (select page_id, regexp_replace(url, '[?#].*$', '') as u, regexp_extract(url, '://([^/]*)', 1) as h, case when contains(url, 'https') then 1 else 2 end as tier, length(html) as score from pages), f as (select *, row_number() over (partition by u order by tier, score desc, page_id) as n from t), r as (select *, row_number() over (partition by h order by tier, score desc, page_id) as rank from f where n = 1) select h, rank, page_id from r where rank <= 3")
def r13(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("u"), F.regexp_extract("url", "://([^/]*)", 1).alias("h"), F.when(F.contains("url", F.lit("https")), 1).otherwise(2).alias("tier"), F.char_length("html").alias("score"))
    order = [F.asc("tier"), F.desc("score"), F.asc("page_id")]
    first = S.top_k(rows, ["u"], order, 1).drop("rank")
    return S.top_k(first, ["h"], order, 3).select("h", F.col("rank").cast("long").alias("rank"), "page_id")


_PLAN = PL.Lexicon(
    {"article": ("the ", "an "), "relation": ("of ",)}, {"letters": ("tion", "ness"), "words": ("whou", "ther"), "ends": ("ing",)}, ("thand", "onon"), ("ed",), ("re", "st"), ((("er",), " and who may"), (("in",), " and its papers"), (("ti",), " and its day")), " and its steps", ("now", "at "), (("he", "him"), ("ha", "her")),
    clauses=r"\.\s|\n|;", trimmed=r"^[ ?,.]+|[ ?,.]+$",
)
_IN = lambda ws: "regexp_matches(q, '" + "|".join(ws) + "')"
_LIST = lambda pairs: "list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in pairs) + "], lambda x: x is not null)"


@query("r14_query_plan", rf"""
with u as (select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) as q, case when conv_id % 6 = 0 then 'FAST' when conv_id % 6 = 1 then 'FULL' end as forced from conversations where role = 'user'),
t as (select *, list_sort({_LIST([(n, " or ".join(f"contains(lower(q), '{w}')" for w in (n, *ws))) for n, ws in _PLAN.aliases.items()])}) as terms, {_LIST([(n, _IN(ws)) for n, ws in _PLAN.topics.items()])} as topics, {_IN(_PLAN.procedures)} as act from u),
w as (select *, list_filter(terms, lambda x: not contains(q, x)) as new, {_LIST([("complex_intent_marker", _IN(_PLAN.complex)), ("cross_topic", "len(topics) > 1"), ("long_query", "length(q) > 45"), ("actionable_procedure", f"act and {_IN(_PLAN.asking)}")])} as why from t),
p as (select *, case when len(new) > 0 then q || ' (terms: ' || array_to_string(new, ', ') || ')' else q end as rewritten, coalesce(forced, case when len(why) > 0 then 'FULL' else 'FAST' end) as path, list_sort(list_filter(list_concat(why, ['user_selected_' || lower(forced)]), lambda x: x is not null)) as reasons from w),
c as (select *, case when path = 'FULL' then list_filter(list_transform(regexp_split_to_array(q, '\.\s|\n|;'), lambda s: regexp_replace(s, '^[ ?,.]+|[ ?,.]+$', '', 'g')), lambda s: length(s) >= 3) else [rewritten] end as parts, coalesce(terms[1], q) as subject from p),
a as (select *, list_filter([case when {_IN(("er",))} then subject || ' and who may' end, case when {_IN(("in",))} then subject || ' and its papers' end, case when {_IN(("ti",))} then subject || ' and its day' end], lambda x: x is not null) as asp from c),
s as (select *, (case when path = 'FULL' and act and len(parts) = 1 then case when len(asp) > 0 then asp else [subject || ' and its steps'] end else parts end)[1:4] as subs from a)
select conv_id, turn, path, array_to_string(reasons, ',') as reasons, array_to_string(topics, ',') as topics, array_to_string(terms, ',') as terms, case when len(subs) > 0 then len(list_distinct(subs)) else 1 end::bigint as n_subqueries, sha256(case when len(subs) > 0 then subs[1] else rewritten end) as first_sha256, act as wants_action, {_IN(_PLAN.current)} as current_only from s""")
def r14(spark, sf_dir):
    """Plans by a lexicon of the driver's language; fixtures test one of Han words."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("id"), "text", F.when(F.col("conv_id") % 6 == 0, "fast").when(F.col("conv_id") % 6 == 1, "full").alias("forced"))
    out = PL.plan_queries(rows, "id", "text", _PLAN, "forced")
    return out.select("id.conv_id", "id.turn", "path", *[F.array_join(c, ",").alias(c) for c in ("reasons", "topics", "terms")], F.size("subqueries").cast("long").alias("n_subqueries"), F.sha2(F.element_at("subqueries", 1), 256).alias("first_sha256"), "wants_action", "current_only")


#: Rules of understanding: a name, what a query says, and what is added to it.
_RULES = [("who", r"(?i)\bwh", ("person", "name")), ("when", r"(?i)\bat\b", ("date", "name")), ("digit", r"\d", ("number",)), ("ing", r"ing\b", ("action",)), ("no", r"(?i)zzzz", ("never",))]


@query("r15_query_understanding", "with u as (select conv_id, turn, text, lag(text, 1) over w as p1, lag(text, 2) over w as p2 from conversations where role = 'user' window w as (partition by conv_id order by turn)), e as (select *, p1 is not null and length(text) < 80 as needs, case when p1 is not null and length(text) < 80 then coalesce(p2 || ' ', '') || p1 || ' ' || text else text end as eff from u), k as (select *, list_filter([" + ", ".join(f"case when regexp_matches(eff, '{p}') then '{n}' end" for n, p, _ in _RULES) + "], lambda x: x is not null) as rules, list_filter([" + ", ".join(f"case when regexp_matches(eff, '{p}') and not contains(eff, '{w}')" + "".join(f" and not regexp_matches(eff, '{o}')" for m, o, ws in _RULES[:i] if w in ws) + f" then '{w}' end" for i, (_, p, add) in enumerate(_RULES) for w in add) + "], lambda x: x is not null) as more from e) select conv_id, turn, needs as needs_context, array_to_string(rules, ',') as rules, sha256(case when len(more) > 0 then eff || ' ' || array_to_string(more, ' ') else eff end) as effective_sha256 from k")
def r15(spark, sf_dir):
    """A short query takes up to two earlier ones before it; each rule that it meets adds its words, once."""
    out = PL.with_context(table(spark, sf_dir, "conversations").where("role = 'user'"), "conv_id", "turn", "text", 2, 80)
    names, effective = PL.expanded(F.col("effective"), _RULES)
    return out.select("conv_id", "turn", "needs_context", F.array_join(names, ",").alias("rules"), F.sha2(effective, 256).alias("effective_sha256"))


@query("r16_router", r"with s as (select conv_id, turn, 3 * len(regexp_extract_all(lower(text), '\b(?:today|latest|news)\b')) as web, 2 * len(regexp_extract_all(lower(text), '\b(?:pdf|file|document)\b')) as file, len(regexp_extract_all(lower(text), '\d+')) as math from conversations where role = 'user') select conv_id, turn, case when greatest(web, file, math) < 2 then 'local' when web = greatest(web, file, math) then 'web' when file = greatest(web, file, math) then 'file' else 'math' end as route from s")
def r16(spark, sf_dir):
    rules = {"web": (r"\b(?:today|latest|news)\b", 3), "file": (r"\b(?:pdf|file|document)\b", 2), "math": (r"\d+", 1)}
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", PL.route(F.col("text"), rules, 2, "local").alias("route"))


_ORDERED = [("LOCAL_PUBLIC", "whou|onon"), ("ACADEMIC_RETRIEVAL", r"thint|\d"), ("GENERAL_WEB", "thand")]


@query("r16_keyword_router", "select conv_id, turn, case when regexp_matches(low, '^[0-9]+[-+*/][0-9]+$') then 'NO_WEB_NEEDED' " + " ".join(f"when regexp_matches(low, '{p}') then '{n}'" for n, p in _ORDERED) + " when length(low) < 4 then 'UNCERTAIN' else 'GENERAL_WEB' end as route from (select conv_id, turn, case when turn % 7 = 0 then '12*3' when turn % 5 = 0 then 'ab' else trim(lower(text)) end as low from conversations)")
def r16_keyword(spark, sf_dir):
    text = F.when(F.col("turn") % 7 == 0, "12*3").when(F.col("turn") % 5 == 0, "ab").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", PL.keyword_route(text, _ORDERED).alias("route"))


_HAS = lambda ws: "(" + " + ".join(f"contains(low, '{w}')::int" for w in ws) + ")"
_SUBJECTS, _TASKS, _HERE, _NOW = {"a": ("whou", "tily"), "b": ("thint",)}, ("thand", "ouing"), ("onon", "haer"), ("erha", "anor")


@query("r16_intent_router", f"""with l as (select conv_id, turn, trim(lower(text)) as low from conversations), c as (select *, 2 * ({_HAS(_SUBJECTS['a'])} + {_HAS(_SUBJECTS['b'])}) as dom, {_HAS(_TASKS)} as task, case when regexp_matches(low, '\\d') then 3 else 0 end + case when regexp_matches(low, 'select|def ') then 3 else 0 end as form, 3 * {_HAS(_HERE)} as here, 2 * {_HAS(_NOW)} as now from l),
s as (select *, dom + least(6, 2 * task) + form as academic from c), k as (select *, academic >= 3 and (dom >= 2 or form > 0 or task >= 1) as aca, list_reverse_sort([academic, here, greatest(1, now)]) as r from s)
select conv_id, turn, case when now > 0 and here < 3 and task = 0 and form = 0 then 'GENERAL_WEB' when aca then 'ACADEMIC_RETRIEVAL' when here >= 3 and not (aca and task > 0) then 'LOCAL_PUBLIC' else 'GENERAL_WEB' end as mode, academic::bigint as academic, here::bigint as local, now::bigint as current, (r[1] - r[2])::bigint as margin from k""")
def r16_intent(spark, sf_dir):
    r = PL.intent_route(F.col("text"), _SUBJECTS, _TASKS, r"\d", "select|def ", _HERE, _NOW)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.mode", *[F.col(f"r.{c}").cast("long").alias(c) for c in ("academic", "local", "current", "margin")])


@query("r16_file_router", r"""with u as (select conv_id, turn, lower(text) as low, case turn % 4 when 1 then 'a.pdf' when 2 then 'b.XLSX' when 3 then 'notes.txt' end as up from conversations), k as (select *, up is not null or regexp_matches(low, 'whou|onon') as want, case when regexp_matches(low, 'thint') then 'pptx' when regexp_matches(low, 'sheet') then 'xlsx' when regexp_matches(low, 'qqq') then 'docx' when regexp_matches(low, 'pdf') then 'pdf' when up = 'a.pdf' then 'pdf' when up = 'b.XLSX' then 'xlsx' else 'docx' end as f, case when up is not null and regexp_matches(low, 'tion') and not regexp_matches(low, 'ouing') then 'read' when up is not null and regexp_matches(low, 'thand') then 'create' when up is not null or regexp_matches(low, 'ouing') then 'modify' else 'create' end as a from u)
select conv_id, turn, case when want then 'file_tool' else 'rag_qa' end as route, case when want then a end as action, case when want then f end as format, case when want then case f when 'docx' then 'word_file_tool' when 'xlsx' then 'excel_file_tool' when 'pptx' then 'powerpoint_file_tool' else 'pdf_file_tool' end end as tool from k""")
def r16_file(spark, sf_dir):
    t = F.col("turn") % 4
    upload = F.when(t == 1, "a.pdf").when(t == 2, "b.XLSX").when(t == 3, "notes.txt")
    r = PL.file_route(F.col("text"), upload, {"pptx": ("thint",), "xlsx": ("sheet",), "docx": ("qqq",), "pdf": ("pdf",)}, ("whou", "onon"), ("tion",), ("ouing",), ("thand",))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.*")


@query("r17_evidence_blocks", f"with {_BM25}, r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from hits) select query_id, sha256(string_agg('[' || rank || '] ' || text, chr(10) || '---' || chr(10) order by rank)) as evidence_sha256 from r join documents d on d.doc_id = r.id where rank <= 5 group by 1")
def r17(spark, sf_dir):
    hits = _top(spark, sf_dir, 5).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return S.evidence_blocks(hits, "text").select("query_id", F.sha2("evidence", 256).alias("evidence_sha256"))


@query("r19_outside_top_k", _DENSE + " select query_id, rank - 5 as rank, id, case when score >= 0.7 then 'FOUND' when score < 0.6 then 'NOT_FOUND' else 'AMBIGUOUS' end as status from r where rank between 6 and 15")
def r19(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    wide = S.dense_search(e.where("vec_id % 100 = 0"), "vec_id", e, "vec_id", "embedding", 25)
    status = first_rule([("FOUND", F.col("score") >= 0.7), ("NOT_FOUND", F.col("score") < 0.6)], "AMBIGUOUS")
    return wide.where("rank between 6 and 15").select("query_id", (F.col("rank") - 5).cast("long").alias("rank"), "id", status.alias("status"))


def _hits(q: str, source: str) -> str:
    return f"""{q}t as (select query_id, unnest({_TOK}) as term from {source}), {q}q as (select query_id, term, count(*) as qtf from {q}t group by 1, 2),
{q}hits as (select query_id, id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) as score from {q}q join df using (term) join p using (term) cross join st group by 1, 2)"""


_ATOMS = r"""atoms as (select item_id as query_id, i as atom, [ws[i]] as terms from (select item_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}'))) as ws from benchmark), unnest(range(1, 1 + least(4, len(ws)))) as t(i))"""


@query("r13_gap_filled", f"""
with {_BM25}, {_ATOMS}, docs as (select doc_id as id, lower(text) as said, length(text) as n, 1 + doc_id % 3 as tier from documents),
one as (select query_id, h.id, tier, score, row_number() over (partition by query_id order by tier, score desc, h.id::varchar) as n from (select * from (select *, row_number() over (partition by query_id order by score desc, id) as k from hits) where k <= 8) h join docs using (id)),
ca as (select distinct query_id, atom from one join docs using (id) join atoms using (query_id) where one.n <= 3 and docs.n >= 120 and len(list_filter(terms, lambda t: contains(said, t))) > 0),
gaps as (select query_id, min(atom) as atom from atoms where (query_id, atom) not in (select query_id, atom from ca) group by 1), asks as (select query_id, array_to_string(terms, ' ') || ' formula definition theorem' as text from gaps join atoms using (query_id, atom)),
{_hits('g', 'asks')},
two as (select query_id, id from (select query_id, h.id, row_number() over (partition by query_id order by tier, score desc, h.id::varchar) as n from (select * from (select *, row_number() over (partition by query_id order by score desc, id) as k from ghits) where k <= 8) h join docs using (id) where (query_id, h.id) not in (select query_id, id from one)) where n <= 2),
cb as (select * from ca union select distinct query_id, atom from two join docs using (id) join atoms using (query_id) where docs.n >= 120 and len(list_filter(terms, lambda t: contains(said, t))) > 0),
s as (select query_id, count(*) as n from (select query_id, id from one where n <= 3 union all select query_id, id from two) group by 1)
select a.query_id as item_id, array_to_string(list_sort(coalesce(list(a.atom) filter (where cb.atom is not null), [])), ',') as covered, array_to_string(list_sort(coalesce(list(a.atom) filter (where cb.atom is null), [])), ',') as missing, bool_or(a.query_id in (select query_id from gaps)) as stage2, any_value(coalesce(s.n, 0)) as sources
from atoms a left join cb on cb.query_id = a.query_id and cb.atom = a.atom left join s on s.query_id = a.query_id group by 1""")
def r13_gaps(spark, sf_dir):
    """Items as problems, their long words as pieces of knowledge, documents as pages, dealt to three tiers by number; the second search is BM25 for the words that are missing."""
    tokens = T.word_tokens(F.col("text"))
    docs = table(spark, sf_dir, "documents")
    words = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{9,})"), 1))), 1, 4)
    atoms = keep(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.posexplode(words).alias("i", "w")).select("query", (F.col("i") + 1).alias("atom"), F.array("w").alias("terms")))
    page = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("url"), (1 + F.col("doc_id") % 3).alias("tier"), F.col("text").alias("content"), F.lit(None).cast("string").alias("snippet"))

    def hits(found):
        return found.select(F.col("query_id").alias("query"), "id", "score").join(page, "id").drop("id")

    def search(gaps):
        asked = gaps.select(F.col("query").alias("query_id"), F.concat(F.array_join("terms", " "), F.lit(" formula definition theorem")).alias("text"))
        return hits(S.ranked(S.bm25_top(asked, "query_id", tokens, docs, "doc_id", tokens, 8, ("score",)), "score", 8))

    out = S.gap_filled(atoms, hits(_top(spark, sf_dir, 8)), search)
    joined = lambda c: F.array_join(F.transform(c, lambda a: a.cast("string")), ",")
    return out.select(F.col("query").alias("item_id"), joined("covered_atoms").alias("covered"), joined("missing_atoms").alias("missing"), "stage2", "sources")
