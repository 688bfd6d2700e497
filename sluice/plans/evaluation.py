"""Queries of metrics, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metadata as M
from ..operators import metrics as G
from ..operators import sampling as P
from ..operators import search as S
from .registry import query, table

_PRED = "with p as (select doc_id, quality as expected, (n_chars % 7 > 1)::int as predicted from labels join documents using (doc_id))"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _pred(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(_docs(spark, sf_dir), "doc_id").select("doc_id", F.col("quality").alias("expected"), (F.col("n_chars") % 7 > 1).cast("int").alias("predicted"))


@query("g1_frequencies", "select lang, source, count(*) as n from documents group by grouping sets ((lang, source), (lang), ())")
def g1(spark, sf_dir):
    return _docs(spark, sf_dir).rollup("lang", "source").agg(F.count("*").alias("n"))


@query("g2_multi_label_counts", "with t as (select doc_id, source, unnest(list_filter([case when contains(lower(text), 'license') then 'license' end, lang, case when n_chars > 5000 then 'long' end], lambda x: x is not null)) as topic from documents) select topic, count(distinct source) as sources, count(*) as n from t group by 1")
def g2(spark, sf_dir):
    topics = F.array_compact(F.array(F.when(F.lower("text").contains("license"), "license"), F.col("lang"), F.when(F.col("n_chars") > 5000, "long")))
    return _docs(spark, sf_dir).select("source", F.explode(topics).alias("topic")).groupBy("topic").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("n"))


@query("g3_coverage_score", "with c as (select lang, round((0.40 * least(1, count(*) / 200.0) + 0.20 * avg((n_chars > 500)::int) + 0.20 * least(1, count(distinct source) / 20.0) + 0.15 * avg((text like '%.%')::int) + 0.05 * max((n_chars > 5000)::int))::double, 6) as score from documents group by 1) select lang, score, case when score >= 0.75 then 'ROBUST' when score >= 0.4 then 'PARTIAL' else 'GAP' end as status from c")
def g3(spark, sf_dir):
    n = F.col("n_chars")
    score = 0.40 * F.least(F.lit(1.0), F.count("*") / 200.0) + 0.20 * F.avg((n > 500).cast("int")) + 0.20 * F.least(F.lit(1.0), F.count_distinct("source") / 20.0) + 0.15 * F.avg(F.col("text").contains(".").cast("int")) + 0.05 * F.max((n > 5000).cast("int"))
    out = _docs(spark, sf_dir).groupBy("lang").agg(F.round(score, 6).alias("score"))
    return out.withColumn("status", F.when(F.col("score") >= 0.75, "ROBUST").when(F.col("score") >= 0.4, "PARTIAL").otherwise("GAP"))


_INTENTS = [("licence", "license", "released", 5), ("secret", "token", "secret", 20), ("articles", "the", "and", 20), ("nowhere", "qqqq", "zzzz", 1)]
_NEAR = " or ".join("(intent = '{0}' and (regexp_matches(lower(text), '(?s){1}.{{0,{3}}}{2}') or regexp_matches(lower(text), '(?s){2}.{{0,{4}}}{1}')))".format(n, a, b, 400 - len(a), 400 - len(b)) for n, a, b, _ in _INTENTS)


@query("g4_intent_coverage", "with i as (select * from (values " + ", ".join(f"('{n}', {k})" for n, _, _, k in _INTENTS) + f") t(intent, minimum)), m as ({M.META_SQL}), h as (select intent, source_id as id, coalesce(effective_date, case when doc_id % 2 = 0 then publish_date end) as day from i join m on {_NEAR}), r as (select *, coalesce(year(day) >= 2024, false) as recent from h), p as (select *, row_number() over (partition by intent order by recent desc, day desc nulls last, id desc) as place from r)" + " select intent, case when count(id) >= any_value(minimum) then 'READY' when count(id) > 0 then 'PARTIAL' else 'GAP' end as status, count(id) as sources, coalesce(count(*) filter (where recent), 0) as recent, count(*) filter (where id is not null and day is null) as undated, coalesce(string_agg(id, ',' order by place) filter (where place <= 8), '') as first from i left join p using (intent) group by 1")
def g4(spark, sf_dir):
    intents = spark.createDataFrame([(n, [a], [b], k) for n, a, b, k in _INTENTS], "intent string, subjects array<string>, actions array<string>, minimum int")
    day = F.coalesce("effective_date", F.when(F.col("doc_id") % 2 == 0, F.col("publish_date")))
    out = G.intent_coverage(M.sources(_docs(spark, sf_dir)), intents, "source_id", F.col("text"), day, "2025-06-01")
    return out.withColumn("first", F.array_join("first", ","))


_CLASS = _PRED + """, c as (select expected, predicted, count(*) as n from p group by 1, 2), l as (select distinct expected as label from c union select predicted from c), s as (select label, (select coalesce(sum(n), 0) from c where expected = label) as support, (select coalesce(sum(n), 0) from c where predicted = label) as named, (select coalesce(sum(n), 0) from c where expected = label and predicted = label) as tp from l)
select label, support::bigint as support, {p} as precision, {r} as recall, {f} as f1 from s"""


@query("g5_class_scores", _CLASS.format(p="round(tp / nullif(named, 0), 6)", r="round(tp / nullif(support, 0), 6)", f="round(2 * tp / nullif(named + support, 0), 6)"))
def g5(spark, sf_dir):
    return G.class_scores(_pred(spark, sf_dir), "expected", "predicted")


_RANKS = "with q as (select vec_id as query_id, label as ql, embedding::double[] as qv from embeddings where vec_id % 100 = 0), s as (select query_id, ql, vec_id as id, e.label, round(list_inner_product(qv, embedding::double[]), 6) as score from q, embeddings e where vec_id <> query_id), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s), f as (select query_id, min(rank) filter (where label = ql and rank <= {k}) as first_rank from r group by 1)"


def _ranks(spark, sf_dir, k):
    e = table(spark, sf_dir, "embeddings")
    hits = S.dense_search(e.where("vec_id % 100 = 0"), "vec_id", e, "vec_id", "embedding", k + 1).where("id <> query_id")
    label = e.select("vec_id", "label")
    rows = hits.join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").join(label.select(F.col("vec_id").alias("id"), "label"), "id")
    rows = S.top_k(rows.drop("rank"), ["query_id"], [F.desc("score"), F.asc("id")], k)
    return rows.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("ql"), F.col("rank"))).alias("first_rank"))


@query("g6_recall_mrr", _RANKS.format(k=10) + " select count(*) as queries, round(avg(coalesce((first_rank <= 1)::int, 0)), 6) as recall_1, round(avg(coalesce((first_rank <= 5)::int, 0)), 6) as recall_5, round(avg(coalesce((first_rank <= 10)::int, 0)), 6) as recall_10, round(avg(coalesce(1.0 / first_rank, 0)), 6)::double as mrr from f")
def g6(spark, sf_dir):
    return G.recall_and_mrr(_ranks(spark, sf_dir, 10), [1, 5, 10])


@query("g7_rescue_flags", _RANKS.format(k=5) + ", w as (select query_id, min(rank) filter (where label = ql and rank <= 10) as wide from r group by 1) select count(*) filter (where first_rank is null and wide is not null) as rescued, count(*) filter (where first_rank is not null) as kept from f join w using (query_id)")
def g7(spark, sf_dir):
    wide = _ranks(spark, sf_dir, 10)
    return wide.agg(F.count_if((F.col("first_rank") > 5)).alias("rescued"), F.count_if(F.col("first_rank") <= 5).alias("kept"))


@query("g8_percentiles", "with n as (select lang, n_chars, row_number() over (partition by lang order by n_chars) as i, count(*) over (partition by lang) as c from documents) select lang, round(quantile_cont(n_chars, 0.95), 6) as linear, max(n_chars) filter (where i = greatest(1, ceil(c * 0.95)::bigint)) as nearest from n group by 1")
def g8(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    linear = docs.groupBy("lang").agg(F.round(F.percentile("n_chars", 0.95), 6).alias("linear"))
    return linear.join(G.nearest_rank(docs, ["lang"], "n_chars", 0.95).withColumnRenamed("value", "nearest"), "lang")


@query("g9_answer_summary", "select role, count(*) as n, round(avg(length(text)), 6) as mean_chars, median(length(text))::double as median_chars, round(avg((length(text) > 300)::int), 6) as long_share from conversations group by 1")
def g9(spark, sf_dir):
    n = F.char_length("text")
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_chars"), F.median(n).alias("median_chars"), F.round(F.avg((n > 300).cast("int")), 6).alias("long_share"))


@query("g10_hash_of_set", "select lang, sha256(array_to_string(list_sort(list(distinct source)), '|')) as sources_sha256 from documents group by 1")
def g10(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang").agg(G.hash_of_set(F.col("source")).alias("sources_sha256"))


@query("g11_paired_outcomes", "select doc_id, case when a and b then 'both' when b then 'win' when a then 'regression' else 'neither' end as outcome from (select doc_id, quality = 1 as a, (n_chars % 7 > 1) as b from labels join documents using (doc_id))")
def g11(spark, sf_dir):
    p = _pred(spark, sf_dir)
    return G.paired(p.select("doc_id", (F.col("expected") == 1).alias("ok")), p.select("doc_id", (F.col("predicted") == 1).alias("ok")), "doc_id", "ok")


@query("g12_lists_per_source", "select source, count(*) as n, sha256(string_agg(doc_id::varchar, ',' order by doc_id)) as ids_sha256 from documents group by 1")
def g12(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("doc_id")).alias("ids")).select("source", "n", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"))


@query("g13_reconciliation", "select d.doc_id, coalesce(l.quality, (d.n_chars > 300)::int) as value, case when l.quality is null then 'original' when l.quality = (d.n_chars > 300)::int then 'confirmed' else 'changed' end as status from documents d left join labels l using (doc_id)")
def g13(spark, sf_dir):
    rows = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("o", (F.col("n_chars") > 300).cast("int"))
    status = F.when(F.col("quality").isNull(), "original").when(F.col("quality") == F.col("o"), "confirmed").otherwise("changed")
    return rows.select("doc_id", F.coalesce("quality", "o").alias("value"), status.alias("status"))


@query("g14_zero_division", _CLASS.replace("from labels join documents using (doc_id))", "from labels join documents using (doc_id) where quality = 1)").format(p="round(coalesce(tp / nullif(named, 0), 0), 6)", r="round(coalesce(tp / nullif(support, 0), 0), 6)", f="round(coalesce(2 * tp / nullif(named + support, 0), 0), 6)"))
def g14(spark, sf_dir):
    return G.class_scores(_pred(spark, sf_dir).where("expected = 1"), "expected", "predicted", 0.0)


@query("g15_label_pairs", "with l as (select doc_id, unnest(list_filter([lang, source, case when n_chars > 3000 then 'long' end], lambda x: x is not null)) as l from documents) select a.l as a, b.l as b, count(*) as n from l a join l b on a.doc_id = b.doc_id and a.l < b.l group by 1, 2")
def g15(spark, sf_dir):
    return G.label_pairs(_docs(spark, sf_dir).select(F.array_compact(F.array("lang", "source", F.when(F.col("n_chars") > 3000, "long"))).alias("l")), "l")


@query("g16_leakage_groups", "with q as (select sha256(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))) as h from conversations where role = 'user'), g as (select h, count(*) as n from q group by 1) select count(*) as queries, count(*) filter (where n > 1) as repeated, sum(n)::bigint as n_rows from g")
def g16(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy(F.sha2(T.norm(F.col("text")), 256).alias("h")).agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("queries"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum("n").alias("n_rows"))


@query("g16_registry_leaks", rf"""
with q as (select conv_id || '/' || turn as id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '', 'g') as k, sha256(text) as raw from conversations where role = 'user' union all select 'item/' || item_id, regexp_replace(lower(text || '?'), '[^\p{{L}}\p{{N}}]+', '', 'g'), sha256(text || '?') from benchmark where item_id % 3 = 0),
r as (select distinct sha256(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '', 'g')) as k, sha256(text) as raw from benchmark)
select sha256(k) as group_hash, count(*) as n, min(id) as first_id, sha256(k) in (select k from r) as in_registry, bool_or(q.raw in (select raw from r)) as verbatim from q group by k having count(*) > 1 or sha256(k) in (select k from r)""")
def g16_registry(spark, sf_dir):
    """Questions that come again, or that a registry has: users' turns, and every third item with a mark added, against the benchmark."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark")
    q = q.unionByName(items.where("item_id % 3 = 0").select(F.concat(F.lit("item/"), "item_id").alias("id"), F.concat("text", F.lit("?")).alias("text")))
    return G.leaks(q, "id", "text", items, "text")


@query("w2_cap_per_group", "select doc_id, source from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as n from documents) where n <= 2")
def w2(spark, sf_dir):
    return P.first_per(_docs(spark, sf_dir), ["source"], [F.desc("n_chars"), "doc_id"], 2).select("doc_id", "source")


@query("w3_round_robin", "select doc_id, lang, row_number() over (partition by lang order by doc_id) as turn from documents")
def w3(spark, sf_dir):
    return P.round_robin(_docs(spark, sf_dir), "lang", ["doc_id"]).select("doc_id", "lang", F.col("turn").cast("long").alias("turn"))


@query("w4_quota", "with q as (select lang, 20 as quota from documents group by 1), r as (select *, row_number() over (partition by lang order by sha256('quota:' || doc_id)) as n from documents) select doc_id, lang from r join q using (lang) where n <= ceil(quota * 1.1)")
def w4(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    quotas = docs.select("lang").distinct().withColumn("quota", F.lit(20))
    return P.with_quota(docs, quotas, "lang", [P.seeded("quota", F.col("doc_id"))]).select("doc_id", "lang")


@query("w5_largest_remainder", "with c as (select source, count(*) as n from documents group by 1), e as (select source, n * 137.0::double / sum(n) over () as x from c), f as (select source, floor(x) as fl, round(x - floor(x), 9) as rest from e), g as (select *, 137 - sum(fl) over () as lft, row_number() over (order by rest desc, source) as i from f) select source, (fl + (i <= lft)::int)::bigint as quota from g")
def w5(spark, sf_dir):
    return P.allocate(_docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")), "source", "n", 137)


@query("w6_hash_order", "select doc_id, row_number() over (partition by source order by sha256('seed:' || doc_id)) as place from documents")
def w6(spark, sf_dir):
    from pyspark.sql import Window as W

    return _docs(spark, sf_dir).select("doc_id", F.row_number().over(W.partitionBy("source").orderBy(P.seeded("seed", F.col("doc_id")))).cast("long").alias("place"))


@query("w7_source_split", "select doc_id, ('0x' || substring(sha256(source), 1, 8))::bigint % 10 as part from documents")
def w7(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", P.hash_split(F.col("source")).alias("part"))


@query("w8_folds", "select doc_id, (row_number() over (partition by lang order by sha256('fold:' || doc_id)) - 1) % 5 as fold from documents")
def w8(spark, sf_dir):
    return P.folds(_docs(spark, sf_dir), "lang", P.seeded("fold", F.col("doc_id")), 5).select("doc_id", F.col("fold").cast("long").alias("fold"))


@query("w9_even_sample", "with n as (select doc_id, lang, row_number() over (partition by lang order by doc_id) - 1 as i, count(*) over (partition by lang) as c from documents) select doc_id, lang from n where list_contains(list_transform(range(0, 5), lambda k: round_even(k * (c - 1) / 4, 0)::bigint), i)")
def w9(spark, sf_dir):
    return P.evenly_spaced(_docs(spark, sf_dir), "lang", "doc_id", 5).select("doc_id", "lang")


@query("w10_diverse_sample")
def w10(spark, sf_dir):
    """Each choice depends on those before it; a fixture tests it."""
    rows = _docs(spark, sf_dir).select("doc_id", "lang", "source", (F.col("n_chars") % 5).alias("kind"))
    return P.diverse(rows, "lang", "doc_id", ["source", "kind"], 10).select("doc_id", "lang")


@query("w11_weighted_families", "select doc_id, lang from (select doc_id, lang, row_number() over (order by -ln((('0x' || substring(sha256('w:' || doc_id), 1, 8))::bigint + 1) / 4294967297.0) / case lang when 'en' then 1 else 3 end, doc_id) as n from documents) where n <= 100")
def w11(spark, sf_dir):
    u = (F.conv(F.substring(P.seeded("w", F.col("doc_id")), 1, 8), 16, 10).cast("long") + 1) / 4294967297.0
    key = -F.log(u) / F.when(F.col("lang") == "en", 1).otherwise(3)
    return _docs(spark, sf_dir).select("doc_id", "lang", key.alias("k")).orderBy("k", "doc_id").limit(100).select("doc_id", "lang")


_POINT = "('0x' || substring(sha256('epochs:3:{f}:' || i), 1, 15))::bigint % (select sum(w)::bigint from r where family = '{f}')"


@query("w11_families_with_replacement", f"""
with r as (select doc_id, case when lang = 'en' then 'english' else 'other' end as family, 1 + doc_id % 3 as w from documents), s as (select *, sum(w) over (partition by family order by doc_id) - w as start from r), n as (select count(*) as n, round(count(*) * 0.35)::bigint as k from documents),
d as (select 'english' as family, i as draw, {_POINT.format(f='english')} as point from n, range((select k from n)) t(i) union all select 'other', i, {_POINT.format(f='other')} from n, range((select n - k from n)) t(i))
select d.family, draw, doc_id from d join s on d.family = s.family and start <= point and point < start + w""")
def w11_epochs(spark, sf_dir):
    """An epoch of as many draws as there are documents, 35 % of them English ones, each document weighing 1 to 3."""
    docs = _docs(spark, sf_dir)
    n = docs.count()
    k = int(n * 0.35 + 0.5)
    family = F.when(F.col("lang") == "en", "english").otherwise("other")
    return P.drawn(docs, "doc_id", family, 1 + F.col("doc_id") % 3, {"english": k, "other": n - k}, "epochs", 3).withColumnRenamed("id", "doc_id")


@query("w12_novel_first", "with r as (select doc_id, lang, source, row_number() over (partition by lang, source order by doc_id) as n from documents) select doc_id, n as repeat_no from r where n <= 3")
def w12(spark, sf_dir):
    rows = P.round_robin(_docs(spark, sf_dir).withColumn("combo", F.concat_ws("/", "lang", "source")), "combo", ["doc_id"])
    return rows.where("turn <= 3").select("doc_id", F.col("turn").cast("long").alias("repeat_no"))


@query("w13_last_n", "select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 3")
def w13(spark, sf_dir):
    return P.first_per(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn")


@query("w14_running_context", "select conv_id, turn, sha256(coalesce(string_agg(text, chr(10)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), '')) as context_sha256 from conversations")
def w14(spark, sf_dir):
    return P.context_before(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.sha2("context", 256).alias("context_sha256"))


@query("w16_priority_queue", "select page_id, row_number() over (order by page_id % 7 desc, length(url), page_id) as place from pages order by place limit 25")
def w16(spark, sf_dir):
    from pyspark.sql import Window as W

    top = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 7).alias("p"), F.char_length("url").alias("d")).orderBy(F.desc("p"), "d", "page_id").limit(25)
    return top.select("page_id", F.row_number().over(W.orderBy(F.desc("p"), "d", "page_id")).cast("long").alias("place"))


@query("w17_distinct_signatures", "with s as (select doc_id, n_chars % 60 as signature, sha256('sig:' || doc_id) as h from documents), f as (select *, row_number() over (partition by signature order by h) as n from s) select doc_id, signature from f where n = 1 order by h limit 45")
def w17(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", (F.col("n_chars") % 60).alias("signature"), P.seeded("sig", F.col("doc_id")).alias("h"))
    return P.first_per(rows, ["signature"], ["h"], 1).orderBy("h").limit(45).select("doc_id", "signature")


@query("w18_boolean_priority", "select doc_id, row_number() over (partition by source order by (lang = 'en') desc, (n_chars > 1000) desc, (contains(text, '.')) desc, doc_id) as place from documents")
def w18(spark, sf_dir):
    from pyspark.sql import Window as W

    order = [F.desc(F.col("lang") == "en"), F.desc(F.col("n_chars") > 1000), F.desc(F.contains("text", F.lit("."))), F.asc("doc_id")]
    return _docs(spark, sf_dir).select("doc_id", F.row_number().over(W.partitionBy("source").orderBy(*order)).cast("long").alias("place"))


@query("w1_full_ranks", "select doc_id, row_number() over (order by n_chars desc, doc_id) as rank from documents")
def w1(spark, sf_dir):
    return P.ranks(_docs(spark, sf_dir).select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], "rank").select("doc_id", "rank")


@query("w15_top_k", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 25")
def w15(spark, sf_dir):
    """The first 25 of all; Spark keeps 25 a partition and sorts no more."""
    return _docs(spark, sf_dir).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)
