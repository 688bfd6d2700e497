"""Queries of evidence gates and citation support. The benchmark's items are queries, what BM25 finds for them is evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import metadata as M
from ..operators import search as S
from ..operators import spans as SP
from ..operators.pages import all_rules, first_rule
from ..operators.rounds import keep, spread
from .registry import query, table
from .retrieval import _BM25, _top
from .text import _SENTENCES

_PARTS = r"list_filter(list_transform(regexp_split_to_array(text, '[,;，；、]|\s(?:and|und|et|y)\s'), lambda s: trim(s)), lambda s: s <> '')"
_POINTS = rf"""pp as (select item_id, text, {_PARTS} as ps from benchmark), pq as (select item_id, case when len(ps) = 0 or len(list_filter(ps, lambda s: length(regexp_replace(s, '[^\p{{L}}\p{{N}}]', '', 'g')) < 4)) > 0 then [trim(text)] else ps[1:5] end as ps from pp),
points as (select item_id, unnest(range(1, len(ps) + 1))::bigint as point_no, unnest(ps) as point from pq)"""
_G = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_GRAMS = "list_distinct(list_concat(" + ", ".join("list_transform(range(1, length({c}) - " + str(n - 2) + "), lambda i: substring({c}, i, " + str(n) + "))" for n in (2, 3, 4)) + "))"
#: span(id, span_no, span, g): the sentences of the whole texts of the five best documents; scored(item_id, point_no, id, span_no, score): how much of each point each of them covers.
_SPAN = _BM25 + ", top as (select query_id as item_id, id from (select *, row_number() over (partition by query_id order by score desc, id) as rank from hits) where rank <= 5), " + f"""
ss as (select doc_id as id, {_SENTENCES.format(n=8)} as ss from documents where doc_id in (select id from top)), sp as (select id, unnest(range(1, len(ss) + 1))::bigint as span_no, unnest(ss) as span from ss),
span as (select id, span_no, span, {_GRAMS.format(c='c')} as g from (select *, {_G.format('span')} as c from sp))"""
_SCORED = _SPAN + ", " + _POINTS + f""",
pg as (select item_id, point_no, {_GRAMS.format(c='c')} as g from (select item_id, point_no, {_G.format('point')} as c from points)),
scored as (select item_id, point_no, id, span_no, round(len(list_intersect(pg.g, span.g)) / greatest(1, len(pg.g)), 6) as score from pg join top using (item_id) join span using (id))"""
_STATUS = _SCORED + f", mx as (select item_id, point_no, coalesce(max(score), 0.0)::double as best from pg left join scored using (item_id, point_no) group by 1, 2), best as (select item_id, point_no, best, case when best >= {E.SUPPORTED} then 'SUPPORTED' when best >= {E.PARTIAL} then 'PARTIAL' else 'MISSING' end as status from mx)"


def _points(spark, sf_dir):
    return E.points(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"))


def _hashed(name: str):
    """The content grams of a column as hashes: sets of numbers meet faster than sets of strings."""
    return F.transform(T.content_grams(F.col(name)), lambda g: F.xxhash64(g))


def _five(spark, sf_dir):
    return _top(spark, sf_dir, 5).select(F.col("query_id").alias("item_id"), "id")


def _span(spark, sf_dir):
    """(id, span_no, span, g): the sentences of the documents that any item has among its five best, each once, with their grams."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").join(_five(spark, sf_dir).select("id").distinct(), "id", "left_semi")
    docs = docs.repartition(spark.sparkContext.defaultParallelism)  # few, as each item has five; the file that they come from may be one split
    rows = docs.select("id", F.posexplode(T.sentences(F.col("text"), "latin", 8)).alias("i", "span"))
    return rows.select("id", (F.col("i") + 1).cast("long").alias("span_no"), "span", _hashed("span").alias("g"))


def _scored(spark, sf_dir):
    points = _points(spark, sf_dir).select("item_id", "point_no", _hashed("point").alias("pg"))
    return points.join(_five(spark, sf_dir), "item_id").join(_span(spark, sf_dir), "id").select("item_id", "point_no", "id", "span_no", F.round(T.coverage(F.col("pg"), F.col("g")), 6).alias("score"))


def _best(spark, sf_dir):
    """The best score of every point and its status; a point without any span is missing."""
    best = _scored(spark, sf_dir).groupBy("item_id", "point_no").agg(F.max("score").alias("best"))
    best = _points(spark, sf_dir).select("item_id", "point_no").join(best, ["item_id", "point_no"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return best.withColumn("status", E.point_status(F.col("best")))


@query("e1_query_points", f"with {_POINTS} select item_id, point_no, point from points")
def e1(spark, sf_dir):
    return _points(spark, sf_dir)


def _attr(text: str) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches({text}, '{p}')" + (f" and not regexp_matches({text}, '{E.ATTRIBUTES[0][1]}')" if n == "TIME" else "") + f" then '{n}' end" for n, p in E.ATTRIBUTES) + "], lambda x: x is not null)"


@query("e2_requested_attributes", f"select conv_id, turn, array_to_string({_attr('text')}, ',') as attributes from conversations where role = 'user'")
def e2(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(E.attributes(F.col("text"), E.ATTRIBUTES), ",").alias("attributes"))


@query("e3_overlap_score", f"with {_SCORED} select item_id, point_no, id, span_no, score from scored")
def e3(spark, sf_dir):
    return _scored(spark, sf_dir)


@query("e4_point_support", f"with {_SCORED}, r as (select *, row_number() over (partition by item_id, point_no order by score desc, id, span_no) as rank from scored) select item_id, point_no, rank, id, span_no, score from r where rank <= 3")
def e4(spark, sf_dir):
    return E.best_spans(_scored(spark, sf_dir), ["item_id", "point_no"], 3, ["id", "span_no"]).select("item_id", "point_no", F.col("rank").cast("long").alias("rank"), "id", "span_no", "score")


@query("e5_attribute_conflicts", r"with v as (select source, nullif(regexp_extract(text, '([0-9]{3,})', 1), '') as v, doc_id from documents) select source, count(distinct v) as n_values, count(distinct doc_id) as n_sources from v where v is not null group by 1 having count(distinct v) > 1 and count(distinct doc_id) > 1")
def e5(spark, sf_dir):
    out = E.value_conflicts(table(spark, sf_dir, "documents"), "source", F.nullif(F.regexp_extract("text", "([0-9]{3,})", 1), F.lit("")), "doc_id")
    return out.select("source", F.size("values").cast("long").alias("n_values"), F.col("sources").alias("n_sources"))


@query("e6_query_decision", f"with {_STATUS} select item_id, case when bool_and(status = 'SUPPORTED') then 'SUFFICIENT' when bool_or(status <> 'MISSING') then 'PARTIAL' else 'INSUFFICIENT' end as decision from best group by 1")
def e6(spark, sf_dir):
    return E.query_decision(_best(spark, sf_dir), "item_id", "status", F.lit(False))


@query("e7_entity_guard", rf"with {_BM25}, e as (select item_id, list_distinct(regexp_extract_all(text, '\p{{Lu}}\p{{L}}{{3,}}')) as es from benchmark), top as (select query_id as item_id, id from (select *, row_number() over (partition by query_id order by score desc, id) as rank from hits) where rank = 1) select item_id, id, len(es)::bigint as n_entities, len(list_filter(es, lambda x: contains(d.text, x)))::bigint as present from e join top using (item_id) join documents d on d.doc_id = top.id")
def e7(spark, sf_dir):
    top = _top(spark, sf_dir, 1).select(F.col("query_id").alias("item_id"), "id")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{L}{3,})"), 1)).alias("es"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return items.join(top, "item_id").join(docs, "id").select("item_id", "id", F.size("es").cast("long").alias("n_entities"), F.size(F.filter("es", lambda x: F.contains("text", x))).cast("long").alias("present"))


_ABOUT = ((("the",), ("the", "und")), (("est",), ("est",)))
_CLOSE = {"asked": ("on",), "subjects": ("est",), "actions": ("the",), "within": 120}


@query("e8_eligibility", f"with {_SPAN}, m as ({M.META_SQL}) select item_id, id, authority_level <> 'unverified' and not (contains(title, 'En') and not contains(b.text, 'En')) and (not regexp_matches(b.text, 'the') or regexp_matches(x, 'the|und')) and (not regexp_matches(b.text, 'est') or regexp_matches(x, 'est')) and (not regexp_matches(b.text, 'on') or regexp_matches(x, '(?s)est.{{0,117}}the|the.{{0,117}}est')) as eligible from (select item_id, id, authority_level, title, title || chr(10) || m.text as x from top join m on m.doc_id = id) t join benchmark b using (item_id)")
def e8(spark, sf_dir):
    """Evidence that may count: of some standing, of the question's subject, and near enough; by words of the driver's languages."""
    meta = M.sources(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "title", "text", "authority_level")
    rows = _five(spark, sf_dir).join(meta, "id").join(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q")), "item_id")
    fits = E.core_relevant(F.col("q"), F.col("title"), F.col("text"), _ABOUT, ("En",), _CLOSE)
    return rows.select("item_id", "id", ((F.col("authority_level") != "unverified") & fits).alias("eligible"))


@query("e9_policy_conflicts", f"""
with m as ({M.META_SQL}), a as (select *, max(effective_date) over (partition by policy_key) as newest from m where coalesce(expiry_date >= date '2025-06-01', true)), k as (select * from a where effective_date is null or effective_date = newest)
select policy_key, count(distinct authority_level) as n_signatures, count(distinct source_id) as n_sources from k group by 1 having count(distinct authority_level) > 1 and count(distinct source_id) > 1""")
def e9(spark, sf_dir):
    from pyspark.sql import Window as W

    live = M.sources(table(spark, sf_dir, "documents")).where("coalesce(expiry_date >= date'2025-06-01', true)")
    newest = F.max("effective_date").over(W.partitionBy("policy_key"))
    kept = live.withColumn("newest", newest).where("effective_date is null or effective_date = newest")  # undated sources stay
    out = E.value_conflicts(kept, "policy_key", F.col("authority_level"), "source_id")
    return out.select("policy_key", F.size("values").cast("long").alias("n_signatures"), F.col("sources").alias("n_sources"))


@query("e10_past_deadline", r"with t as (select event_id, 'apply before ' || strftime(ts, '%Y-%m-%d') || ', held on ' || strftime(ts + interval 90 day, '%Y-%m-%d') || ' in the hall at the end of the long street by the river' as text, ts::date as d from events) select event_id, d < date '2024-06-01' or (d + 90 < date '2024-06-01') as past_deadline from t")
def e10(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("apply before "), F.date_format("ts", "yyyy-MM-dd"), F.lit(", held on "), F.date_format(F.date_add("ts", 90), "yyyy-MM-dd"), F.lit(" in the hall at the end of the long street by the river")).alias("text"))
    return E.past_deadline(rows, "text", "2024-06-01").select("event_id", "past_deadline")


@query("e11_aspect_support", f"with {_STATUS} select item_id, count(*) filter (where status = 'SUPPORTED') as supported, count(*) as asked from best group by 1")
def e11(spark, sf_dir):
    return _best(spark, sf_dir).groupBy("item_id").agg(F.count_if(F.col("status") == "SUPPORTED").alias("supported"), F.count("*").alias("asked"))


@query("e12_four_states", f"with {_STATUS}, s as (select item_id, count(*) filter (where status = 'SUPPORTED') as n, count(*) as asked from best group by 1) select item_id, case when item_id % 17 = 0 then 'CONFLICT' when n = 0 then 'NOT_SUPPORTED' when n < asked or item_id % 5 = 0 then 'PARTIAL' else 'SUPPORTED' end as status from s")
def e12(spark, sf_dir):
    s = e11(spark, sf_dir)
    return s.select("item_id", E.four_states(F.col("item_id") % 17 == 0, F.col("supported"), F.col("asked"), F.col("item_id") % 5 == 0).alias("status"))


@query("e13_semantic_rescue", f"with {_STATUS} select item_id, point_no, array_to_string(list_filter([case when not (best >= 0.15 and best < 0.18) then 'LEXICAL_OUT_OF_BAND' end, case when best * 2 < 0.6 then 'DENSE_TOO_LOW' end, case when point_no > 3 then 'BLOCKED' end], lambda x: x is not null), ',') as reasons from best")
def e13(spark, sf_dir):
    return _best(spark, sf_dir).select("item_id", "point_no", F.array_join(E.rescue(F.col("best"), F.col("best") * 2, F.col("point_no") > 3), ",").alias("reasons"))


def _features(spark, sf_dir):
    """A row of `E.FEATURES` for each item, over the whole texts of its five best documents."""
    docs = M.sources(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), F.char_length("text").alias("n"), F.regexp_count("text", F.lit(r"\|")).alias("nav"), "title")
    five = _five(spark, sf_dir).join(docs, "id").groupBy("item_id").agg(F.count("*").alias("n_evidence"), F.round(F.log1p(F.sum("n")), 6).alias("log_chars"), F.max("n").alias("longest"), F.min("n").alias("shortest"), F.sum("nav").alias("navigation"), F.max((F.col("n") > 310).cast("int")).alias("long"), F.concat_ws(" ", F.sort_array(F.collect_list("title"))).alias("titles"))
    points = _best(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_points"), F.max("best").alias("best_point"), F.min("best").alias("worst_point"), F.round(F.avg("best") + 1e-9, 6).alias("mean_point"))
    whole = _spans(spark, sf_dir).groupBy("item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("shared")))).alias("u"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.char_length("text").alias("query_chars"), T.content_grams(F.col("text")).alias("ig"), F.size(E.attributes(F.col("text"), E.ATTRIBUTES)).alias("asked"))
    rows = items.join(points, "item_id").join(five, "item_id").join(whole, "item_id", "left")
    n = F.greatest(F.lit(1), F.size("ig"))
    return rows.select(
        "item_id", "query_chars", "n_points", "n_evidence", "log_chars", "longest", "shortest", "navigation", F.round(F.coalesce("u", F.lit(0)) / n, 6).alias("query_score"), "best_point", "worst_point", "mean_point",
        ((F.col("n_evidence") > 1) & (F.col("long") == 0)).cast("int").alias("all_short"), ((F.col("n_evidence") == 1) & (F.col("n_points") > 1)).cast("int").alias("one_for_many"), F.round(T.coverage(F.col("ig"), T.content_grams(F.col("titles"))), 6).alias("title_score"),
        F.round(F.coalesce("u", F.lit(0)) / n * (F.col("asked") > 0).cast("int"), 6).alias("attribute_score"),
    )


_FIVE = f"five as (select item_id, count(*) as n_evidence, round(ln(1 + sum(n)), 6) as log_chars, max(n) as longest, min(n) as shortest, sum(nav)::bigint as navigation, max((n > 310)::int) as long, string_agg(title, ' ' order by title) as titles from (select item_id, length(text) as n, len(regexp_extract_all(text, '\\|')) as nav, title from top join ({M.META_SQL}) m on m.doc_id = id) group by 1)"


def _e14_sql() -> str:
    shared = f", ig as (select item_id, length(text) as query_chars, len({_attr('text')}) as asked, {_GRAMS.format(c='c')} as g from (select *, {_G.format('text')} as c from benchmark)), wh as (select item_id, len(list_distinct(flatten(list(list_intersect(ig.g, span.g))))) as u from ig join top using (item_id) join span using (id) group by 1)"
    rows = f", pt as (select item_id, count(*) as n_points, max(best) as best_point, min(best) as worst_point, round(avg(best) + 1e-9, 6) as mean_point from best group by 1), tg as (select item_id, {_GRAMS.format(c='c')} as g from (select item_id, {_G.format('titles')} as c from five))"
    return f"with {_STATUS}, {_FIVE}{shared}{rows} select item_id, query_chars, n_points, n_evidence, log_chars, longest, shortest, navigation, round(coalesce(u, 0) / greatest(1, len(ig.g)), 6) as query_score, best_point, worst_point, mean_point, (n_evidence > 1 and long = 0)::int as all_short, (n_evidence = 1 and n_points > 1)::int as one_for_many, round(len(list_intersect(ig.g, tg.g)) / greatest(1, len(ig.g)), 6) as title_score, round(coalesce(u, 0) / greatest(1, len(ig.g)) * (asked > 0)::int, 6) as attribute_score from ig join pt using (item_id) join five using (item_id) join tg using (item_id) left join wh using (item_id)"


@query("e14_gate_features", _e14_sql())
def e14(spark, sf_dir):
    return _features(spark, sf_dir)


@query("e14_learned_gate")
def e14_gate(spark, sf_dir):
    """A forest over the features, fitted on the even items; what it takes for truth is the rule's own decision, as the driver has no other. No SQL grows trees; a fixture tests it."""
    truth = E.query_decision(_best(spark, sf_dir), "item_id", "status", F.lit(False)).select("item_id", F.when(F.col("decision") == "SUFFICIENT", 2).when(F.col("decision") == "PARTIAL", 1).otherwise(0).alias("label"))
    rows = keep(_features(spark, sf_dir).join(truth, "item_id"))
    out = E.learned_gate(rows.where("item_id % 2 = 0"), rows.where("item_id % 2 = 1"), "label", 0.5)
    return out.select("item_id", "label", "decision", "p_sufficient")


@query("e15_payload_invariants", f"with {_STATUS}, s as (select item_id, count(*) filter (where status = 'SUPPORTED') as n, count(*) filter (where status = 'MISSING') as m, count(*) as asked from best group by 1) select item_id, (n = asked) = (n > 0 and n = asked and m = 0) as consistent, n + m <= asked as bounded from s")
def e15(spark, sf_dir):
    s = _best(spark, sf_dir).groupBy("item_id").agg(F.count_if(F.col("status") == "SUPPORTED").alias("n"), F.count_if(F.col("status") == "MISSING").alias("m"), F.count("*").alias("asked"))
    whole = F.col("n") == F.col("asked")
    return s.select("item_id", (whole == ((F.col("n") > 0) & whole & (F.col("m") == 0))).alias("consistent"), (F.col("n") + F.col("m") <= F.col("asked")).alias("bounded"))


@query("e16_clarification_slots", r"select conv_id, turn, array_to_string(list_filter([case when not regexp_matches(text, '\d') then 'WHEN' end, case when not regexp_matches(text, '\p{Lu}\p{L}+ \p{Lu}') then 'WHO' end, case when length(text) < 60 then 'WHAT' end, case when not regexp_matches(lower(text), '\b(?:where|place)\b') then 'WHERE' end], lambda x: x is not null)[1:3], ',') as missing from conversations where role = 'user'")
def e16(spark, sf_dir):
    x = F.col("text")
    slots = all_rules([("WHEN", ~x.rlike(r"\d")), ("WHO", ~x.rlike(r"\p{Lu}\p{L}+ \p{Lu}")), ("WHAT", F.char_length(x) < 60), ("WHERE", ~F.lower(x).rlike(r"\b(?:where|place)\b"))])
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(F.slice(slots, 1, 3), ",").alias("missing"))


_MATRIX = f"mt as (select item_id, point_no, case when item_id % 19 = 0 and point_no = 1 then 'CONTRADICTED' when best >= {E.SUPPORTED} then 'ENTAILED' when best >= {E.PARTIAL} then 'PARTIAL' else 'NOT_FOUND' end as r, best as s, best >= 0.3 as a, least(1.0, best + 0.1) as d from best where point_no <= 3)"


@query("e17_support_matrix", f"with {_STATUS}, {_MATRIX} select item_id, count(*) as points, " + ", ".join(f"count(*) filter (where r = '{x}') as {x.lower()}" for x in E.RELATIONS) + ", " + ", ".join(f"round(count(*) filter (where r = '{x}') / count(*), 6) as {x.lower()}_share" for x in E.RELATIONS[:3]) + ", round(count(*) filter (where a) / count(*), 6) as attribute_share, round(min(s), 6) as least_score, round(avg(s) + 1e-9, 6) as mean_score, round(stddev_pop(s) + 1e-9, 6) as score_spread, round(avg(d) + 1e-9, 6)::double as mean_directness, bool_and(d >= 0.7) as all_direct from mt group by 1")
def e17(spark, sf_dir):
    """Features of a support matrix with a row for each of three points at most."""
    best = _best(spark, sf_dir).where("point_no <= 3")
    relation = F.when((F.col("item_id") % 19 == 0) & (F.col("point_no") == 1), "CONTRADICTED").when(F.col("best") >= E.SUPPORTED, "ENTAILED").when(F.col("best") >= E.PARTIAL, "PARTIAL").otherwise("NOT_FOUND")
    return E.matrix_features(best, ["item_id"], "point_no", relation, F.col("best"), F.col("best") >= 0.3, F.least(F.lit(1.0), F.col("best") + 0.1))


@query("e17_top_spans", f"with {_SCORED}, r as (select *, row_number() over (partition by item_id order by score desc, id, span_no, point_no) as n from scored) select item_id, n as rank, id, span_no, point_no, score from r where n <= 8")
def e17_spans(spark, sf_dir):
    top = S.top_k(_scored(spark, sf_dir), ["item_id"], [F.desc("score"), F.asc("id"), F.asc("span_no"), F.asc("point_no")], 8)
    return top.select("item_id", F.col("rank").cast("long").alias("rank"), "id", "span_no", "point_no", "score")


@query("e17_matrix_validation", """with c as (select item_id, item_id % 8 as k from benchmark) select item_id, case when k = 1 then 'point_matrix_count' when k = 2 then 'point_ids' when k = 3 then 'matrix_point_ids' when k = 4 then 'relation' when k = 5 then 'span_reference' when k = 6 then 'attribute_match' when k = 7 then 'scores' end as fault from c""")
def e17_faults(spark, sf_dir):
    """Matrices with one fault each, planted by the item's number."""
    k = F.col("item_id") % 8
    row = lambda p, r, sp, a, x: F.struct(p.alias("point"), r.alias("relation"), F.array(sp).alias("spans"), a.alias("attribute_match"), x.alias("score"), F.lit(0.5).alias("directness"))
    first = row(F.lit("P1"), F.when(k == 4, "MAYBE").otherwise("ENTAILED"), F.when(k == 5, "S9").otherwise("S1"), F.when(k != 6, True), F.when(k == 7, 1.5).otherwise(0.9))
    second = row(F.when(k == 3, "P1").otherwise(F.when(k == 2, "Q2").otherwise("P2")), F.lit("PARTIAL"), F.lit("S2"), F.lit(False), F.lit(0.2))
    points = F.array(F.lit("P1"), F.when(k == 2, "Q2").otherwise("P2"))
    matrix = F.when(k == 1, F.array(first)).otherwise(F.array(first, second))
    return table(spark, sf_dir, "benchmark").select("item_id", E.matrix_fault(points, matrix, F.array(F.lit("S1"), F.lit("S2"))).alias("fault"))


@query("p1_contract_validation", f"with {_SPAN} select item_id, case when count(*) <> 5 then 'WRONG_COUNT' when count(distinct id) <> count(*) then 'REPEATED_ID' when bool_or(id not in (select doc_id from documents)) then 'UNKNOWN_ID' end as error_code from top group by 1")
def p1(spark, sf_dir):
    top = _five(spark, sf_dir)
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(True).alias("known")).distinct()
    rows = top.join(known, "id", "left").groupBy("item_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.bool_or(F.col("known").isNull()).alias("u"))
    return rows.select("item_id", first_rule([("WRONG_COUNT", F.col("n") != 5), ("REPEATED_ID", F.col("d") != F.col("n")), ("UNKNOWN_ID", F.col("u"))], None).alias("error_code"))


@query("p2_span_location", "with f as (select d.doc_id, d.text, b.item_id, trim(b.text, ' ' || chr(10)) as needle from documents d join benchmark b on contains(d.text, trim(b.text, ' ' || chr(10))) where trim(b.text, ' ' || chr(10)) <> '') select doc_id, item_id, strpos(text, needle)::bigint - 1 as start, strpos(text, needle)::bigint - 1 + length(needle)::bigint as \"end\", ((length(text) - length(replace(text, needle, ''))) // length(needle))::bigint as occurrences from f")
def p2(spark, sf_dir):
    """Whole items in whole texts, all by one automaton that each text is walked with once."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.trim(F.col("text"), F.lit(" \n")).alias("needle"))
    return SP.locate_needles(table(spark, sf_dir, "documents"), "doc_id", "text", items, "item_id", "needle", exact=True).select("doc_id", "item_id", "start", "end", "occurrences")


@query("p2_canonical_location")
def p2_canonical(spark, sf_dir):
    """Items in canonical texts, by canonical form; offsets in raw ones. Canonical forms take walks over letters, which SQL lacks; tests compare it with a search for each needle."""
    out = SP.locate_needles(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return out.select("doc_id", "item_id", "start", "end", "occurrences", F.array_join("reasons", ",").alias("reasons"), F.sha2("raw", 256).alias("raw_sha256"))


def _located(spark, sf_dir):
    """What becomes of the four best spans of each point, in the five best documents of its item."""
    best = E.best_spans(_scored(spark, sf_dir).where(F.col("score") >= E.PARTIAL), ["item_id", "point_no"], 4, ["id", "span_no"])
    status = _best(spark, sf_dir).select("item_id", "point_no", F.when(F.col("status") == "PARTIAL", "PARTIALLY_SUPPORTED").otherwise(F.col("status")).alias("status"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("chunk"))
    spans = best.join(_span(spark, sf_dir).select("id", "span_no", "span"), ["id", "span_no"]).join(status, ["item_id", "point_no"]).join(docs.select("id", "source"), "id")
    spans = spans.select(F.col("item_id").alias("query"), F.col("point_no").alias("point"), "status", F.concat_ws("#S", "id", "span_no").alias("span_id"), F.col("id").alias("chunk_id"), F.col("source").alias("source_id"), F.col("span").alias("text"))
    chunks = _five(spark, sf_dir).join(docs, "id").select(F.col("item_id").alias("query"), F.col("id").alias("chunk_id"), F.col("source").alias("source_id"), F.col("chunk").alias("text"))
    return SP.support_spans(spans, chunks)


@query("p3_located_units")
def p3_units(spark, sf_dir):
    """Units of support by where they stand. No SQL, as for `p2_canonical_location`; tests compare it with a loop over spans."""
    out = SP.support_units(_located(spark, sf_dir))
    return out.select(F.col("query").alias("item_id"), F.col("chunk_id").alias("doc_id"), "start", "end", "occurrences", F.array_join("reasons", ",").alias("reasons"), F.array_join(F.transform("points", lambda p: p.cast("string")), ",").alias("points"), F.array_join("span_ids", ",").alias("span_ids"))


@query("p3_excluded_spans")
def p3_excluded(spark, sf_dir):
    """The second output: spans that make no unit, with the reason. No SQL, as for the units."""
    return _located(spark, sf_dir).where("excluded is not null").select(F.col("query").alias("item_id"), F.col("point").alias("point_no"), "span_id", F.col("excluded").alias("reason"))


@query("p3_support_units", f"with {_SCORED} select id, span_no, count(distinct item_id * 1000 + point_no) as n_points, round(max(score), 6) as best from scored where score >= {E.PARTIAL} group by 1, 2")
def p3(spark, sf_dir):
    rows = _scored(spark, sf_dir).where(F.col("score") >= E.PARTIAL)
    return rows.groupBy("id", "span_no").agg(F.count_distinct(F.col("item_id") * 1000 + F.col("point_no")).alias("n_points"), F.round(F.max("score"), 6).alias("best"))


@query("p4_adjacent_merge")
def p4(spark, sf_dir):
    """Sentences of whole texts, joined while the gap is small and the whole not too long; the limit on the whole makes it sequential, so a fixture tests it."""
    return E.merge_adjacent(E.sentence_offsets(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", 6, 160)


@query("p5_roles", f"with {_SCORED}, f as (select *, row_number() over (partition by item_id, point_no order by score desc, id, span_no) = 1 as first from scored where score >= {E.PARTIAL}) select id, span_no, case when bool_or(first) then 'PRIMARY' else 'SUPPORTING' end as role, count(distinct item_id * 1000 + point_no) as points from f group by 1, 2")
def p5(spark, sf_dir):
    rows = _scored(spark, sf_dir).where(F.col("score") >= E.PARTIAL).select("id", "span_no", (F.col("item_id") * 1000 + F.col("point_no")).alias("point"), (-F.col("score")).alias("o"))
    return E.roles(rows, ["id", "span_no"], "point", ["o", "id", "span_no"])


@query("p6_source_aggregation", f"with {_SCORED} select source, count(distinct item_id * 1000 + point_no) as n_points, count(distinct id * 100000 + span_no) as n_units, min(id) as first_id from scored join documents on doc_id = id where score >= {E.PARTIAL} group by 1")
def p6(spark, sf_dir):
    rows = _scored(spark, sf_dir).where(F.col("score") >= E.PARTIAL).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return rows.groupBy("source").agg(F.count_distinct(F.col("item_id") * 1000 + F.col("point_no")).alias("n_points"), F.count_distinct(F.col("id") * 100000 + F.col("span_no")).alias("n_units"), F.min("id").alias("first_id"))


@query("p7_support_gate", f"with {_STATUS}, dec as (select item_id, case when bool_and(status = 'SUPPORTED') then 'SUFFICIENT' when bool_or(status <> 'MISSING') then 'PARTIAL' else 'INSUFFICIENT' end as decision, count(*) filter (where status <> 'MISSING') as mapped, count(*) as required from best group by 1) select item_id, case when item_id % 13 = 0 or decision = 'INSUFFICIENT' or mapped = 0 then 'BLOCKED' when mapped < required or decision = 'PARTIAL' then 'PARTIAL' else 'READY' end as gate from dec")
def p7(spark, sf_dir):
    best = _best(spark, sf_dir)
    counts = best.groupBy("item_id").agg(F.count_if(F.col("status") != "MISSING").alias("mapped"), F.count("*").alias("required"))
    d = E.query_decision(best, "item_id", "status", F.lit(False)).join(counts, "item_id")
    return d.select("item_id", E.support_gate(F.col("decision"), F.col("mapped"), F.col("required"), F.col("item_id") % 13 == 0).alias("gate"))


@query("p8_provenance", f"with {_SPAN}, m as ({M.META_SQL}) select item_id, count(*) as links, bool_or(m.source_id is null) as has_gap, count(case when access_level <> 'restricted' then url end) as shown from top left join m on m.doc_id = top.id group by 1")
def p8(spark, sf_dir):
    top = _five(spark, sf_dir).withColumnRenamed("id", "doc_id")
    meta = M.sources(table(spark, sf_dir, "documents")).select("doc_id", "source_id", F.when(F.col("access_level") != "restricted", F.col("url")).alias("url"))
    return top.join(meta, "doc_id", "left").groupBy("item_id").agg(F.count("*").alias("links"), F.bool_or(F.col("source_id").isNull()).alias("has_gap"), F.count("url").alias("shown"))


_CASES = "case " + " ".join(f"when regexp_matches(claim, '{p}') then '{n}'" for n, p in E.CLAIMS).replace("can't", "can''t") + " else 'FACTUAL' end"
_CLAIMS = rf"s as (select conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.;!\n]+'), lambda s: trim(s)), lambda s: length(s) >= 8) as cs from conversations where role = 'assistant'), c as (select conv_id, turn, unnest(range(1, len(cs) + 1))::bigint as claim_no, unnest(cs) as claim from s), claims as (select *, {_CASES} as claim_type from c)"


def _claims(spark, sf_dir):
    return E.claims(table(spark, sf_dir, "conversations").where("role = 'assistant'"), ["conv_id", "turn"], F.col("text"))


@query("p9_claims", f"with {_CLAIMS} select conv_id, turn, claim_no, claim, claim_type from claims")
def p9(spark, sf_dir):
    return _claims(spark, sf_dir)


_NUMS = r"regexp_extract_all({}, '[0-9]+(?:\.[0-9]+)?%?')"


@query("p10_claim_rules", f"with {_CLAIMS} select conv_id, c.turn, claim_no, len(list_filter({_NUMS.format('claim')}, lambda x: not list_contains({_NUMS.format('u.text')}, x))) = 0 as numeric_ok, claim_type from claims c join conversations u using (conv_id) where u.turn = c.turn - 1")
def p10(spark, sf_dir):
    before = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    ok = F.size(F.array_except(T.numbers(F.col("claim")), T.numbers(F.col("evidence")))) == 0
    return _claims(spark, sf_dir).join(before, ["conv_id", "turn"]).select("conv_id", "turn", "claim_no", ok.alias("numeric_ok"), "claim_type")


@query("p11_alias_mining", r"with a as (select doc_id, unnest(regexp_extract_all(text, '(\p{Lu}\p{L}+) \((\p{Lu}{2,})\)', 1)) as name, unnest(regexp_extract_all(text, '(\p{Lu}\p{L}+) \((\p{Lu}{2,})\)', 2)) as alias from (select doc_id, text || ' ' || upper(left(source, 1)) || 'ource (' || upper(lang) || ')' as text from documents)) select name, alias, count(distinct doc_id) as n from a group by 1, 2")
def p11(spark, sf_dir):
    text = F.concat("text", F.lit(" "), F.upper(F.substring("source", 1, 1)), F.lit("ource ("), F.upper("lang"), F.lit(")"))
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(r"(\p{Lu}\p{L}+) \((\p{Lu}{2,})\)"), i).alias(n) for i, n in ((1, "name"), (2, "alias"))])
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("p")).groupBy("p.name", "p.alias").agg(F.count_distinct("doc_id").alias("n"))


@query("p15_best_sentences", "with s as (select doc_id, unnest(range(1, len(ss) + 1))::bigint as i, unnest(ss) as s from (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) >= 8) as ss from documents)), r as (select doc_id, i, round(len(regexp_extract_all(lower(s), '[\\p{L}\\p{N}]+')) / sqrt(length(s)), 6) as score from s), k as (select *, row_number() over (partition by doc_id order by score desc, i) as rank from r) select doc_id, rank, i as sentence_no, score from k where rank <= 5")
def p15(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"), "latin", 8)).alias("i", "s"))
    rows = rows.select("doc_id", (F.col("i") + 1).cast("long").alias("sentence_no"), F.round(F.size(T.word_tokens(F.col("s"))) / F.sqrt(F.char_length("s")), 6).alias("score"))
    return S.top_k(rows, ["doc_id"], [F.desc("score"), F.asc("sentence_no")], 5).select("doc_id", F.col("rank").cast("long").alias("rank"), "sentence_no", "score")


@query("p16_reference_numbering", f"with {_SCORED}, f as (select item_id, id, min(point_no) as first, max(score) as best from scored where score >= {E.PARTIAL} group by 1, 2) select item_id, id, row_number() over (partition by item_id order by first, best desc, id) as reference_no from f")
def p16(spark, sf_dir):
    from pyspark.sql import Window as W

    f = _scored(spark, sf_dir).where(F.col("score") >= E.PARTIAL).groupBy("item_id", "id").agg(F.min("point_no").alias("first"), F.max("score").alias("best"))
    return f.select("item_id", "id", F.row_number().over(W.partitionBy("item_id").orderBy("first", F.desc("best"), "id")).cast("long").alias("reference_no"))


_CITED = f"""{_SCORED}, r as (select *, row_number() over (partition by item_id, point_no order by score desc, id, span_no) as rank from scored where score >= {E.PARTIAL}),
c as (select item_id, point_no, any_value(span) filter (where rank = 1) as claim, list(id order by rank) filter (where rank <= 3) as ids from r join span using (id, span_no) group by 1, 2),
u as (select item_id, id, row_number() over (partition by item_id order by min(point_no), min_by(rank, point_no)) as n from r where rank <= 3 group by 1, 2),
m as (select item_id, point_no, claim, (select string_agg('[' || n || ']', '' order by n) from u where u.item_id = c.item_id and list_contains(c.ids, u.id)) as mark from c)"""


@query("p16_cited_answers", f"with {_CITED}, t as (select item_id, string_agg(claim || mark, ' ' order by point_no) as body from m group by 1), b as (select item_id, count(*) as n_references, string_agg('[' || n || '] ' || id, chr(10) order by n) as refs from u group by 1) select item_id, n_references, sha256(body || chr(10) || chr(10) || 'References:' || chr(10) || refs) as cited_sha256 from t join b using (item_id)")
def p16_cited(spark, sf_dir):
    """The answer of `p17_answer_assembly` with markers of the documents that hold up to three spans of each claim."""
    best = E.best_spans(_scored(spark, sf_dir).where(F.col("score") >= E.PARTIAL), ["item_id", "point_no"], 3, ["id", "span_no"])
    rows = best.join(_span(spark, sf_dir).select("id", "span_no", "span"), ["id", "span_no"])
    claims = rows.groupBy("item_id", "point_no").agg(F.min_by("span", "rank").alias("claim"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    claims = keep(claims)
    whole = claims.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("point_no", "claim"))).alias("cs")).withColumn("text", F.array_join(F.transform("cs", lambda c: c["claim"]), " "))
    before = F.filter("cs", lambda c: c["point_no"] <= F.col("point_no"))
    ends = claims.join(whole.select("item_id", "cs"), "item_id").select("item_id", "point_no", "ids", F.aggregate(before, F.lit(-1), lambda a, c: a + 1 + F.char_length(c["claim"])).alias("end"))
    out = SP.cited_texts(whole, "item_id", "text", ends, "point_no", "end", "ids", lambda x: x.cast("string"), "\n\nReferences:\n")
    return out.select("item_id", F.size("references").cast("long").alias("n_references"), F.sha2("cited", 256).alias("cited_sha256"))


@query("p17_answer_assembly", f"with {_SCORED}, r as (select *, row_number() over (partition by item_id, point_no order by score desc, id, span_no) as rank from scored where score >= {E.PARTIAL}), a as (select item_id, count(*) as claims, sha256(string_agg(point_no || ':' || span, '|' order by point_no)) as answer_sha256 from r join span using (id, span_no) where rank = 1 group by 1), n as (select item_id, count(*) as asked from points group by 1) select item_id, claims, claims = asked as complete, answer_sha256 from a join n using (item_id)")
def p17(spark, sf_dir):
    """One claim for each point that has support: the text of its first span; complete if no point is without."""
    first = E.best_spans(_scored(spark, sf_dir).where(F.col("score") >= E.PARTIAL), ["item_id", "point_no"], 1, ["id", "span_no"])
    first = first.join(_span(spark, sf_dir).select("id", "span_no", "span"), ["id", "span_no"])
    rows = first.groupBy("item_id").agg(F.count("*").alias("claims"), F.array_sort(F.collect_list(F.struct("point_no", F.concat("point_no", F.lit(":"), "span").alias("c")))).alias("cs"))
    asked = _points(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("asked"))
    return rows.join(asked, "item_id").select("item_id", "claims", (F.col("claims") == F.col("asked")).alias("complete"), F.sha2(F.array_join(F.transform("cs", lambda x: x["c"]), "|"), 256).alias("answer_sha256"))


@query("p18_unsupported_attribution", f"with {_STATUS} select item_id, point_no, case when status = 'SUPPORTED' then 'NONE' when best < {E.RELATED} then 'NOT_IN_CORPUS' when status = 'PARTIAL' then 'PARTIAL_EVIDENCE' else 'RETRIEVAL_GAP' end as attribution from best")
def p18(spark, sf_dir):
    rules = [("NONE", F.col("status") == "SUPPORTED"), ("NOT_IN_CORPUS", F.col("best") < E.RELATED), ("PARTIAL_EVIDENCE", F.col("status") == "PARTIAL")]
    return _best(spark, sf_dir).select("item_id", "point_no", first_rule(rules, "RETRIEVAL_GAP").alias("attribution"))


@query("p20_citation_audit", f"with {_CLAIMS} select conv_id, count(*) as claims, count(*) filter (where claim_type in ('FACTUAL', 'NUMERIC', 'TEMPORAL', 'ENTITY')) as required, array_to_string(list_filter([case when bool_or(claim_type = 'UNCERTAIN') then 'UNCERTAIN' end, case when count(*) filter (where length(claim) > 200) > 0 then 'LONG_CLAIM' end, case when count(*) < 2 then 'FEW_CLAIMS' end], lambda x: x is not null), ',') as labels from claims group by 1")
def p20(spark, sf_dir):
    kind = F.col("claim_type")
    rows = _claims(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("claims"), F.count_if(kind.isin("FACTUAL", "NUMERIC", "TEMPORAL", "ENTITY")).alias("required"), F.bool_or(kind == "UNCERTAIN").alias("u"), F.count_if(F.char_length("claim") > 200).alias("l"))
    labels = all_rules([("UNCERTAIN", F.col("u")), ("LONG_CLAIM", F.col("l") > 0), ("FEW_CLAIMS", F.col("claims") < 2)])
    return rows.select("conv_id", "claims", "required", F.array_join(labels, ",").alias("labels"))


_SPANS = _SPAN + f""",
ig as (select item_id, {_GRAMS.format(c='c')} as g from (select item_id, {_G.format('text')} as c from benchmark)),
spans as (select item_id, id, span_no, list_intersect(ig.g, span.g) as shared, len(ig.g) as n, round(len(list_intersect(ig.g, span.g)) / greatest(1, len(ig.g)), 6) as score from ig join top using (item_id) join span using (id)), best2 as (select *, row_number() over (partition by item_id order by score desc, id, span_no) as r from spans)"""


def _spans(spark, sf_dir):
    """Each item, as a claim, against every sentence of the whole texts of its five best documents."""
    items = table(spark, sf_dir, "benchmark").select("item_id", _hashed("text").alias("ig"))
    rows = items.join(_five(spark, sf_dir), "item_id").join(_span(spark, sf_dir), "id").withColumn("shared", F.array_intersect("ig", "g"))
    return rows.select("item_id", "id", "span_no", "shared", F.size("ig").alias("n_grams"), F.round(F.size("shared") / F.greatest(F.lit(1), F.size("ig")), 6).alias("score"))


@query("p12_claim_top_spans", f"with {_SPANS} select item_id, r as rank, id, span_no, score from best2 where r <= 3")
def p12(spark, sf_dir):
    return E.best_spans(_spans(spark, sf_dir), ["item_id"], 3, ["id", "span_no"]).select("item_id", F.col("rank").cast("long").alias("rank"), "id", "span_no", "score")


@query("p13_verdicts", f"with {_SPANS}, u as (select item_id, max(score) as first, round(len(list_distinct(flatten(list(shared)))) / greatest(1, any_value(n)), 6) as union_score from best2 where r <= 2 group by 1) select item_id, first, union_score, case when first >= 0.6 then 'SUPPORTED' when first >= 0.3 or union_score - first >= 0.10 then 'PARTIAL' else 'UNSUPPORTED' end as label from u")
def p13(spark, sf_dir):
    return E.verdicts(_spans(spark, sf_dir), ["item_id"], "score", "shared", ["id", "span_no"])


_ENT = [("src1", "src2"), ("src2", "src3"), ("src3", "src1")]
#: Sentences with a number, a time and a name, as the driver's tables give them.
_ANCHORED = "a as (select event_id, case when event_id % 4 = 0 then 'no facts at all' else 'at ' || strftime(ts, '%H') || ':' || strftime(ts, '%M') || ' the source src' || event_id % 5 || ' sold ' || floor(value)::int || ' parts' end as t from events), sw as (select event_id, 'POSITIVE' as kind, t as p, t as h from a union all select event_id, 'NUMERIC_SWAP', t, regexp_replace(t, '[0-9]+', case when regexp_extract(t, '[0-9]+')::int < 100 then (regexp_extract(t, '[0-9]+')::int + 10)::varchar else (regexp_extract(t, '[0-9]+')::int + 1)::varchar end) from a where regexp_matches(t, '[0-9]') union all select event_id, 'TEMPORAL_SWAP', t, regexp_replace(t, '[0-9]{2}:', case when regexp_extract(t, '([0-9]{2}):', 1) = '20' then '10:' else '20:' end) from a where regexp_matches(t, '[0-9]{2}:') union all select event_id, 'ENTITY_SWAP', t, case when contains(t, 'src1') then regexp_replace(t, 'src1', 'src2') when contains(t, 'src2') then regexp_replace(t, 'src2', 'src3') else regexp_replace(t, 'src3', 'src1') end from a where regexp_matches(t, 'src[123]'))"


def _anchors(spark, sf_dir):
    i = F.col("event_id")
    text = F.when(i % 4 == 0, "no facts at all").otherwise(F.concat(F.lit("at "), F.date_format("ts", "HH:mm"), F.lit(" the source src"), i % 5, F.lit(" sold "), F.floor("value").cast("int"), F.lit(" parts")))
    return E.swap_anchors(spread(table(spark, sf_dir, "events")), "event_id", text, _ENT)


@query("p14_swap_anchors", f"with {_ANCHORED} select event_id, kind, h as hypothesis from sw")
def p14_anchors(spark, sf_dir):
    return _anchors(spark, sf_dir).select("event_id", "kind", "hypothesis")


@query("p14_verifier_check", f"with {_ANCHORED}, s as (select kind, round(1 - (0.35 * (h <> p)::int + 0.004 * (event_id % 50)), 6)::double as score from sw), po as (select median(score) as pm, quantile_cont(score, 0.1) as p10, count(*) as positives from s where kind = 'POSITIVE'), ne as (select median(score) as nm, quantile_cont(score, 0.95) as n95, count(*) as swaps from s where kind <> 'POSITIVE'), ra as (select min(rate) as least_rate from (select kind, avg((pm > score)::int) as rate from s, po where kind <> 'POSITIVE' group by 1)) select positives, swaps, round(pm, 6) as positive_median, round(nm, 6) as swap_median, round(least_rate, 6) as least_rate, pm - nm >= 0.1 and least_rate >= 0.8 as reliable, coalesce((select min(t) from (values (0.5), (0.6), (0.7), (0.75), (0.9)) v(t) where t <= p10 and t > n95), 0.9)::double as threshold from po, ne, ra")
def p14_check(spark, sf_dir):
    """A verifier, here a made score, over texts with themselves and with facts exchanged."""
    rows = _anchors(spark, sf_dir).withColumn("score", F.round(1 - (0.35 * (F.col("hypothesis") != F.col("premise")).cast("int") + 0.004 * (F.col("event_id") % 50)), 6))
    return E.verifier_check(rows, "kind", "score", (0.5, 0.6, 0.7, 0.75, 0.9))


@query("p14_threshold_calibration", f"with {_SPANS}, a as (select least(99, floor(score * 100))::int as s, (item_id % 3 > 0)::int as y from best2 where r = 1), g as (select s::int as s from range(0, 100) t(s)), c as (select s, coalesce(sum(y), 0) as p, count(y) as n from g left join a using (s) group by 1), t as (select s, sum(p) over w as tp, sum(n) over w as named, sum(p) over () as total from c window w as (order by s desc)) select s / 100.0::double as threshold, case when named + total > 0 then round(2 * tp / (named + total), 6) else 0 end as f1 from t order by f1 desc, s limit 1")
def p14(spark, sf_dir):
    """The threshold on the best span's score whose F1 is best, against marks dealt by number."""
    first = E.best_spans(_spans(spark, sf_dir), ["item_id"], 1, ["id", "span_no"]).select("score", (F.col("item_id") % 3 > 0).cast("int").alias("y"))
    return E.calibrate(first, "score", "y")


@query("p19_required_points")
def p19(spark, sf_dir):
    """Which sentence counts depends on those kept before it; a fixture tests it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(T.sentences(F.col("text"), "latin", 18), lambda s: F.char_length(s) <= 260)).alias("s"))
    return E.required_points(docs.withColumn("score", F.size(F.array_distinct(T.word_tokens(F.col("s"))))), "doc_id", "s", "score")
