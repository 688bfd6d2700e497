"""Queries of claims: facts of answers in conversations, and citations of answers that are assembled from the spans of the benchmark's items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims as CL
from ..operators import evidence as E
from .evidence import _CLAIMS, _G, _GRAMS, _SPAN, _STATUS, _best, _claims, _five, _points, _scored, _span
from .registry import query, table

_FACTS = CL.Facts(units="parts|%|euro|tion", moment=r"\d{1,2}:\d{2}|(?:19|20)\d{2}", entity=r"\p{Lu}\p{L}{3,}", procedure=("tion", "ment", "ing"), sequence=("der", "que", "the"), aliases={"sche": ("ung", "lich"), "there": ("then",)})
_NORMAL = r"regexp_replace(lower({}), '\s+', '', 'g')"


def _pairs(x: str) -> str:
    return f"(select case when length(s) < 2 then list_filter([s], lambda c: c <> '') else list_distinct(list_transform(range(1, length(s)), lambda i: substring(s, i, 2))) end from (select regexp_replace({_NORMAL.format(x)}, '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]', '', 'g') as s))"


_WORDS = lambda ws: " or ".join(f"(contains(claim, '{w}') and not contains(text, '{w}'))" for w in ws)
_NAMED = f"contains(en, regexp_replace(lower(e), '\\s+', '', 'g')) or case lower(e) {' '.join(f'when {chr(39)}{k}{chr(39)} then ' + ' or '.join(f'contains(en, {chr(39)}{a}{chr(39)})' for a in v) for k, v in _FACTS.aliases.items())} else false end"


@query("p10_fact_rules", rf"""
with {_CLAIMS}, j as (select conv_id, c.turn, claim_no, claim, u.text from claims c join conversations u using (conv_id) where u.turn = c.turn - 1),
n as (select *, {_NORMAL.format('text')} as en, {_pairs('claim')} as ca, {_pairs('text')} as ta, regexp_extract_all(claim, '\d+(?:\.\d+)?(?::\d{{1,2}})?') as ns from j),
f as (select *, list_filter([case when len(ns) > 0 then 'NUMERIC_MISMATCH' end, case when len(list_filter(regexp_extract_all(claim, '{_FACTS.moment}'), lambda m: not contains(en, m))) > 0 then 'TEMPORAL_MISMATCH' end,
 case when len(list_filter(regexp_extract_all(claim, '{_FACTS.entity}'), lambda e: length(e) between 2 and 32 and not ({_NAMED}))) > 0 then 'ENTITY_MISMATCH' end, case when {_WORDS(_FACTS.procedure)} then 'PROCEDURAL_MISMATCH' end, case when {_WORDS(_FACTS.sequence)} then 'SEQUENCE_MISMATCH' end], lambda x: x is not null) as flags from n)
select conv_id, turn, claim_no, array_to_string(flags, ',') as flags, round(case when len(ca) > 0 then len(list_intersect(ca, ta)) / len(ca) else 0 end, 6)::double as coverage, contains(en, {_NORMAL.format('claim')}) as exact from f""")
def p10(spark, sf_dir):
    """The driver's conversations hold no numbers in their claims, so its SQL only looks whether there is one; fixtures test numbers and units."""
    before = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    rows = _claims(spark, sf_dir).join(before, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", "claim_no", CL.fact_rules(F.col("claim"), F.col("evidence"), _FACTS).alias("f")).select("conv_id", "turn", "claim_no", F.array_join("f.flags", ",").alias("flags"), "f.coverage", "f.exact")


_AUDIT = f"""{_STATUS}, dec as (select item_id, case when bool_and(status = 'SUPPORTED') then 'SUFFICIENT' when bool_or(status <> 'MISSING') then 'PARTIAL' else 'INSUFFICIENT' end as decision from best group by 1),
fs as (select item_id, point_no, span from (select *, row_number() over (partition by item_id, point_no order by score desc, id, span_no) as rank from scored) join span using (id, span_no) where rank = 1),
cl as (select item_id, point_no, span, case when point_no % 4 = 0 then [] when point_no % 4 = 3 then ['C9'] else ['C' || point_no % 4] end as ids, {_GRAMS.format(c='c')} as g from (select *, {_G.format('span')} as c from fs)),
cx as (select item_id, 'C' || row_number() over (partition by item_id order by top.id) as label, {_G.format('text')} as held from top join documents on doc_id = top.id),
sup as (select item_id, point_no, list(label order by s desc, label)[1:3] as support from (select item_id, point_no, label, round(len(list_filter(g, lambda x: contains(held, x))) / greatest(1, len(g)), 6) as s from cl join cx using (item_id)) where s >= {E.PARTIAL} group by 1, 2),
cs as (select item_id, point_no, len(ids) > 0 as cited, len(ids) > 0 and len(list_filter(ids, lambda i: not list_contains(known, i))) = 0 as valid, ids, coalesce(support, []) as support from cl join (select item_id, list(label) as known from cx group by 1) using (item_id) left join sup using (item_id, point_no)),
su as (select item_id, count(*) as required, count(*) filter (where cited) as cited, count(*) filter (where valid) as valid, count(*) filter (where valid and len(list_intersect(ids, support)) > 0) as supporting, count(*) filter (where len(support) = 0) as unsupported, bool_or(cited and not (valid and len(list_intersect(ids, support)) > 0)) as off from cs group by 1),
an as (select item_id, {_G.format("string_agg(span, ' ' order by point_no)")} as held from fs group by 1), co as (select item_id, round(avg((s >= {E.PARTIAL})::int), 6) as completeness from (select item_id, round(len(list_filter(g, lambda x: contains(held, x))) / greatest(1, len(g)), 6) as s from pg join an using (item_id)) group by 1),
lb as (select item_id, required, cited, valid, supporting, unsupported, completeness, list_filter([case when decision = 'INSUFFICIENT' and item_id % 5 <> 0 and required > 0 then 'FAILED_REFUSAL' end, case when unsupported > 0 then 'UNSUPPORTED_ADDITION' end, case when decision = 'SUFFICIENT' and item_id % 5 = 0 then 'WRONG_REFUSAL' end,
 case when decision = 'SUFFICIENT' and completeness < 0.75 then 'INCOMPLETE' end, case when required > 0 and cited = 0 then 'CITATION_MISSING' end, case when cited > 0 and cited < required then 'CITATION_INCOMPLETE' end, case when off then 'CITATION_MISMATCH' end], lambda x: x is not null) as labels from su join dec using (item_id) join co using (item_id))"""


@query("p20_answer_audit", f"with {_AUDIT} select item_id, required, cited, valid, supporting, unsupported, completeness, array_to_string(labels, ',') as labels, coalesce(labels[1], 'NO_GENERATION_FAILURE') as worst from lb")
def p20(spark, sf_dir):
    """Answers that are the first span of each point, with citations planted by its number: right, wrong, unknown and missing ones; every fifth item counts as refused."""
    from pyspark.sql import Window as W

    first = E.best_spans(_scored(spark, sf_dir), ["item_id", "point_no"], 1, ["id", "span_no"]).join(_span(spark, sf_dir).select("id", "span_no", "span"), ["id", "span_no"])
    n = F.col("point_no") % 4
    mark = F.when(n == 0, "").when(n == 3, "[C9]").otherwise(F.concat(F.lit("[C"), n.cast("string"), F.lit("]")))
    claims = first.select(F.col("item_id").alias("query"), F.col("point_no").alias("claim_no"), F.concat("span", mark).alias("text"), F.lit("FACTUAL").alias("type"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    place = F.row_number().over(W.partitionBy("item_id").orderBy("id"))
    contexts = _five(spark, sf_dir).join(docs, "id").select(F.col("item_id").alias("query"), F.concat(F.lit("C"), place.cast("string")).alias("label"), "text")
    said = first.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("point_no", "span"))), lambda x: x["span"]), " ").alias("text"))
    answers = E.query_decision(_best(spark, sf_dir), "item_id", "status", F.lit(False)).join(said, "item_id").select(F.col("item_id").alias("query"), "text", "decision", (F.col("item_id") % 5 == 0).alias("refused"))
    out = CL.citation_audit(claims, contexts, answers, _points(spark, sf_dir).select(F.col("item_id").alias("query"), "point"), ("FACTUAL",))
    return out.select(F.col("query").alias("item_id"), "required", "cited", "valid", "supporting", "unsupported", "completeness", F.array_join("labels", ",").alias("labels"), F.col("primary").alias("worst"))


_TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'))"


@query("p15_confirmed_facts", f"""
with {_SPAN}, pc as (select item_id, top.id, span_no, span, contains(span, 'tion') as named, {_TOKENS.format('b.text')} as q, {_TOKENS.format('span')} as s from top join sp using (id) join benchmark b using (item_id) where not starts_with(ltrim(span), '#')),
pr as (select *, len(list_intersect(q, s)) as shared from pc), pf as (select * from (select *, row_number() over (partition by item_id, id order by named desc, round(shared / sqrt(greatest(1, len(s))), 6) desc, length(span), span_no) as n from pr) where n = 1 and shared > 0),
pd as (select * from (select *, row_number() over (partition by item_id, regexp_replace(span, '[*#\\s]+', '', 'g') order by id) as k from pf) where k = 1), pe as (select *, row_number() over (partition by item_id order by id) as fact_no from pd)
select item_id, fact_no, id, left(span, 320) as fact from pe where fact_no <= 5""")
def p15(spark, sf_dir):
    """What the five best documents of an item say of it, a sentence each; those with `tion` before others, as canonical terms."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    spans = _five(spark, sf_dir).join(_span(spark, sf_dir).select("id", "span_no", "span"), "id").select(F.col("item_id").alias("query"), F.col("id").alias("hit"), F.col("span_no").alias("sentence_no"), F.col("span").alias("sentence"))
    out = CL.confirmed_facts(queries, spans.withColumn("place", F.col("hit")), T.word_tokens, ["place"], ("tion",))
    return out.select(F.col("query").alias("item_id"), "fact_no", F.col("hit").alias("id"), F.col("sentence").alias("fact"))
