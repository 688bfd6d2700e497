"""Queries of sufficiency with conflicts: the benchmark's items against the sentences of their five best documents, by lexicons of the driver's languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as CA
from ..operators import evidence as E
from ..operators import judging as J
from ..functions import text as T
from ..operators import metadata as M
from ..operators import sufficiency as SU
from ..operators.rounds import keep
from .evidence import _ANCHORED, _G, _GRAMS, _SCORED, _anchors, _five, _points, _scored, _span
from .registry import query, table

#: What the driver's invented languages let a point ask for, how a sentence shows it, and its values.
_ASK = {"DEADLINE": r"(?:^| )(?:the|de|der) ", "TIME": r" (?:the|en|und) ", "PRICE": r" (?:of|la|in) ", "CURRENT_STATUS": r" (?:is|est|was) "}
_SHOW = {"DEADLINE": "tion|ung", "TIME": "a", "PRICE": "(?:er|en) ", "CURRENT_STATUS": "en|an"}
_SAY = {"DEADLINE": "[a-z]{2,4}(?:tion|ung) ", "TIME": " [aeiou][a-z] ", "PRICE": " [a-z]{1,2}(?:er|en) "}
_NOW = "on|re"
_ENTITY = r"\p{Lu}\p{L}{5,}"
_ASPECTS = ((("the", "une"), ("tion",)), (("und",), ("ung", "sch")), (("que",), ("aux", "euse")))
_DUE = (("and", "los"), r"\d{1,2}[:.]\d{2}|th.{0,40}ing|ción")


def _rows(spark, sf_dir):
    """(query, point, id, span_no, text, url, score): every sentence of the five best documents against every point."""
    spans = _span(spark, sf_dir).select("id", "span_no", F.col("span").alias("text"))
    meta = M.sources(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "url")
    return _scored(spark, sf_dir).join(spans, ["id", "span_no"]).join(meta, "id").withColumnsRenamed({"item_id": "query", "point_no": "point"})


def _asked(spark, sf_dir):
    points = _points(spark, sf_dir).select(F.col("item_id").alias("query"), F.col("point_no").alias("point"), F.col("point").alias("said"))
    return SU.requested(points, F.col("said"), _ASK)


def _evidence(spark, sf_dir):
    return SU.attribute_evidence(_rows(spark, sf_dir), _asked(spark, sf_dir), ["id", "span_no"], _SHOW, _SAY, current=_NOW)


def _hits(spark, sf_dir):
    docs = M.sources(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "title", "text")
    return _five(spark, sf_dir).join(docs, "id").select(F.col("item_id").alias("query"), "id", "title", "text")


def _assessed(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    points = _points(spark, sf_dir).select(F.col("item_id").alias("query"), F.col("point_no").alias("point"))
    scored = _scored(spark, sf_dir).withColumnsRenamed({"item_id": "query", "point_no": "point"})
    return SU.assess(points, scored, _evidence(spark, sf_dir), SU.document_relevance(items, _hits(spark, sf_dir), _ENTITY))


_CASE = lambda rules, default: "case attribute " + " ".join(f"when '{k}' then {v}" for k, v in rules.items()) + f" else {default} end"
_COMPACTED = r"list_transform(regexp_extract_all(span, '{}'), lambda v: regexp_replace(lower(v), '[^\p{{L}}\p{{N}}]+', '', 'g'))"
_EVIDENCE = _SCORED + f""",
asked as (select item_id, point_no, unnest(list_filter([{", ".join(f"case when regexp_matches(point, '{p}')" + (f" and not regexp_matches(point, '{_ASK['DEADLINE']}')" if k == "TIME" else "") + f" then '{k}' end" for k, p in _ASK.items())}], lambda x: x is not null)) as attribute from points),
shown as (select item_id, point_no, attribute, span, row_number() over (partition by item_id, point_no, attribute order by score desc, scored.id, scored.span_no) as rank from scored join span using (id, span_no) join ({M.META_SQL}) m on m.doc_id = scored.id join asked using (item_id, point_no)
 where score >= {E.PARTIAL} and {_CASE({k: f"regexp_matches(span || ' ' || m.url, '(?i)(?:{p})')" for k, p in _SHOW.items()}, "false")}),
found as (select item_id, point_no, attribute, count(*) as n, list_sort(list_distinct(flatten(list({_CASE({k: _COMPACTED.format(p) for k, p in _SAY.items()}, "[]::varchar[]")}) filter (where rank <= 4)))) as vs, bool_or(regexp_matches(span, '{_NOW}')) as now from shown group by 1, 2, 3),
evidence as (select item_id, point_no, attribute, coalesce(n, 0) as matching, coalesce(vs, []) as vs, n is null or (attribute = 'CURRENT_STATUS' and not now) as missing, attribute in ('DEADLINE', 'TIME', 'PRICE', 'CONTACT') and len(coalesce(vs, [])) > 1 as conflict from asked left join found using (item_id, point_no, attribute))"""
_ASSESSED = _EVIDENCE + f""",
blobs as (select item_id, regexp_replace(lower(string_agg(title || ' ' || text, ' ' order by title, text)), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as blob from top join ({M.META_SQL}) m on m.doc_id = top.id group by 1),
docs as (select item_id, round(len(list_filter(g, lambda x: contains(blob, x))) / greatest(1, len(g)), 6) as ds, len(list_filter(regexp_extract_all(text, '{_ENTITY}'), lambda e: not contains(blob, regexp_replace(lower(e), '[^\\p{{L}}\\p{{N}}]+', '', 'g')))) as absent
 from (select item_id, text, {_GRAMS.format(c='c')} as g from (select *, {_G.format('text')} as c from benchmark)) join blobs using (item_id)),
mb as (select item_id, point_no, coalesce(max(score), 0)::double as best from points left join scored using (item_id, point_no) group by 1, 2),
told as (select item_id, point_no, list_sort(coalesce(list(attribute) filter (where missing), [])) as missing, list_sort(coalesce(list(attribute) filter (where conflict), [])) as conflicts from evidence group by 1, 2),
assessed as (select item_id, point_no, best, coalesce(missing, []) as missing, coalesce(conflicts, []) as conflicts, case when len(coalesce(conflicts, [])) > 0 then 'CONFLICT' when best >= {E.SUPPORTED} and absent = 0 and len(coalesce(missing, [])) = 0 and ds >= {E.RELATED} then 'SUPPORTED'
 when best >= {E.PARTIAL} and absent = 0 then 'PARTIALLY_SUPPORTED' else 'NOT_SUPPORTED' end as status from mb left join told using (item_id, point_no) left join docs using (item_id)),
decided as (select item_id, bool_or(status = 'CONFLICT') as conflict, case when bool_or(status = 'CONFLICT') then 'INSUFFICIENT' when bool_and(status = 'SUPPORTED') then 'SUFFICIENT' when bool_or(status in ('SUPPORTED', 'PARTIALLY_SUPPORTED')) then 'PARTIAL' else 'INSUFFICIENT' end as decision,
 bool_or(status in ('NOT_SUPPORTED', 'CONFLICT')) as lacks, bool_or(len(missing) > 0) as asked, count(*) filter (where status in ('SUPPORTED', 'PARTIALLY_SUPPORTED')) as mapped, count(*) as required from assessed group by 1)"""


@query("e5_attribute_evidence", f"with {_EVIDENCE} select item_id, point_no, attribute, matching, array_to_string(vs, ',') as vs, missing, conflict from evidence")
def e5(spark, sf_dir):
    out = _evidence(spark, sf_dir)
    return out.select(F.col("query").alias("item_id"), F.col("point").alias("point_no"), "attribute", "matching", F.array_join("values", ",").alias("vs"), "missing", "conflict")


@query("e6_point_assessment", f"with {_ASSESSED} select item_id, point_no, best, status, array_to_string(missing, ',') as missing, array_to_string(conflicts, ',') as conflicts from assessed")
def e6_points(spark, sf_dir):
    out = _assessed(spark, sf_dir)
    return out.select(F.col("query").alias("item_id"), F.col("point").alias("point_no"), F.col("best_score").alias("best"), "status", F.array_join("missing", ",").alias("missing"), F.array_join("conflicts", ",").alias("conflicts"))


_REASONS = "array_to_string(list_filter([case when conflict then 'CONFLICTING_EVIDENCE' end, case when decision = 'SUFFICIENT' then 'CORE_POINTS_SUPPORTED' end, case when lacks then 'CORE_POINT_MISSING' end, case when asked then 'REQUESTED_ATTRIBUTE_MISSING' end], lambda x: x is not null), ',')"


@query("e6_evidence_decision", f"with {_ASSESSED} select item_id, decision, {_REASONS} as reasons from decided")
def e6(spark, sf_dir):
    return SU.decide(_assessed(spark, sf_dir)).select(F.col("query").alias("item_id"), "decision", F.array_join("reasons", ",").alias("reasons"))


_JOINED = _SCORED + ", joined as (select item_id, string_agg(text, chr(10) order by top.id) as j from top join documents on doc_id = top.id group by 1), aspects as (select item_id, point_no, " + " and ".join(
    [f"(not regexp_matches(point, '{'|'.join(_DUE[0])}') or regexp_matches(j, '{_DUE[1]}'))"] + [f"(not regexp_matches(point, '{'|'.join(a)}') or regexp_matches(j, '{'|'.join(b)}'))" for a, b in _ASPECTS]
) + " as supported from points join joined using (item_id))"


def _aspects(spark, sf_dir):
    joined = _hits(spark, sf_dir).groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n").alias("j"))  # five texts
    rows = _points(spark, sf_dir).withColumnRenamed("item_id", "query").join(joined, "query")
    return rows.select(F.col("query").alias("item_id"), "point_no", SU.aspect_supported(F.col("point"), F.col("j"), _DUE, _ASPECTS).alias("supported"))


@query("e11_aspects", f"with {_JOINED} select item_id, point_no, supported from aspects")
def e11(spark, sf_dir):
    return _aspects(spark, sf_dir)


@query("e12_evidence_states", f"with {_ASSESSED}, {_JOINED.removeprefix(_SCORED + ', ')}, s as (select item_id, count(*) filter (where supported) as n, count(*) as asked from aspects group by 1) select item_id, case when conflict then 'CONFLICT' when n = 0 then 'NOT_SUPPORTED' when n < s.asked then 'PARTIAL' else 'SUPPORTED' end as status from s join decided using (item_id)")
def e12(spark, sf_dir):
    """The four states by aspects, with the conflicts of the spans' own values."""
    conflict = SU.decide(_assessed(spark, sf_dir)).select(F.col("query").alias("item_id"), F.array_contains("reasons", "CONFLICTING_EVIDENCE").alias("conflict"))
    s = _aspects(spark, sf_dir).groupBy("item_id").agg(F.count_if("supported").alias("n"), F.count("*").alias("asked")).join(conflict, "item_id")
    return s.select("item_id", E.four_states(F.col("conflict"), F.col("n"), F.col("asked"), F.lit(False)).alias("status"))


@query("p7_gate_by_conflict", f"with {_ASSESSED} select item_id, case when decision = 'INSUFFICIENT' or mapped = 0 then 'BLOCKED' when mapped < required or decision = 'PARTIAL' then 'PARTIAL' else 'READY' end as gate from decided")
def p7(spark, sf_dir):
    d = SU.decide(_assessed(spark, sf_dir))
    return d.select(F.col("query").alias("item_id"), E.support_gate(F.col("decision"), F.col("mapped"), F.col("required"), F.lit(False)).alias("gate"))


@query("e14_conflict_gate")
def e14(spark, sf_dir):
    """The learned gate, fitted on the even items with the decisions that conflicts reach. No SQL grows trees; a fixture tests it."""
    from .evidence import _features

    truth = SU.decide(_assessed(spark, sf_dir)).select(F.col("query").alias("item_id"), F.when(F.col("decision") == "SUFFICIENT", 2).when(F.col("decision") == "PARTIAL", 1).otherwise(0).alias("label"))
    rows = keep(_features(spark, sf_dir).join(truth, "item_id"))
    out = E.learned_gate(rows.where("item_id % 2 = 0"), rows.where("item_id % 2 = 1"), "label", 0.5)
    return out.select("item_id", "label", "decision", "p_sufficient")


_THRESHOLDS = (0.5, 0.58, 0.62, 0.66, 0.7, 0.74, 0.78, 0.82, 0.9)
_LIKELY = "select *, (t + share) / (sum(t) over (partition by {by}, cell) + 1) as p from (select *, case when sum(t) over (partition by {by}) > 0 then sum(t) over (partition by {by}, label) / sum(t) over (partition by {by}) else 0 end as share from {of})"
_WIDE = "select {by}, cell, max(p) filter (where label = 'SUFFICIENT') as ps, max(p) filter (where label = 'PARTIAL') as pp, max(p) filter (where label = 'INSUFFICIENT') as pi from {of} group by all"
_NAME = "case when ps >= threshold then 'SUFFICIENT' when pp >= pi then 'PARTIAL' else 'INSUFFICIENT' end"


def _utility(by: str, of: str) -> str:
    n = lambda c: f"coalesce(sum(n) filter (where {c}), 0)"
    sums = ", ".join(f"{n(f"label = '{x}' and named = '{x}'")} as h{i}, {n(f"label = '{x}'")} as o{i}, {n(f"named = '{x}'")} as s{i}" for i, x in enumerate(CA.LABELS))
    part = lambda a, b: f"case when {b} > 0 then {a} / {b} else 0.0::double end"
    total = f"0.32 * (1 - {part('(s0 - h0)', '(o1 + o2)')}) + 0.28 * {part('h0', 'o0')} + 0.16 * {part('h1', 'o1')} + 0.12 * {part('h2', 'o2')} + 0.12 * (({' + '.join(part(f'2 * h{i}', f'(o{i} + s{i})') for i in range(3))}) / 3)"
    return f"select {by}, round({total}, 9) as u from (select {by}, {sums} from {of} group by all)"


_CELLS = r"select l.doc_id, case when quality = 1 and toxic = 0 then 'SUFFICIENT' when quality = 1 then 'PARTIAL' else 'INSUFFICIENT' end as label, floor(10 * length(regexp_replace(text, '[^a-z]', '', 'g')) / greatest(1, length(text)))::int || '/' || (length(text) > 900)::int as cell from labels l join documents using (doc_id) where quality is not null and toxic is not null"


@query("e17_nested_thresholds", f"""
with b as ({_CELLS}), f as (select *, sha256(doc_id || '||cv') as h from b), g as (select *, (row_number() over (partition by label order by h) - 1) % 5 as f from f), r as (select g.*, o from g, range(5) t(o)),
tr as (select *, (row_number() over (partition by o, label order by h) - 1) % 3 as i from r where f <> o), held as (select o, cell, label, count(*) as v from r where f = o group by all), cn as (select o, i, cell, label, count(*) as c from tr group by all),
cells as (select distinct cell from b), grid as (select t.o, s.i, cells.cell, l.label, coalesce(c, 0) as c from cells, range(5) t(o), range(3) s(i), (select unnest({list(CA.LABELS)}) as label) l left join cn on cn.o = t.o and cn.i = s.i and cn.cell = cells.cell and cn.label = l.label),
ins as (select *, sum(c) over (partition by o, cell, label) - c as t from grid), li as ({_LIKELY.format(by='o, i', of='ins')}), wi as ({_WIDE.format(by='o, i', of='li')}),
named as (select grid.o, k, threshold, label, {_NAME} as named, c as n from grid join wi using (o, i, cell), (select unnest(range({len(_THRESHOLDS)})) as k, unnest({list(_THRESHOLDS)})::double as threshold) where c > 0), sc as ({_utility('o, k, threshold', 'named')}),
ch as (select o, threshold, u from sc qualify row_number() over (partition by o order by u desc, k) = 1), ot as (select o, cell, label, sum(c) as t from grid group by all), lo as ({_LIKELY.format(by='o', of='ot')}), wo as ({_WIDE.format(by='o', of='lo')}),
ju as (select held.o, label, {_NAME} as named, v as n from held join wo using (o, cell) join ch using (o)), ut as ({_utility('o', 'ju')})
select o + 1 as fold, threshold, ch.u as inner_utility, n::bigint as validation_n, ut.u as validation_utility from ch join ut using (o) join (select o, sum(v) as n from held group by 1) using (o)""")
def e17_thresholds(spark, sf_dir):
    """Thresholds of a gate by the documents' own labels; what it sees of a text is its share of small letters, in tenths, and whether it is long."""
    text, plain = F.col("text"), F.regexp_replace("text", "[^a-z]", "")
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "SUFFICIENT").when(F.col("quality") == 1, "PARTIAL").otherwise("INSUFFICIENT")
    cell = F.concat_ws("/", F.floor(10 * F.char_length(plain) / F.greatest(F.lit(1), F.char_length(text))).cast("string"), (F.char_length(text) > 900).cast("int").cast("string"))
    rows = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    rows = rows.select("doc_id", label.alias("label"), label.alias("stratum"), cell.alias("cell"))
    return CA.nested_thresholds(rows, "doc_id", "stratum", "label", "cell", _THRESHOLDS)


@query("p14_span_quantiles", f"with {_ANCHORED}, g as (select kind, {_GRAMS.format(c='pc')} as pg, {_GRAMS.format(c='hc')} as hg from (select kind, {_G.format('p')} as pc, {_G.format('h')} as hc from sw)), s as (select kind, round(len(list_intersect(hg, pg)) / greatest(1, len(hg)), 6) as score from g), po as (select median(score) as pm, quantile_cont(score, 0.1) as p10, count(*) as positives from s where kind = 'POSITIVE'), ne as (select median(score) as nm, quantile_cont(score, 0.95) as n95, count(*) as swaps from s where kind <> 'POSITIVE'), ra as (select min(rate) as least_rate from (select kind, avg((pm > score)::int) as rate from s, po where kind <> 'POSITIVE' group by 1)) select positives, swaps, round(pm, 6) as positive_median, round(nm, 6) as swap_median, round(least_rate, 6) as least_rate, pm - nm >= 0.1 and least_rate >= 0.8 as reliable, coalesce((select min(t) from (values (0.8), (0.9), (0.95), (0.98), (1.0)) v(t) where t <= p10 and t > n95), 1.0)::double as threshold from po, ne, ra")
def p14(spark, sf_dir):
    """How well the spans' own score, the part of a claim's grams that its evidence has, tells texts from texts with facts exchanged."""
    score = F.round(T.coverage(T.content_grams(F.col("hypothesis")), T.content_grams(F.col("premise"))), 6)
    rows = _anchors(spark, sf_dir).groupBy("kind", "premise", "hypothesis").agg(F.count("*").alias("n"))  # equal pairs are weighed once
    return E.verifier_check(rows.withColumn("score", score), "kind", "score", (0.8, 0.9, 0.95, 0.98, 1.0), weight="n")


_INVENTORY = f"""{_SCORED}, iv as (select item_id, point_no, list(id || '#S' || span_no order by score desc, id, span_no)[1:3] as us from scored where score >= {E.PARTIAL} group by 1, 2)"""
_QUOTED = "'[' || array_to_string(list_transform(us, lambda u: '\"' || u || '\"'), ',') || ']'"
_VARIANT = (
    """'{"type":"object","properties":{"required_point_id":{"type":"string","enum":["P' || point_no || '"]},"claim_text":{"type":"string","minLength":1},"support_unit_ids":{"type":"array","items":{"type":"string","enum":' || """ + _QUOTED
    + """ || '},"minItems":1,"maxItems":1,"uniqueItems":true}},"required":["required_point_id","claim_text","support_unit_ids"],"additionalProperties":false}'"""
)
_SCHEMA = (
    """'{"type":"object","properties":{"answer_status":{"type":"string","enum":["READY"]},"claims":{"type":"array","items":{"oneOf":[' || string_agg(""" + _VARIANT
    + """, ',' order by point_no) || ']},"minItems":' || count(*) || ',"maxItems":' || count(*) || '}},"required":["answer_status","claims"],"additionalProperties":false}'"""
)


def _inventory(spark, sf_dir):
    """(item_id, points): of each item, its points with up to three spans each that support them."""
    best = E.best_spans(_scored(spark, sf_dir).where(F.col("score") >= E.PARTIAL), ["item_id", "point_no"], 3, ["id", "span_no"])
    units = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.col("id").cast("string"), F.lit("#S"), F.col("span_no").cast("string")).alias("u")))), lambda x: x["u"])
    rows = best.groupBy("item_id", "point_no").agg(units.alias("units"))
    of = F.transform(F.array_sort(F.collect_list(F.struct("point_no", "units"))), lambda x: F.struct(F.concat(F.lit("P"), x["point_no"].cast("string")).alias("point"), x["units"].alias("units")))
    return rows.groupBy("item_id").agg(of.alias("points"))


@query("v10_support_schema", f"with {_INVENTORY} select item_id, sha256({_SCHEMA}) as schema_sha256 from iv group by 1")
def v10(spark, sf_dir):
    return _inventory(spark, sf_dir).select("item_id", F.sha2(J.support_schema(F.col("points"), F.lit("READY")), 256).alias("schema_sha256"))


_FAULTS = ("NOT_AN_OBJECT", "UNKNOWN_MEMBER", "ANSWER_STATUS", "CLAIM_COUNT", "UNKNOWN_POINT", "EMPTY_CLAIM", "SUPPORT_COUNT", "FOREIGN_SUPPORT")


@query("v11_schema_faults", f"with {_INVENTORY} select item_id, case item_id % 9 {' '.join(f'when {i} then {chr(39)}{x}{chr(39)}' for i, x in enumerate(_FAULTS, 1))} end as fault from iv group by item_id")
def v11(spark, sf_dir):
    """Answers made from the inventories, each with a fault by its item's number, or none."""
    k, points = F.col("item_id") % 9, F.col("points")
    first = lambda p, i: i == 0
    claim = lambda p, i: F.struct(
        F.when(first(p, i) & (k == 5), "P99").otherwise(p["point"]).alias("required_point_id"), F.when(first(p, i) & (k == 6), "").otherwise("A claim.").alias("claim_text"),
        F.when(first(p, i) & (k == 7), F.array(p["units"][0], p["units"][0])).when(first(p, i) & (k == 8), F.array(F.lit("0#S0"))).otherwise(F.array(p["units"][0])).alias("support_unit_ids"),
        F.when(first(p, i) & (k == 2), "more").alias("note"),
    )
    claims = F.transform(points, claim)
    claims = F.when(k == 4, F.slice(claims, 1, F.size(claims) - 1)).otherwise(claims)
    answer = F.to_json(F.struct(F.when(k == 3, "PARTIAL").otherwise("READY").alias("answer_status"), claims.alias("claims")))
    answer = F.when(k == 1, F.concat(F.lit("answer: "), answer)).otherwise(answer)
    return _inventory(spark, sf_dir).select("item_id", J.schema_fault(answer, points, F.lit("READY")).alias("fault"))
