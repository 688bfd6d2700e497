"""Whether evidence suffices: what a point asks for, what its spans say of it, where they contradict each other, and what follows for the query."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.lexicons import ASKED, SHOWN, VALUES
from ..functions.text import compact, content_grams
from .evidence import PARTIAL, RELATED, SUPPORTED, patterns
from .pages import all_rules, first_rule

#: Attributes whose values can contradict each other, and what tells that a status is a current one.
SINGLE, CURRENT = ("DEADLINE", "TIME", "PRICE", "CONTACT"), "目前|当前|现行|最新|2026"
#: What a deadline looks like, what asks for one, and for each kind of asking what evidence has to name.
DEADLINE = (("截止", "什么时候", "时间"), r"(?:截止|截至).{0,40}(?:20\d{2}年)?\d{1,2}月\d{1,2}日|(?:20\d{2}年)?\d{1,2}月\d{1,2}日(?:\s*\d{1,2}[:：]\d{2})?|\d{1,2}[:：]\d{2}")
ASPECTS = (
    (("条件", "资格", "对象"), ("条件", "资格", "要求", "应当", "适用于", "须符合")),
    (("材料",), ("材料", "申请表", "证明", "附件", "上传", "提交")),
    (("步骤", "流程", "办理"), ("步骤", "流程", "办理", "登录", "申请", "审核", "审批")),
    (("入口", "网址", "系统"), ("入口", "网址", "系统", "http://", "https://")),
)


def attribute_evidence(scored: DataFrame, asked: DataFrame, order: list[str], shown: dict[str, str] | None = None, values: dict[str, str] | None = None, least: float = PARTIAL, first: int = 4, current: str = CURRENT) -> DataFrame:
    """(query, point, attribute, matching, values, missing, conflict) for each attribute that a point asks for.

    scored: (query, point, text, url, score) and the columns of `order`, which settle ties. Of the spans with `least` or more that show the attribute, in text or URL, the `first` best give its values, compacted and each once.
    missing: no span shows it, or, of CURRENT_STATUS, none says that it is current. conflict: one of `SINGLE` has several values.
    """
    shown = dict(patterns(SHOWN)) if shown is None else shown
    values = VALUES if values is None else values
    target = F.concat_ws(" ", "text", "url")
    case = lambda rules, default: F.coalesce(*[F.when(F.col("attribute") == k, v) for k, v in rules.items()], default)
    shows = case({k: target.rlike(f"(?i)(?:{p})") for k, p in shown.items()}, F.lit(False))
    none = F.array().cast("array<string>")
    said = case({k: F.transform(F.regexp_extract_all("text", F.lit(f"({p})"), 1), compact) for k, p in values.items()}, none)
    rows = scored.where(F.col("score") >= least).join(asked, ["query", "point"]).where(shows)
    rank = F.row_number().over(W.partitionBy("query", "point", "attribute").orderBy(F.desc("score"), *order))
    rows = rows.select("query", "point", "attribute", rank.alias("rank"), said.alias("said"), F.col("text").rlike(current).alias("now"))
    found = rows.groupBy("query", "point", "attribute").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rank") <= first, F.col("said")))))).alias("vs"), F.bool_or("now").alias("now"))
    out = asked.join(found, ["query", "point", "attribute"], "left")
    n = F.coalesce("n", F.lit(0))
    stale = (F.col("attribute") == "CURRENT_STATUS") & ~F.coalesce("now", F.lit(False))
    vs = F.coalesce("vs", none)
    return out.select("query", "point", "attribute", n.cast("long").alias("matching"), vs.alias("values"), ((n == 0) | stale).alias("missing"), (F.col("attribute").isin(*SINGLE) & (F.size(vs) > 1)).alias("conflict"))


def requested(points: DataFrame, text: Column, lexicon: dict[str, str] | None = None) -> DataFrame:
    """(query, point, attribute) of what points (query, point) ask for; TIME yields to DEADLINE."""
    lexicon = dict(patterns(ASKED)) if lexicon is None else lexicon
    deadline = text.rlike(lexicon["DEADLINE"]) if "DEADLINE" in lexicon else F.lit(False)
    names = F.array_compact(F.array(*[F.when(text.rlike(p) & (~deadline if k == "TIME" else F.lit(True)), F.lit(k)) for k, p in lexicon.items()]))
    return points.select("query", "point", F.explode(names).alias("attribute"))


def document_relevance(queries: DataFrame, hits: DataFrame, entity: str) -> DataFrame:
    """(query, document_score, missing_entities): how much of a query its hits (query, title, text) cover together, and which of its entities, by the pattern, none of them names."""
    blob = compact(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("title", "text"))), lambda x: F.concat_ws(" ", x["title"], x["text"])), " "))
    rows = queries.select("query", F.col("text").alias("q")).join(hits.groupBy("query").agg(blob.alias("blob")), "query", "left")
    held = lambda x: F.contains(F.coalesce("blob", F.lit("")), x)
    grams = F.transform(F.array(content_grams(F.col("q"))), lambda g: F.size(F.filter(g, held)) / F.greatest(F.lit(1), F.size(g)))[0]
    entities = F.array_distinct(F.regexp_extract_all("q", F.lit(f"({entity})"), 1))
    return rows.select("query", F.round(grams, 6).alias("document_score"), F.filter(entities, lambda e: ~held(compact(e))).alias("missing_entities"))


def assess(points: DataFrame, scored: DataFrame, attributes: DataFrame, documents: DataFrame) -> DataFrame:
    """(query, point, best_score, status, missing, conflicts) of each point (query, point).

    CONFLICT if any attribute has one; SUPPORTED from 0.52 on, if no attribute is missing and the documents name all entities and cover 0.08 of the query; PARTIALLY_SUPPORTED from 0.18 on, if they name all
    entities; else NOT_SUPPORTED.
    """
    best = scored.groupBy("query", "point").agg(F.max("score").alias("best_score"))
    told = attributes.groupBy("query", "point").agg(F.array_sort(F.collect_list(F.when(F.col("missing"), F.col("attribute")))).alias("missing"), F.array_sort(F.collect_list(F.when(F.col("conflict"), F.col("attribute")))).alias("conflicts"))
    none = F.array().cast("array<string>")
    rows = points.select("query", "point").join(best, ["query", "point"], "left").join(told, ["query", "point"], "left").join(documents, "query", "left")
    rows = rows.withColumns({"best_score": F.coalesce("best_score", F.lit(0.0)), "missing": F.coalesce("missing", none), "conflicts": F.coalesce("conflicts", none)})
    named = F.size(F.coalesce("missing_entities", none)) == 0
    status = first_rule([
        ("CONFLICT", F.size("conflicts") > 0), ("SUPPORTED", (F.col("best_score") >= SUPPORTED) & named & (F.size("missing") == 0) & (F.coalesce("document_score", F.lit(0.0)) >= RELATED)), ("PARTIALLY_SUPPORTED", (F.col("best_score") >= PARTIAL) & named),
    ], "NOT_SUPPORTED")
    return rows.select("query", "point", "best_score", status.alias("status"), "missing", "conflicts")


def decide(assessed: DataFrame) -> DataFrame:
    """(query, decision, reasons, mapped, required): INSUFFICIENT on a conflict, SUFFICIENT if all points are supported, PARTIAL if any is at all."""
    has = lambda *names: F.bool_or(F.col("status").isin(*names))
    rows = assessed.groupBy("query").agg(
        has("CONFLICT").alias("conflict"), F.bool_and(F.col("status") == "SUPPORTED").alias("whole"), has("SUPPORTED", "PARTIALLY_SUPPORTED").alias("some"), has("NOT_SUPPORTED", "CONFLICT").alias("lacks"),
        F.bool_or(F.size("missing") > 0).alias("asked"), F.count_if(F.col("status").isin("SUPPORTED", "PARTIALLY_SUPPORTED")).alias("mapped"), F.count("*").alias("required"),
    )
    decision = first_rule([("INSUFFICIENT", F.col("conflict")), ("SUFFICIENT", F.col("whole")), ("PARTIAL", F.col("some"))], "INSUFFICIENT")
    rows = rows.withColumn("decision", decision)
    reasons = all_rules([("CONFLICTING_EVIDENCE", F.col("conflict")), ("CORE_POINTS_SUPPORTED", F.col("decision") == "SUFFICIENT"), ("CORE_POINT_MISSING", F.col("lacks")), ("REQUESTED_ATTRIBUTE_MISSING", F.col("asked"))])
    return rows.select("query", "decision", reasons.alias("reasons"), "mapped", "required")


def aspect_supported(question: Column, joined: Column, deadline=DEADLINE, aspects=ASPECTS) -> Column:
    """Whether the joined texts of a subquery's hits hold what it asks for: something like a deadline, and a marker of each kind of asking."""
    any_of = lambda x, words: x.rlike("|".join(map(re.escape, words)))
    joined = F.coalesce(joined, F.lit(""))
    out = ~any_of(question, deadline[0]) | joined.rlike(deadline[1])
    for asked, shown in aspects:
        out = out & (~any_of(question, asked) | any_of(joined, shown))
    return out
