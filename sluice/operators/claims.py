"""Claims against their evidence: facts that both must name, and what citations are worth."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import HAN, citation_norm, compact, content_grams, ngrams
from .evidence import PARTIAL
from .pages import all_rules


@dataclass(frozen=True)
class Facts:
    """How facts look: a number's units and a moment (patterns), entities (a pattern), words of a procedure and of a sequence, and names that stand for each other."""

    units: str = "%|元|人民币|万|天|日|月|年|小时|分钟|人|次|门|学分|本|册|份|个"
    moment: str = r"(?:20\d{2}年)?\d{1,2}月\d{1,2}日|20\d{2}年|\d{1,2}[:：]\d{2}|周[一二三四五六日]"
    entity: str = r"[\p{IsHan}A-Za-z0-9]{2,24}(?:大学|学院|中心|处|部|办公室|图书馆|医院|系统|平台)"
    procedure: tuple[str, ...] = ("登录", "提交", "申请", "审核", "领取", "缴费", "打印", "上传", "预约")
    sequence: tuple[str, ...] = ("首先", "然后", "之前", "之后", "最后", "同时")
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)


def numbers_with_units(text: Column, units: str) -> Column:
    """The distinct numbers of a text as value|unit: without zeros that say nothing, hours as they are; without a unit, value|."""
    one = rf"\d+(?:\.\d+)?(?::\d{{1,2}})?"
    found = lambda i: F.regexp_extract_all(text, F.lit(rf"({one})\s*({units})?"), i)
    plain = lambda v: F.when(F.contains(v, F.lit(":")), v).otherwise(F.regexp_replace(F.regexp_replace(v, r"(\.\d*?)0+$", "$1"), r"\.$|^0+(?=\d)", ""))
    return F.array_distinct(F.zip_with(found(1), found(2), lambda v, u: F.concat(plain(v), F.lit("|"), F.coalesce(u, F.lit("")))))


def bigram_coverage(claim: Column, evidence: Column) -> Column:
    """The part of a claim's pairs of letters and digits (Latin in lower case, Han) that its evidence has; 0 for a claim without any."""
    pairs = lambda x: F.transform(F.array(F.regexp_replace(citation_norm(x), f"[^0-9a-z{HAN}]", "")), lambda s: F.when(F.char_length(s) < 2, F.filter(F.array(s), lambda c: c != "")).otherwise(F.array_distinct(ngrams(s, 2))))[0]
    both = F.struct(pairs(claim).alias("a"), pairs(evidence).alias("b"))
    return F.transform(F.array(both), lambda x: F.when(F.size(x["a"]) > 0, F.size(F.array_intersect(x["a"], x["b"])) / F.size(x["a"])).otherwise(F.lit(0.0)))[0]


def fact_rules(claim: Column, evidence: Column, facts: Facts = Facts()) -> Column:
    """(flags, coverage, exact) of a claim and its evidence. flags: NUMERIC_, TEMPORAL_, ENTITY_, PROCEDURAL_ and SEQUENCE_MISMATCH, for what the claim names and the evidence doesn't.

    A number needs its unit, or none, in the evidence; a moment may stand anywhere in it; an entity may go by another name. Nulls are empty texts.
    """
    claim, evidence = F.coalesce(claim, F.lit("")), F.coalesce(evidence, F.lit(""))
    seen = citation_norm(evidence)
    shown = numbers_with_units(evidence, facts.units)
    number = F.forall(numbers_with_units(claim, facts.units), lambda p: F.array_contains(shown, p) | F.array_contains(shown, F.concat(F.substring_index(p, "|", 1), F.lit("|"))))
    moments = F.transform(F.regexp_extract_all(claim, F.lit(f"({facts.moment})"), 1), citation_norm)
    names = F.regexp_extract_all(claim, F.lit(f"({facts.entity})"), 1)
    other = F.create_map(*[x for k, v in facts.aliases.items() for x in (F.lit(k.lower()), F.array(*[F.lit(n.lower()) for n in v]))]) if facts.aliases else None

    def named(e: Column) -> Column:
        own = F.contains(seen, citation_norm(e))
        return own | F.coalesce(F.exists(F.try_element_at(other, citation_norm(e)), lambda a: F.contains(seen, a)), F.lit(False)) if other is not None else own

    words = lambda ws: ~F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(claim, w) & ~F.contains(evidence, w))
    flags = all_rules([
        ("NUMERIC_MISMATCH", ~number), ("TEMPORAL_MISMATCH", ~F.forall(moments, lambda m: F.contains(seen, m))), ("ENTITY_MISMATCH", ~F.forall(F.filter(names, lambda e: F.char_length(e).between(2, 32)), named)),
        ("PROCEDURAL_MISMATCH", ~words(facts.procedure)), ("SEQUENCE_MISMATCH", ~words(facts.sequence)),
    ])
    return F.struct(flags.alias("flags"), F.round(bigram_coverage(claim, evidence), 6).alias("coverage"), F.contains(seen, citation_norm(claim)).alias("exact"))


def covered_by(text: Column, held: Column) -> Column:
    """The part of a text's content grams that stand in a compacted text."""
    return F.transform(F.array(content_grams(text)), lambda g: F.size(F.filter(g, lambda x: F.contains(held, x))) / F.greatest(F.lit(1), F.size(g)))[0]


#: Failures of an answer, the worst first.
FAILURES = ("FAILED_REFUSAL", "UNSUPPORTED_ADDITION", "WRONG_REFUSAL", "INCOMPLETE", "CITATION_MISSING", "CITATION_INCOMPLETE", "CITATION_MISMATCH")


def citation_audit(claims: DataFrame, contexts: DataFrame, answers: DataFrame, points: DataFrame, required: tuple[str, ...], least: float = PARTIAL, complete: float = 0.75, supporters: int = 3) -> DataFrame:
    """(query, required, cited, valid, supporting, unsupported, completeness, labels, primary) of each answer.

    claims: (query, claim_no, text, type), citations in it as [C1]. contexts: (query, label, text), C1 and so on. answers: (query, text, decision, refused). points: (query, point). Of the claims of a `required` type: how many are
    cited, with labels that there are, by one of the `supporters` best contexts that cover `least` of it, and how many no context supports. completeness: the part of the points of which the answer covers `least`; null without points. labels: all failures
    that hold, primary: the worst, or NO_GENERATION_FAILURE.
    """
    marks = r"\[(C\d+)\]"
    bare = F.regexp_replace("text", marks, "")
    rows = claims.select("query", "claim_no", F.col("type").isin(*required).alias("must"), F.regexp_extract_all("text", F.lit(marks), 1).alias("ids"), bare.alias("said"))
    held = contexts.groupBy("query").agg(F.collect_list(F.struct("label", compact(F.coalesce("text", F.lit(""))).alias("held"))).alias("cs"))  # what one query was given
    scored = F.transform("cs", lambda c: F.struct((-F.round(covered_by(F.col("said"), c["held"]), 6)).alias("s"), c["label"].alias("label")))
    best = F.transform(F.slice(F.array_sort(F.filter(scored, lambda x: x["s"] <= -least)), 1, supporters), lambda x: x["label"])
    none = F.array().cast("array<string>")
    rows = rows.join(held, "query", "left").select("query", "claim_no", "must", "ids", F.coalesce(best, none).alias("support"), F.coalesce(F.transform("cs", lambda c: c["label"]), none).alias("known"))
    cited = F.size("ids") > 0
    valid = cited & (F.size(F.array_except("ids", "known")) == 0)
    backed = valid & (F.size(F.array_intersect("ids", "support")) > 0)
    sums = rows.groupBy("query").agg(
        F.count_if("must").alias("required"), F.count_if(F.col("must") & cited).alias("cited"), F.count_if(F.col("must") & valid).alias("valid"), F.count_if(F.col("must") & backed).alias("supporting"), F.count_if(F.col("must") & (F.size("support") == 0)).alias("unsupported"),
        F.coalesce(F.bool_or(cited & ~backed), F.lit(False)).alias("off"),
    )
    whole = points.join(answers.select("query", compact(F.coalesce("text", F.lit(""))).alias("held")), "query").groupBy("query").agg(F.round(F.avg((F.round(covered_by(F.col("point"), F.col("held")), 6) >= least).cast("double")), 6).alias("completeness"))
    out = answers.select("query", "decision", F.coalesce("refused", F.lit(False)).alias("refused")).join(sums, "query", "left").join(whole, "query", "left").na.fill(0, ["required", "cited", "valid", "supporting", "unsupported"])
    enough = F.col("decision") == "SUFFICIENT"
    rules = {
        "FAILED_REFUSAL": (F.col("decision") == "INSUFFICIENT") & ~F.col("refused") & (F.col("required") > 0), "UNSUPPORTED_ADDITION": F.col("unsupported") > 0, "WRONG_REFUSAL": enough & F.col("refused"), "INCOMPLETE": enough & (F.col("completeness") < complete),
        "CITATION_MISSING": (F.col("required") > 0) & (F.col("cited") == 0), "CITATION_INCOMPLETE": (F.col("cited") > 0) & (F.col("cited") < F.col("required")), "CITATION_MISMATCH": F.coalesce("off", F.lit(False)),
    }
    labels = all_rules([(k, rules[k]) for k in FAILURES])
    out = out.withColumn("labels", labels)
    return out.select("query", "required", "cited", "valid", "supporting", "unsupported", "completeness", "labels", F.coalesce(F.try_element_at("labels", F.lit(1)), F.lit("NO_GENERATION_FAILURE")).alias("primary"))


def confirmed_facts(queries: DataFrame, sentences: DataFrame, tokens, hit_order: list[str], terms: tuple[str, ...] = (), most: int = 5, longest: int = 320) -> DataFrame:
    """(query, fact_no, hit, sentence): of each hit of a query the sentence that says most of it, no sentence twice, `most` of them, in the order of the hits.

    queries: (query, text). sentences: (query, hit, sentence_no, sentence) and the columns of `hit_order`. A sentence counts by the terms that it shares with the query, over the root of how many it has; of equal ones the shorter comes first, then the earlier.
    Headings don't count, nor do sentences without a shared term; where a hit has sentences with one of `terms`, only these do. Facts are cut to `longest` characters by the rule itself.
    """
    asked = queries.select("query", F.array_distinct(tokens(F.col("text"))).alias("q"))
    rows = sentences.where(~F.startswith(F.ltrim("sentence"), F.lit("#"))).join(asked, "query").withColumn("s", F.array_distinct(tokens(F.col("sentence"))))
    named = F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains("sentence", t)) if terms else F.lit(True)
    shared = F.size(F.array_intersect("q", "s"))
    rows = rows.select("query", "hit", *hit_order, "sentence_no", "sentence", named.alias("named"), shared.alias("shared"), F.round(shared / F.sqrt(F.greatest(F.lit(1), F.size("s"))), 6).alias("score"))
    first = F.row_number().over(W.partitionBy("query", "hit").orderBy(F.desc("named"), F.desc("score"), F.char_length("sentence"), "sentence_no"))
    best = rows.withColumn("_n", first).where("_n = 1 and shared > 0").withColumn("_k", F.regexp_replace("sentence", r"[*#\s]+", ""))
    once = best.withColumn("_d", F.row_number().over(W.partitionBy("query", "_k").orderBy(*hit_order))).where("_d = 1")
    out = once.withColumn("fact_no", F.row_number().over(W.partitionBy("query").orderBy(*hit_order)).cast("long")).where(F.col("fact_no") <= most)
    return out.select("query", "fact_no", "hit", F.substring("sentence", 1, longest).alias("sentence"))
