"""Admission: rules that give a reason for every row that they turn away."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host
from .metadata import within
from .pages import all_rules, first_rule


def first_failing(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """reason (the first rule that holds, null if none) and admitted; no row is dropped."""
    return df.withColumn("reason", first_rule(rules, None)).withColumn("admitted", F.col("reason").isNull())


def all_failing(df: DataFrame, rules: list[tuple[str, Column]], score: Column, least: float) -> DataFrame:
    """reasons (all rules that hold), score, and admitted: no reason and at least `least`."""
    out = df.withColumns({"reasons": all_rules(rules), "score": F.round(score, 6)})
    return out.withColumn("admitted", (F.size("reasons") == 0) & (F.col("score") >= least))


def admission_rules(as_of: str, hosts: tuple[str, ...], news: str, shut_types: tuple[str, ...], actions: tuple[str, ...], social: str | None = None, shortest: int = 220, head: int = 5000) -> list[tuple[str, Column]]:
    """The eleven tests of a source, in order, over the columns access_level, url, authority_level, title, text, content_type, expiry_date and quality_score.

    A reference without an action in its title needs three kinds of action in title and head and a quality of 0.8; a notice may not speak of years before the last.
    The first `head` characters are looked at for actions, by the rule itself.
    """
    c, day = F.col, F.lit(as_of).cast("date")
    has = lambda x, word: F.contains(F.lower(x), F.lit(word.lower()))
    joined = F.concat(c("title"), F.lit("\n"), F.substring("text", 1, head))
    count = sum((has(joined, w).cast("int") for w in actions), F.lit(0))
    in_title = F.exists(F.array(*[has(c("title"), w) for w in actions]), lambda x: x)
    own = F.exists(F.array(*[within(host(c("url")), h) for h in hosts]), lambda x: x)
    year = F.array_max(F.transform(F.regexp_extract_all("title", F.lit(r"(?<!\d)(20\d{2})(?!\d)"), 1), lambda y: y.cast("int")))
    return [
        ("restricted_source", F.coalesce(c("access_level"), F.lit("public")) != "public"), ("unverified_host", ~own),
        ("unverified_social_account", (host(c("url")) == (social or "")) & ~c("authority_level").eqNullSafe("official_social")), ("insufficient_content", F.char_length("text") < shortest),
        ("news_or_publicity", c("title").rlike(news)), ("non_transactional_type", c("content_type").isin(*shut_types)), ("expired", c("expiry_date") < day),
        ("not_actionable", c("content_type").isin("reference", "notice") & (count == 0)),
        ("weak_reference", (c("content_type") == "reference") & ~in_title & ((count < 3) | (F.coalesce(c("quality_score"), F.lit(1.0)) < 0.8))),
        ("stale_notice", (c("content_type") == "notice") & (year < F.year(day) - 1)), ("unverified_authority", c("authority_level") == "unverified"),
    ]


def crawl_admission(df: DataFrame, title: Column, body: Column, published: Column, kind: Column, topics: Column, low_value: str, generic: str, subject: str, action: str, facts: str, plain_topic: str, good: tuple[str, ...] = ("policy", "procedure_guide", "faq"), head: int = 5000) -> tuple[DataFrame, list[tuple[str, Column]], Column]:
    """(df with what the rules go by, the reasons that turn a crawled page away, its additive score); patterns are of title and the first `head` visible characters, by the rule itself.

    The visible text, its sample and what patterns find there are columns of their own, so that each is made once a row however many rules ask for it.
    """
    c = F.col
    rows = df.withColumns({"_visible": F.regexp_replace(body, r"\s+", " "), "_title": title, "_kind": kind})
    rows = rows.withColumns({"_sample": F.concat("_title", F.lit("\n"), F.substring("_visible", 1, head)), "_n": F.char_length("_visible")})
    rows = rows.withColumn("_relevant", c("_sample").rlike(subject))
    rows = rows.withColumn("_able", c("_kind").isin(*good) | c("_sample").rlike(action) | (c("_relevant") & c("_sample").rlike(facts)))
    score = F.lit(0.25) + F.when(c("_kind").isin(*good), 0.25).otherwise(0.08) + F.when(c("_n") >= 500, 0.20).when(c("_n") >= 200, 0.10).otherwise(0.0) + F.when(published.isNotNull(), 0.15).otherwise(0.0)
    score = score + F.when((F.size(topics) > 0) & (topics != F.array(F.lit(plain_topic))), 0.15).otherwise(0.05)
    rules = [("CONTENT_TOO_SHORT", c("_n") < 200), ("LOW_VALUE_NEWS_OR_PROFILE", c("_title").rlike(low_value)), ("GENERIC_NON_ACTIONABLE_TITLE", c("_title").rlike(generic) & ~c("_able")), ("NO_SUBJECT_SIGNAL", ~c("_relevant")), ("NO_ACTIONABLE_OR_SERVICE_FACTS", c("_relevant") & ~c("_able"))]
    return rows, rules, score


def shadow_rules(served: Column, allow: str, reject: str, generic: str, foreign: str, versions: tuple[str, ...], queue: tuple[str, ...] = ("review_required", "auto_review_candidate"), good: tuple[str, ...] = ("policy", "procedure_guide", "faq"), least: float = 0.70) -> list[tuple[str, Column]]:
    """Why a candidate isn't taken over: twelve reasons over the columns admission_status, access_level, authority_level, source_version, quality_score, content_type, title, the dates and text."""
    c = F.col
    return [
        ("NOT_IN_REVIEW_QUEUE", ~c("admission_status").isin(*queue)), ("DUPLICATE_SERVED_SOURCE", served), ("NON_PUBLIC_ACCESS", c("access_level") != "public"), ("NOT_OFFICIAL", c("authority_level") != "official"),
        ("NOT_CRAWL_VERIFIED", ~F.coalesce(c("source_version"), F.lit("")).isin(*versions)), ("QUALITY_BELOW_LIMIT", F.coalesce(c("quality_score"), F.lit(0.0)) < least), ("NOT_ACTIONABLE_TYPE", ~c("content_type").isin(*good)),
        ("TITLE_NOT_TRANSACTIONAL", ~c("title").rlike(allow)), ("NEWS_OR_GENERIC_TITLE", c("title").rlike(reject) | c("title").rlike(generic)), ("OUT_OF_SCOPE", c("title").rlike(foreign)),
        ("NO_TEMPORAL_METADATA", F.coalesce("publish_date", "effective_date", "expiry_date").isNull()), ("MISSING_CONTENT", F.coalesce(F.trim("text"), F.lit("")) == ""),
    ]


#: What a page of errors and one of navigation say.
ERRORS, NAVIGATION = r"login required|sign in to|access denied|404 not found", ("home", "navigation", "menu", "cookie")


def assess_page(url: Column, text: Column) -> tuple[Column, Column]:
    """(reasons, verdict) of a web page's text: REJECT if it is empty or an error, PARTIAL on any other reason, else PASS."""
    low = F.trim(F.lower(text))
    found = sum((F.contains(low, F.lit(w)).cast("int") for w in NAVIGATION), F.lit(0))
    rules = [("EMPTY", low == ""), ("TOO_SHORT", F.char_length(low) < 120), ("LOGIN_OR_ERROR", low.rlike(ERRORS)), ("NAVIGATION_ONLY", (found >= 3) & (F.char_length(low) < 500)), ("UNKNOWN_HOST", F.coalesce(host(url), F.lit("")) == "")]
    reasons = all_rules(rules)
    return reasons, F.when(F.arrays_overlap(reasons, F.array(F.lit("EMPTY"), F.lit("LOGIN_OR_ERROR"))), "REJECT").when(F.size(reasons) > 0, "PARTIAL").otherwise("PASS")


def review_flags(shut_types: tuple[str, ...]) -> Column:
    """Why a review looks odd: nine rules over relevance_score, knowledge_value, recommended_action, content_type, authority, freshness, time_sensitivity, personal_data_risk and possible_conflict."""
    c = F.col
    yes = c("recommended_action") == "approve"
    return all_rules([
        ("RELEVANT_BUT_REJECTED", (c("relevance_score") >= 80) & (c("recommended_action") == "reject")), ("IRRELEVANT_BUT_APPROVED", (c("relevance_score") <= 30) & yes), ("WORTHLESS_BUT_APPROVED", (c("knowledge_value") <= 40) & yes),
        ("NEWS_BUT_APPROVED", c("content_type").isin(*shut_types) & yes), ("AUTHORITATIVE_BUT_WORTHLESS", (c("authority") == "high") & (c("knowledge_value") <= 20)), ("OUTDATED_BUT_APPROVED", (c("freshness") == "outdated") & yes),
        ("VOLATILE_BUT_APPROVED", (c("time_sensitivity") == "high") & yes), ("PERSONAL_BUT_APPROVED", (c("personal_data_risk") != "none") & yes), ("CONFLICT_BUT_APPROVED", c("possible_conflict") & yes),
    ])


def eligibility(df: DataFrame, rejecting: list[tuple[str, Column]], unresolved: list[tuple[str, Column]]) -> DataFrame:
    """eligible, rejected or unresolved, with the reasons of whichever decides."""
    out = df.withColumns({"reasons": all_rules(rejecting), "open": all_rules(unresolved)})
    return out.withColumn("decision", F.when(F.size("reasons") > 0, "rejected").when(F.size("open") > 0, "unresolved").otherwise("eligible"))


def copy_guard(df: DataFrame, a: str, b: str, ratio: float = 0.70, tokens: float = 0.75) -> DataFrame:
    """copied: b repeats a by matching blocks or by the share of a's words."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q):
            p, q = (p or "").lower(), (q or "").lower()
            words = set(p.split())
            share = len(words & set(q.split())) / max(1, len(words))
            return share >= tokens or difflib.SequenceMatcher(None, p, q, autojunk=False).ratio() >= ratio

        return pd.Series([one(p, q) for p, q in zip(x, y)])

    return df.withColumn("copied", run(F.col(a), F.col(b)))


def parents_kept(rows: DataFrame, labels: DataFrame, row_id: str, parent: Column, least_quality: float = 0.6, most_toxic: float = 0.2, least_chars: int = 30) -> DataFrame:
    """Rows with labels good enough whose parent is there too."""
    good = rows.withColumn("_parent", parent).join(labels, row_id).where((F.col("quality") >= least_quality) & (F.col("toxic") <= most_toxic) & (F.char_length("text") >= least_chars))
    return good.join(rows.select(F.col(row_id).alias("_parent")).distinct(), "_parent", "left_semi").drop("_parent")


def grounded(claim: Column, evidence: Column, least: float = 0.25, shortest: int = 20, longest: int = 1200) -> Column:
    """The claim's numbers are all in the evidence, enough of its character pairs are, and its length is in bounds."""
    from ..functions.text import bigram_set, coverage, numbers

    return (F.size(F.array_except(numbers(claim), numbers(evidence))) == 0) & (coverage(bigram_set(claim), bigram_set(evidence)) >= least) & F.char_length(claim).between(shortest, longest)
