"""Planning, understanding and routing of queries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .pages import all_rules, first_rule


def _has(text: Column, words: tuple[str, ...]) -> Column:
    """Any of the words, as they are written, is in the text."""
    return text.rlike("|".join(map(re.escape, words))) if words else F.lit(False)


@dataclass(frozen=True)
class Lexicon:
    """What a planner knows: names and their aliases, topics by markers, marks of hard questions, of procedures and of how these are asked for, aspects
    (marks, and what to ask of the subject), marks of questions about the present, and audiences."""

    aliases: dict[str, tuple[str, ...]]
    topics: dict[str, tuple[str, ...]]
    complex: tuple[str, ...]
    procedures: tuple[str, ...]
    asking: tuple[str, ...]
    aspects: tuple[tuple[tuple[str, ...], str], ...]
    otherwise: str
    current: tuple[str, ...]
    audiences: tuple[tuple[str, str], ...] = ()
    named: str = " (terms: {})"
    joined: str = ", "
    clauses: str = r"[；;]|以及|并且|同时|另外"
    trimmed: str = r"^[ ？?，,。]+|[ ？?，,。]+$"


def plan_queries(df: DataFrame, id_col: str, text_col: str, words: Lexicon, forced: str | None = None, long: int = 45, shortest: int = 3, most: int = 4) -> DataFrame:
    """(id, query, rewritten, subqueries, path, reasons, topics, current_only, audience, terms, wants_action) of each query that isn't blank.

    Names whose aliases a query uses are added to it. It takes the FULL path for any reason (a complex mark, several topics, length, a procedure asked for), or the
    one that the column `forced` names, and is then cut into clauses; one clause about a procedure becomes a question for each aspect that it asks for.
    At most `most` subqueries, each once, in order.
    """
    q = F.trim(F.regexp_replace(F.col(text_col), r"\s+", " "))
    rows = df.where(F.trim(F.coalesce(text_col, F.lit(""))) != "").select(id_col, q.alias("query"), *([F.upper(forced).alias("_forced")] if forced else [F.lit(None).cast("string").alias("_forced")]))
    q, low = F.col("query"), F.lower("query")
    terms = F.array_sort(all_rules([(name, F.exists(F.array(*[F.contains(low, F.lit(w.lower())) for w in (name, *others)]), lambda x: x)) for name, others in words.aliases.items()]))
    rows = rows.select("*", terms.alias("terms"), all_rules([(t, _has(q, ws)) for t, ws in words.topics.items()]).alias("topics"), _has(q, words.procedures).alias("wants_action"))
    new = F.filter("terms", lambda t: ~F.contains(q, t))
    before, after = words.named.split("{}")
    rows = rows.withColumn("rewritten", F.when(F.size(new) > 0, F.concat(q, F.lit(before), F.array_join(new, words.joined), F.lit(after))).otherwise(q))
    rules = [("complex_intent_marker", _has(q, words.complex)), ("cross_topic", F.size("topics") > 1), ("long_query", F.char_length(q) > long), ("actionable_procedure", F.col("wants_action") & _has(q, words.asking))]
    rows = rows.withColumn("_why", all_rules(rules))
    rows = rows.withColumn("path", F.coalesce("_forced", F.when(F.size("_why") > 0, "FULL").otherwise("FAST")))
    rows = rows.withColumn("reasons", F.array_sort(F.array_compact(F.concat("_why", F.array(F.concat(F.lit("user_selected_"), F.lower("_forced")))))))
    clauses = F.filter(F.transform(F.split(q, words.clauses), lambda s: F.regexp_replace(s, words.trimmed, "")), lambda s: F.char_length(s) >= shortest)
    rows = rows.withColumn("_parts", F.when(F.col("path") == "FULL", clauses).otherwise(F.array("rewritten")))
    subject = F.coalesce(F.try_element_at("terms", F.lit(1)), q)
    aspects = F.array_compact(F.array(*[F.when(_has(q, marks), F.concat(subject, F.lit(say))) for marks, say in words.aspects]))
    aspects = F.when(F.size(aspects) > 0, aspects).otherwise(F.array(F.concat(subject, F.lit(words.otherwise))))
    parts = F.slice(F.when((F.col("path") == "FULL") & F.col("wants_action") & (F.size("_parts") == 1), aspects).otherwise(F.col("_parts")), 1, most)
    parts = F.when(F.size(parts) > 0, F.array_distinct(parts)).otherwise(F.array("rewritten"))
    return rows.select(id_col, "query", "rewritten", parts.alias("subqueries"), "path", "reasons", "topics", _has(q, words.current).alias("current_only"), all_rules([(name, _has(q, (mark,))) for mark, name in words.audiences]).alias("audience"), "terms", "wants_action")


def expanded(text: Column, rules: list[tuple[str, str, tuple[str, ...]]]) -> tuple[Column, Column]:
    """(names of the rules whose pattern the text has, the text with what these add to it, each addition once)."""
    names = all_rules([(name, text.rlike(p)) for name, p, _ in rules])
    more = F.array_distinct(F.flatten(F.array(*[F.when(text.rlike(p), F.array(*map(F.lit, add))).otherwise(F.array().cast("array<string>")) for _, p, add in rules])))
    more = F.filter(more, lambda w: ~F.contains(text, w))
    return names, F.when(F.size(more) > 0, F.concat_ws(" ", text, F.array_join(more, " "))).otherwise(text)


def with_context(df: DataFrame, key: str, order: str, text_col: str, turns: int, short: int) -> DataFrame:
    """effective: a short query takes the texts of up to `turns` earlier ones before it."""
    w = W.partitionBy(key).orderBy(order)
    before = [F.lag(text_col, i).over(w) for i in range(turns, 0, -1)]
    needs = before[-1].isNotNull() & (F.char_length(text_col) < short)
    rows = df.withColumn("needs_context", needs).withColumn("_joined", F.concat_ws(" ", *before, F.col(text_col)))
    return rows.withColumn("effective", F.when(F.col("needs_context"), F.col("_joined")).otherwise(F.col(text_col))).drop("_joined")


def route(text: Column, rules: dict[str, tuple[str, int]], least: int, default: str) -> Column:
    """The route whose weighted matches score most, ties to the earlier one; the default below `least`."""
    scores = {name: F.regexp_count(F.lower(text), F.lit(p)) * n for name, (p, n) in rules.items()}
    best = F.greatest(*scores.values())
    out = F.when(best < least, default)
    for name, s in scores.items():
        out = out.when(s == best, name)
    return out


SIMPLE = r"^\s*\d+(?:\.\d+)?\s*[+\-*/]\s*\d+(?:\.\d+)?\s*(?:等于多少|=)?\s*[?？]?\s*$"


def keyword_route(text: Column, ordered: list[tuple[str, str]], shortest: int = 4, default: str = "GENERAL_WEB") -> Column:
    """NO_WEB_NEEDED for plain arithmetic, else the first route whose pattern the text has, UNCERTAIN for a text that says too little, else the default."""
    low = F.trim(F.lower(text))
    return first_rule([("NO_WEB_NEEDED", low.rlike(SIMPLE)), *[(name, low.rlike(p)) for name, p in ordered], ("UNCERTAIN", F.char_length(low) < shortest)], default)


def intent_route(text: Column, subjects: dict[str, tuple[str, ...]], tasks: tuple[str, ...], formula: str, code: str, local: tuple[str, ...], current: tuple[str, ...]) -> Column:
    """(mode, academic, local, current, margin): the intent that scores show to dominate.

    A subject's word counts 2, a task's 2 up to 6, formulas and code 3 each; a local word 3; a word of the present 2. An academic intent needs 3 points, of which 2 by subjects, or a
    formula, code or task; a local one 3 points and no academic task beside it; words of the present win only where neither is there.
    """
    low = F.trim(F.lower(text))
    count = lambda ws: sum((F.contains(low, F.lit(w.lower())).cast("int") for w in ws), F.lit(0))
    domain = sum((count(ws) for ws in subjects.values()), F.lit(0)) * 2
    task, form = count(tasks), F.when(low.rlike(formula), 3).otherwise(0) + F.when(low.rlike(code), 3).otherwise(0)
    academic, here, now = domain + F.least(F.lit(6), task * 2) + form, count(local) * 3, count(current) * 2
    is_academic = (academic >= 3) & ((domain >= 2) | (form > 0) | (task >= 1))
    mode = first_rule([("NO_WEB_NEEDED", low.rlike(SIMPLE)), ("GENERAL_WEB", (now > 0) & (here < 3) & (task == 0) & (form == 0)), ("ACADEMIC_RETRIEVAL", is_academic), ("LOCAL_PUBLIC", (here >= 3) & ~(is_academic & (task > 0)))], "GENERAL_WEB")
    ranks = F.reverse(F.array_sort(F.array(academic, here, F.greatest(F.lit(1), now))))
    return F.struct(mode.alias("mode"), academic.alias("academic"), here.alias("local"), now.alias("current"), (ranks[0] - ranks[1]).alias("margin"))


#: The kinds of files and the tools for them.
FILE_TOOLS = {"docx": "word_file_tool", "xlsx": "excel_file_tool", "pptx": "powerpoint_file_tool", "pdf": "pdf_file_tool"}


def file_route(text: Column, upload: Column, markers: dict[str, tuple[str, ...]], verbs: tuple[str, ...], read: tuple[str, ...], modify: tuple[str, ...], template: tuple[str, ...]) -> Column:
    """(route, action, format, tool) of a request and the name of a file sent with it, if any: file_tool if it has one or says so, else rag_qa.

    The format is what the request names, else the file's, else docx. An upload is read, unless it is to be changed or to serve as a template.
    """
    low, sent = F.trim(F.lower(text)), upload.isNotNull()
    suffix = F.lower(F.regexp_extract(F.coalesce(upload, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    kind = F.coalesce(first_rule([(k, _has(low, ws)) for k, ws in markers.items()], None), F.when(suffix.isin(*markers), suffix), F.lit("docx"))
    wanted = sent | _has(low, verbs)
    action = first_rule([("read", sent & _has(low, read) & ~_has(low, modify)), ("create", sent & _has(low, template)), ("modify", sent | _has(low, modify))], "create")
    tool = first_rule([(t, kind == k) for k, t in FILE_TOOLS.items()], None)
    return F.struct(F.when(wanted, "file_tool").otherwise("rag_qa").alias("route"), F.when(wanted, action).alias("action"), F.when(wanted, kind).alias("format"), F.when(wanted, tool).alias("tool"))


def response_mode(text: Column, unsafe: Column, unclear: Column, local: Column, gate: Column, known: Column, unknown: Column) -> Column:
    """How a question is answered: a refusal, a question back, plain talk, or evidence, whole, in part or with guidance where there is none. known and unknown count points."""
    return first_rule([("SAFETY_REFUSAL", unsafe), ("CLARIFYING_RESPONSE", unclear), ("GENERAL_CONVERSATION", ~local), ("FULL_ANSWER", (gate == "READY") & (known > 0) & (unknown == 0)), ("PARTIAL_ANSWER", known > 0)], "UNCERTAIN_WITH_GUIDANCE")
