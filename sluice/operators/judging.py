"""Scoring of outputs, training features, gold labels, constructed cases, and state that is kept between questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .pages import first_rule


def fenced_json(text: Column) -> Column:
    """The JSON object in a text: what a fence holds, else what lies from the first brace to the last; null where that is no object."""
    body = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    body = F.coalesce(F.nullif(body, F.lit("")), F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))
    return F.when(F.try_variant_get(F.try_parse_json(body), "$", "variant").isNotNull(), body)


def same_json(a: Column, b: Column) -> Column:
    """Equal values, whatever the order of keys and the white space; false where either is no JSON."""
    canon = lambda x: F.to_json(F.try_parse_json(x))
    return F.coalesce(canon(a) == canon(b), F.lit(False))


def score_output(raw: Column, kind: Column, gold: Column, bare: Column) -> Column:
    """1 or 0 for an output against its gold, by the kind of the case; null for kinds that this doesn't score.

    json_exact: an equal value, and nothing but an object where `bare` holds; integer_exact, reduced_fraction_exact: the very digits; string_exact: as it stands, without
    white space at the ends; normalized_string_exact: with runs of white space folded. Null outputs score 0.
    """
    text = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", ""))
    fold = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    rules = [
        ("json_exact", same_json(text, gold) & (~bare | (text.startswith("{") & text.endswith("}")))), ("integer_exact", text.rlike(r"^-?\d+$") & (text == gold)), ("reduced_fraction_exact", text.rlike(r"^-?\d+/[1-9]\d*$") & (text == gold)),
        ("normalized_string_exact", fold(text) == fold(gold)), ("string_exact", text == gold),
    ]
    out = F.when(F.lit(False), 0)
    for name, ok in rules:
        out = out.when(kind == name, F.coalesce(ok, F.lit(False)).cast("int"))
    return out


def completion_feature(prompt: Column, completion: Column, longest: int, ignored: int = -100) -> Column:
    """(input_ids, labels, attention_mask, context_truncated, answer_truncated, supervised_tokens) of token arrays, where only the completion is learned from.

    The completion stays, cut at the end if it is too long by itself; the prompt loses its beginning. An empty completion gives null.
    """
    n, m = F.size(prompt), F.size(completion)
    answer = F.slice(completion, 1, longest)
    room = F.greatest(F.lit(0), longest - m)
    kept = F.when(room == 0, F.slice(prompt, 1, 0)).when(n <= room, prompt).otherwise(F.slice(prompt, n - room + 1, room))
    ids = F.concat(kept, answer)
    labels = F.concat(F.transform(kept, lambda _: F.lit(ignored)), answer)
    made = F.struct(ids.alias("input_ids"), labels.alias("labels"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"), ((n + m > longest) & (m <= longest)).alias("context_truncated"), (m > longest).alias("answer_truncated"), F.size(answer).alias("supervised_tokens"))
    return F.when(m > 0, made)


#: Conflicts that leave no part of an answer standing.
BLOCKING = ("entity", "numeric", "temporal", "scope", "negation", "logic", "wrong_attribute", "ood", "multi_object")


def gold_label(required: Column, supported: Column, unsupported: Column, conflicts: Column) -> Column:
    """SUPPORTED, PARTIAL or NOT_SUPPORTED by arrays of points: a blocking conflict or fewer than two points leave nothing; some of either kind make a part."""
    blocked = F.arrays_overlap(conflicts, F.array(*map(F.lit, BLOCKING)))
    return first_rule([("NOT_SUPPORTED", blocked), ("NOT_SUPPORTED", F.size(required) < 2), ("PARTIAL", (F.size(supported) > 0) & (F.size(unsupported) > 0)), ("SUPPORTED", F.size(supported) == F.size(required))], "NOT_SUPPORTED")


def partial_candidate_sound(required: Column, supported: Column, unsupported: Column, conflicts: Column, spans: Column, label: Column) -> Column:
    return (F.size(required) >= 2) & (F.size(supported) > 0) & (F.size(unsupported) > 0) & (F.size(conflicts) == 0) & (F.size(spans) > 0) & (label == "PARTIAL")


KINDS = ("WRONG_DOCUMENT", "TOPIC_RELATED_NOT_ANSWERING", "PARTIAL_COVERAGE", "QUERY_CONCEPT_MISMATCH", "CONTAMINATED_EVIDENCE")


def stress_cases(df: DataFrame, order: str, query: str, evidence: str, ahead: int = 7, head: int = 300, noise: str = "[home](x) [menu](x) [image](x) [more](x)") -> DataFrame:
    """(order, query, kind, evidence, donor): a case of each query, of the five kinds in turn; `evidence` is an array of texts.

    It bears the evidence of the query `ahead` places on (round the end), the heads of its own, its first alone, or noise in its place. Queries are a benchmark's: their
    places are counted in one task, over ids alone, and donors come by a join.
    """
    ids = df.select(order).withColumn("_i", F.row_number().over(W.orderBy(order)) - 1)
    n = F.broadcast(ids.agg(F.count("*").alias("_n")))  # one row
    donor = ids.join(n).select(F.pmod(F.col("_i") - ahead, F.col("_n")).alias("_i"), F.col(order).alias("_donor"))
    their = df.select(F.col(order).alias("_donor"), F.col(evidence).alias("_their"))
    rows = df.select(order, query, evidence).join(ids, order).join(donor, "_i").join(their, "_donor")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("_i") % len(KINDS) + 1).cast("int"))
    own = F.col(evidence)
    made = F.when(kind.isin("WRONG_DOCUMENT", "QUERY_CONCEPT_MISMATCH"), F.col("_their")).when(kind == "TOPIC_RELATED_NOT_ANSWERING", F.transform(own, lambda t: F.substring(t, 1, head))).when(kind == "PARTIAL_COVERAGE", F.slice(own, 1, 1)).otherwise(F.transform(own, lambda _: F.lit(noise)))
    return rows.select(order, query, kind.alias("kind"), made.alias("evidence"), F.when(kind.isin("WRONG_DOCUMENT", "QUERY_CONCEPT_MISMATCH"), F.col("_donor")).alias("donor"))


def upserted(state: DataFrame, changes: DataFrame, keys: list[str], seq: str, counted: str) -> DataFrame:
    """State after changes: the last change of a key by `seq` holds, keys without one stay, new keys come in; `counted` grows by the number of changes."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in state.columns if c not in (*keys, counted)]), F.struct(seq)).alias("_new"), F.count("*").alias("_n"))
    out = state.withColumn("_old", F.lit(True)).join(last, keys, "full")
    value = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
    return out.select(*keys, *[(F.coalesce(counted, F.lit(0)) + F.coalesce("_n", F.lit(0))).alias(counted) if c == counted else value(c) for c in state.columns if c not in keys])


def recovered(state: DataFrame, status: str, retry: bool = False) -> DataFrame:
    """State after a crash: what was being processed waits again, and what failed too, if it is to be tried again."""
    again = F.col(status).isin("processing", "failed") if retry else F.col(status) == "processing"
    return state.withColumn(status, F.when(again, "pending").otherwise(F.col(status)))


def filled_slots(turns: DataFrame, key: str, order: str, text: str, slots: dict[str, tuple[tuple[str, str | None], ...]]) -> DataFrame:
    """turns with a column for each slot: what the turns so far have said of it, the last that said anything. A slot has pairs of a pattern and a value, or None for what its first group takes."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)

    def said(rules) -> Column:
        return F.coalesce(*[F.when(F.col(text).rlike(p), F.lit(v) if v is not None else F.regexp_extract(text, p, 1)) for p, v in rules])

    return turns.withColumns({name: F.last(said(rules), ignorenulls=True).over(w) for name, rules in slots.items()})


def with_pending(turns: DataFrame, key: str, order: str, text: str, asked: str, mark: str, short: int = 80) -> DataFrame:
    """effective: a short turn without a question mark that answers a question of the system (`asked`) takes the question's own intent before it."""
    w = W.partitionBy(key).orderBy(order)
    intent, pending = F.lag(text).over(w), F.coalesce(F.lag(asked).over(w), F.lit(False))
    answer = pending & intent.isNotNull() & (F.char_length(text) <= short) & ~F.col(text).rlike("[?？]")
    return turns.withColumn("effective", F.when(answer, F.concat(intent, F.lit(mark), text)).otherwise(F.col(text)))


def merged_tasks(tasks: DataFrame, key: str, text: str, order: str, most: int = 200, deadline: str = r"((?:20\d{2}年)?\d{1,2}月\d{1,2}日|\d{4}-\d{1,2}-\d{1,2})") -> DataFrame:
    """Each task of a key once, where it came first, the last `most` of them, with the day that its text names."""
    first = tasks.withColumn("_n", F.row_number().over(W.partitionBy(key, text).orderBy(order))).where("_n = 1").drop("_n")
    last = first.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= most).drop("_n")
    return last.withColumn("deadline", F.nullif(F.regexp_extract(text, deadline, 1), F.lit("")))


def support_schema(points: Column, status: Column) -> Column:
    """The JSON schema of an answer that keeps to its support: `points`, an array of (point, units), are what it may and must speak of, in order, each with one of its own units; `status` is what it has to state."""
    text = lambda **more: F.struct(F.lit("string").alias("type"), *[v.alias(k) for k, v in more.items()])
    one = F.lit(1)

    def variant(p: Column) -> Column:
        units = F.struct(F.lit("array").alias("type"), text(enum=p["units"]).alias("items"), one.alias("minItems"), one.alias("maxItems"), F.lit(True).alias("uniqueItems"))
        members = F.struct(text(enum=F.array(p["point"])).alias("required_point_id"), text(minLength=one).alias("claim_text"), units.alias("support_unit_ids"))
        return F.struct(F.lit("object").alias("type"), members.alias("properties"), F.array(*map(F.lit, ("required_point_id", "claim_text", "support_unit_ids"))).alias("required"), F.lit(False).alias("additionalProperties"))

    claims = F.struct(F.lit("array").alias("type"), F.struct(F.transform(points, variant).alias("oneOf")).alias("items"), F.size(points).alias("minItems"), F.size(points).alias("maxItems"))
    members = F.struct(text(enum=F.array(status)).alias("answer_status"), claims.alias("claims"))
    sound = (F.size(points) > 0) & F.forall(points, lambda p: p["point"].isNotNull() & (F.size(p["units"]) > 0) & F.forall(p["units"], lambda u: F.coalesce(u != "", F.lit(False)))) & status.isNotNull()
    return F.when(sound, F.to_json(F.struct(F.lit("object").alias("type"), members.alias("properties"), F.array(F.lit("answer_status"), F.lit("claims")).alias("required"), F.lit(False).alias("additionalProperties"))))


CLAIMS = "struct<answer_status:string,claims:array<struct<required_point_id:string,claim_text:string,support_unit_ids:array<string>>>>"


def schema_fault(answer: Column, points: Column, status: Column) -> Column:
    """The first way in which an answer, as JSON, breaks `support_schema` of the same points and status; null if it keeps to it.

    NOT_AN_OBJECT, UNKNOWN_MEMBER (of the answer or of a claim), ANSWER_STATUS, CLAIM_COUNT, UNKNOWN_POINT, EMPTY_CLAIM, SUPPORT_COUNT (of a claim, other than one), FOREIGN_SUPPORT (a unit of no point or another one's).
    """
    whole = F.try_parse_json(answer)
    keys = lambda j: F.coalesce(F.json_object_keys(j), F.array().cast("array<string>"))
    parts = F.from_json(F.get_json_object(answer, "$.claims"), "array<string>")
    known = F.array(*map(F.lit, ("required_point_id", "claim_text", "support_unit_ids")))
    extra = F.size(F.array_except(keys(answer), F.array(F.lit("answer_status"), F.lit("claims")))) > 0
    a = F.from_json(answer, CLAIMS)
    units = F.map_from_entries(points)
    wrong = lambda f: F.exists(F.coalesce(a["claims"], F.array().cast("array<struct<required_point_id:string,claim_text:string,support_unit_ids:array<string>>>")), f)
    mine = lambda c: F.coalesce(F.try_element_at(units, c["required_point_id"]), F.array().cast("array<string>"))
    return first_rule([
        ("NOT_AN_OBJECT", whole.isNull() | ~F.coalesce(F.startswith(F.trim(answer), F.lit("{")), F.lit(False))), ("UNKNOWN_MEMBER", extra | F.coalesce(F.exists(parts, lambda c: F.size(F.array_except(keys(c), known)) > 0), F.lit(False))), ("ANSWER_STATUS", ~a["answer_status"].eqNullSafe(status)),
        ("CLAIM_COUNT", F.coalesce(F.size(a["claims"]), F.lit(-1)) != F.size(points)), ("UNKNOWN_POINT", wrong(lambda c: ~F.coalesce(F.array_contains(F.map_keys(units), c["required_point_id"]), F.lit(False)))), ("EMPTY_CLAIM", wrong(lambda c: F.coalesce(c["claim_text"], F.lit("")) == "")),
        ("SUPPORT_COUNT", wrong(lambda c: F.coalesce(F.size(c["support_unit_ids"]), F.lit(-1)) != 1)), ("FOREIGN_SUPPORT", wrong(lambda c: F.size(F.array_except(c["support_unit_ids"], mine(c))) > 0)),
    ], None)
