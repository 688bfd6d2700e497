"""Queries of scorers, training features, gold labels, constructed cases and kept state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judging as J
from ..operators import planning as PL
from .registry import query, table

_CASES = "(select doc_id, case doc_id % 5 when 0 then 'json_exact' when 1 then 'integer_exact' when 2 then 'reduced_fraction_exact' when 3 then 'normalized_string_exact' else 'string_exact' end as kind, doc_id % 3 as v, n_chars as n from documents)"


@query("v1_scorers", f"select doc_id, kind, case when v = 2 then 0 when kind in ('json_exact', 'normalized_string_exact') then 1 when v = 1 then case kind when 'string_exact' then 1 else 0 end else 1 end as score from {_CASES}")
def v1(spark, sf_dir):
    """Outputs that are right (v = 0), right but for their form (1), or wrong (2)."""
    d, v, n = F.col("doc_id"), F.col("doc_id") % 3, F.col("n_chars")
    kind = F.element_at(F.array(*map(F.lit, ("json_exact", "integer_exact", "reduced_fraction_exact", "normalized_string_exact", "string_exact"))), (d % 5 + 1).cast("int"))
    wrong = lambda x: F.when(v == 2, F.concat(x, F.lit("9"))).otherwise(x)
    num = wrong(n.cast("string"))
    raw = (
        F.when(kind == "json_exact", F.when(v == 1, F.concat(F.lit('{ "b": [1, 2],  "a": '), num, F.lit("}"))).otherwise(F.concat(F.lit('{"a":'), num, F.lit(',"b":[1,2]}')))).when(kind == "integer_exact", F.when(v == 1, F.concat(F.lit("+"), num)).otherwise(num))
        .when(kind == "reduced_fraction_exact", F.when(v == 1, F.concat(num, F.lit("/07"))).otherwise(F.concat(num, F.lit("/7")))).when(kind == "normalized_string_exact", F.when(v == 1, F.concat(F.lit("  x \n "), num)).otherwise(F.concat(F.lit("x "), num))).otherwise(F.concat(F.lit(" x "), num, F.lit("\n")))
    )
    gold = F.when(kind == "json_exact", F.concat(F.lit('{"a":'), n, F.lit(',"b":[1,2]}'))).when(kind == "integer_exact", n.cast("string")).when(kind == "reduced_fraction_exact", F.concat(n, F.lit("/7"))).otherwise(F.concat(F.lit("x "), n))
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), J.score_output(raw, kind, gold, F.lit(True)).alias("score"))


@query("v2_completion_features", """
with p as (select u.conv_id, u.turn, list_transform(regexp_split_to_array(trim(u.text), '\\s+'), lambda w: length(w)) as p, list_transform(regexp_split_to_array(trim(a.text), '\\s+'), lambda w: length(w) + 100) as c from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'), k as (select *, case when len(c) >= 40 then [] else p[greatest(1, len(p) - (40 - len(c)) + 1):] end as kept, c[1:40] as ans from p)
select conv_id, turn, array_to_string(list_concat(kept, ans), ' ') as input_ids, array_to_string(list_concat(list_transform(kept, lambda x: -100), ans), ' ') as labels, len(p) + len(c) > 40 and len(c) <= 40 as context_truncated, len(c) > 40 as answer_truncated, len(ans)::int as supervised_tokens from k""")
def v2(spark, sf_dir):
    """Word lengths stand for token ids, as the operator takes arrays of them."""
    c = table(spark, sf_dir, "conversations")
    ids = lambda more: F.transform(F.split(F.trim("text"), r"\s+"), lambda w: F.char_length(w) + more)
    u = c.where("role = 'user'").select("conv_id", "turn", ids(0).alias("p"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), ids(100).alias("c"))
    rows = u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", J.completion_feature(F.col("p"), F.col("c"), 40).alias("f"))
    return rows.select("conv_id", "turn", F.array_join("f.input_ids", " ").alias("input_ids"), F.array_join("f.labels", " ").alias("labels"), "f.context_truncated", "f.answer_truncated", "f.supervised_tokens")


@query("v3_gold_policy", "select item_id, case when item_id % 11 = 0 or n < 2 then 'NOT_SUPPORTED' when s > 0 and s < n then 'PARTIAL' when s = n then 'SUPPORTED' else 'NOT_SUPPORTED' end as label, n >= 2 and s > 0 and s < n and item_id % 11 > 0 and item_id % 11 <> 5 as sound from (select item_id, 1 + item_id % 4 as n, least(1 + item_id % 4, item_id % 5) as s from benchmark)")
def v3(spark, sf_dir):
    i = F.col("item_id")
    points = F.transform(F.sequence(F.lit(1), 1 + i % 4), lambda k: F.concat(F.lit("P"), k))
    s = F.least(1 + i % 4, i % 5).cast("int")
    has, lacks = F.slice(points, F.lit(1), s), F.filter(points, lambda p: ~F.array_contains(F.slice(points, F.lit(1), s), p))
    conflicts = F.when(i % 11 == 0, F.array(F.lit("numeric"))).when(i % 11 == 5, F.array(F.lit("style"))).otherwise(F.array().cast("array<string>"))
    label = J.gold_label(points, has, lacks, conflicts)
    return table(spark, sf_dir, "benchmark").select("item_id", label.alias("label"), J.partial_candidate_sound(points, has, lacks, conflicts, points, label).alias("sound"))


@query("v4_stress_cases", "with e as (select item_id, text, regexp_split_to_array(text, '[.]\\s') as ev, row_number() over (order by item_id) - 1 as i, count(*) over () as n from benchmark) select a.item_id, case a.i % 5 when 0 then 'WRONG_DOCUMENT' when 1 then 'TOPIC_RELATED_NOT_ANSWERING' when 2 then 'PARTIAL_COVERAGE' when 3 then 'QUERY_CONCEPT_MISMATCH' else 'CONTAMINATED_EVIDENCE' end as kind, case when a.i % 5 in (0, 3) then d.item_id end as donor, sha256(array_to_string(case a.i % 5 when 0 then d.ev when 1 then list_transform(a.ev, lambda t: left(t, 300)) when 2 then a.ev[1:1] when 3 then d.ev else list_transform(a.ev, lambda t: '[home](x) [menu](x) [image](x) [more](x)') end, '|')) as evidence_sha256 from e a join e d on d.i = (a.i + 7) % a.n")
def v4(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").withColumn("ev", F.split("text", r"[.]\s"))
    return J.stress_cases(items, "item_id", "text", "ev").select("item_id", "kind", "donor", F.sha2(F.array_join("evidence", "|"), 256).alias("evidence_sha256"))


@query("v5_fenced_json", "select event_id, case when event_id % 5 = 4 then null else props end as body, event_id % 5 <> 4 as same from events")
def v5(spark, sf_dir):
    i = F.col("event_id") % 5
    text = F.when(i == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))).when(i == 1, F.concat(F.lit("```\n"), "props", F.lit("```"))).when(i == 2, F.concat(F.lit("answer "), "props", F.lit(" ok"))).when(i == 3, F.col("props")).otherwise(F.lit("no object, but {a brace"))
    body = J.fenced_json(text)
    return table(spark, sf_dir, "events").select("event_id", body.alias("body"), J.same_json(body, F.concat(F.lit(" "), "props")).alias("same"))


@query("v6_upsert", """
with s as (select doc_id as id, 'h' || doc_id % 7 as hash, 'pending' as status, null::varchar as action, 0::bigint as attempts from documents where doc_id % 2 = 0), c as (select doc_id as id, 'h' || doc_id % 7 as hash, k as seq, case when (doc_id + k) % 4 = 0 then 'failed' when (doc_id + k) % 4 = 1 then 'processing' else 'done' end as status, case when (doc_id + k) % 4 > 1 then 'approve' end as action from documents, unnest([1, 2, 3]) as u(k) where doc_id % 3 = 0 and k <= 1 + doc_id % 3 + doc_id % 2),
l as (select id, hash, arg_max(status, seq) as status, arg_max(coalesce(action, ''), seq) as action, count(*) as n from c group by 1, 2)
select coalesce(s.id, l.id) as id, coalesce(s.hash, l.hash) as hash, case coalesce(l.status, s.status) when 'processing' then 'pending' else coalesce(l.status, s.status) end as status, nullif(coalesce(l.action, s.action), '') as action, coalesce(attempts, 0) + coalesce(n, 0) as attempts from s full join l on s.id = l.id and s.hash = l.hash""")
def v6(spark, sf_dir):
    """Reviews by id and hash: changes come in, and after a crash what was being processed waits again."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("h"), F.col("doc_id") % 7).alias("hash"))
    state = d.where("id % 2 = 0").select("id", "hash", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("action"), F.lit(0).cast("long").alias("attempts"))
    changes = d.where("id % 3 = 0").select("id", "hash", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seq")).where("seq <= 1 + id % 3 + id % 2")
    k = (F.col("id") + F.col("seq")) % 4
    changes = changes.select("*", F.when(k == 0, "failed").when(k == 1, "processing").otherwise("done").alias("status"), F.when(k > 1, "approve").alias("action"))
    return J.recovered(J.upserted(state, changes, ["id", "hash"], "seq", "attempts"), "status")


_SLOTS = {"day": ((r"\bat\b", "day"), (r"(?i)\bof (\w+)", None)), "who": (("whou", "group"),)}


@query("v7_session_slots", r"with u as (select conv_id, turn, text, case when regexp_matches(text, '\bat\b') then 'day' when regexp_matches(text, '(?i)\bof ([0-9A-Za-z_]+)') then regexp_extract(text, '(?i)\bof ([0-9A-Za-z_]+)', 1) end as d, case when regexp_matches(text, 'whou') then 'group' end as g, lag(text) over w as before, coalesce(lag(turn % 4 = 0) over w, false) as pending from conversations where role = 'user' window w as (partition by conv_id order by turn)) select conv_id, turn, last_value(d ignore nulls) over w as day, last_value(g ignore nulls) over w as who, sha256(case when pending and before is not null and length(text) <= 80 and not regexp_matches(text, '[?？]') then before || '. More: ' || text else text end) as effective_sha256 from u window w as (partition by conv_id order by turn rows between unbounded preceding and current row)")
def v7(spark, sf_dir):
    """What a conversation has said so far, and short answers with the question that they belong to."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("asked", F.col("turn") % 4 == 0)
    rows = J.with_pending(J.filled_slots(rows, "conv_id", "turn", "text", _SLOTS), "conv_id", "turn", "text", "asked", ". More: ")
    return rows.select("conv_id", "turn", "day", "who", F.sha2("effective", 256).alias("effective_sha256"))


@query("v8_merged_tasks", "with t as (select user_id, event_id, event_type || ' by ' || strftime(ts, '%Y-%m-') || (1 + event_id % 9) as t from events), f as (select user_id, t, min(event_id) as event_id from t group by 1, 2), r as (select *, row_number() over (partition by user_id order by event_id desc) as n from f) select user_id, event_id, t as text, nullif(regexp_extract(t, '([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})', 1), '') as deadline from r where n <= 20")
def v8(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat("event_type", F.lit(" by "), F.date_format("ts", "yyyy-MM-"), 1 + F.col("event_id") % 9).alias("text"))
    return J.merged_tasks(rows, "user_id", "text", "event_id", 20)


@query("v9_response_mode", "select conv_id, turn, case when turn % 9 = 8 then 'SAFETY_REFUSAL' when length(text) < 30 then 'CLARIFYING_RESPONSE' when conv_id % 5 = 0 then 'GENERAL_CONVERSATION' when turn % 3 = 0 and turn % 4 > 0 and conv_id % 2 = 0 then 'FULL_ANSWER' when turn % 4 > 0 then 'PARTIAL_ANSWER' else 'UNCERTAIN_WITH_GUIDANCE' end as mode from conversations")
def v9(spark, sf_dir):
    t, c = F.col("turn"), F.col("conv_id")
    mode = PL.response_mode(F.col("text"), t % 9 == 8, F.char_length("text") < 30, c % 5 != 0, F.when(t % 3 == 0, "READY").otherwise("PARTIAL"), t % 4, c % 2)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", mode.alias("mode"))
