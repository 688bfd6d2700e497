"""Queries of deduplication and contamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import dedup as D
from ..operators import discovery as DI
from ..operators import metadata as M
from ..operators import pages as P
from ..operators.rounds import keep, spread
from .pages import _HOST, _PART
from .registry import query, table

_NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("d1_two_pass", """
with h as (select *, row_number() over (partition by sha256(text) order by doc_id) as n from documents), u as (select *, row_number() over (partition by source || '/' || (doc_id % 40) order by doc_id) as m from h where n = 1)
select doc_id from u where m = 1""")
def d1(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h"), F.concat("source", F.lit("/"), F.col("doc_id") % 40).alias("url"))
    return D.two_pass(rows, "h", "url", ["doc_id"]).select("doc_id")


@query("d1_greedy")
def d1_greedy(spark, sf_dir):
    """Which rows count depends on those kept before; tests compare it with going through the rows."""
    rows = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h"), F.concat("source", F.lit("/"), F.col("doc_id") % 40).alias("url"))
    return D.greedy(rows, ["h", "url"], "doc_id").select("doc_id")


@query("d2_duplicate_pointer", "select doc_id, min(doc_id) over (partition by sha256(text)) as duplicate_of from documents")
def d2(spark, sf_dir):
    return D.duplicate_of(_docs(spark, sf_dir), "doc_id", F.sha2("text", 256)).select("doc_id", "duplicate_of")


@query("d3_canonicalisation", rf"""
with k as (select doc_id, lang, sha256({_NORM.format('text')}) as key, length(text) as n from documents), r as (select *, row_number() over (partition by lang, key order by n desc, doc_id) as rn, count(*) over (partition by lang, key) as members from k)
select lang, key, doc_id as canonical_id, members from r where rn = 1""")
def d3(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "lang", F.sha2(T.norm(F.col("text")), 256).alias("key"), F.char_length("text").alias("n"))
    return D.canonical_rows(rows, "doc_id", ["lang", "key"], F.col("n"))


@query("d4_repeated_values", "select 'lang' as field, lang as value, count(*) as n from documents group by lang having count(*) > 1 union all select 'source', source, count(*) from documents group by source having count(*) > 1 union all select 'n_chars', n_chars::varchar, count(*) from documents group by n_chars having count(*) > 1")
def d4(spark, sf_dir):
    return D.repeated_values(_docs(spark, sf_dir), ["lang", "source", "n_chars"])


@query("d5_cross_corpus", "with core as (select * from documents where doc_id % 4 = 0), cand as (select * from documents where doc_id % 4 <> 0) select doc_id, (sha256(text) in (select sha256(text) from core) or n_chars in (select n_chars from core)) as in_core from cand")
def d5(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h"), "n_chars")
    return D.in_core(rows.where("doc_id % 4 <> 0"), rows.where("doc_id % 4 = 0"), "doc_id", ["h", "n_chars"]).select("doc_id", "in_core")


@query("d6_simhash_blake")
def d6(spark, sf_dir):
    """BLAKE2b is in neither engine; a fixture tests it against a plain reading of its definition."""
    return D.simhash_blake(_docs(spark, sf_dir), "doc_id", "text")


@query("d7_near_pairs")
def d7(spark, sf_dir):
    """SimHash of whole texts within 5 bits, a similarity of 0.92; tests hold it against all pairs."""
    prints = D.simhash_blake(_docs(spark, sf_dir), "doc_id", "text")
    return D.near_pairs(prints.select("doc_id", D.as_long(F.col("simhash")).alias("fp")), "doc_id", "fp", 5)


_SET = r"list_distinct(list_filter(string_split(" + _NORM.format("text") + r", ' '), lambda w: length(w) >= 2))"


_LINES = "(select doc_id, i::bigint as line_no, doc_id * 1000000 + i as k, s as text from (select doc_id, unnest(range(0, len(ss))) as i, unnest(ss) as s from (select doc_id, string_split(text, chr(10)) as ss from documents)))"


@query("d8_lexical_screen", f"""
with b as (select item_id, unnest({_SET}) as t from benchmark), d as (select k, unnest({_SET}) as t from {_LINES}), bn as (select item_id, count(*) as n from b group by 1), dn as (select k, count(*) as n from d group by 1),
p as (select item_id, k, count(*) as c from b join d using (t) group by 1, 2), j as (select k, item_id, round(c / (bn.n + dn.n - c), 6) as jaccard from p join bn using (item_id) join dn using (k)), r as (select *, row_number() over (partition by k order by jaccard desc, item_id) as rn from j where jaccard >= 0.55)
select k // 1000000 as doc_id, k % 1000000 as line_no, item_id as match_id, jaccard from r where rn = 1""")
def d8(spark, sf_dir):
    """Every line of every document against the benchmark's items."""
    tokens = lambda d: d.withColumn("tokens", F.filter(T.word_set(F.col("text")), lambda w: w != ""))
    lines = spread(_docs(spark, sf_dir)).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select((F.col("doc_id") * 1_000_000 + F.col("i")).alias("k"), "text")
    out = D.best_overlap(tokens(lines), "k", tokens(table(spark, sf_dir, "benchmark")), "item_id", 0.55)
    return out.select(F.floor(F.col("k") / 1_000_000).alias("doc_id"), (F.col("k") % 1_000_000).alias("line_no"), "match_id", "jaccard")


@query("d9_staged_cascade", rf"""
with r as (select doc_id, sha256(text) as e, sha256({_NORM.format('text')}) as n from documents), a as (select *, row_number() over (partition by e order by doc_id) as re from r), b as (select *, row_number() over (partition by n order by doc_id) as rn from a where re = 1)
select a.doc_id, case when a.re > 1 then 'EXACT' when b.rn > 1 then 'NORMALISED' when b.n in (select sha256({_NORM.format('text')}) from benchmark) then 'EVALUATION' else 'KEPT' end as stage from a left join b using (doc_id)""")
def d9(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("e"), F.sha2(T.norm(F.col("text")), 256).alias("n"))
    exact = D.duplicate_of(rows, "doc_id", F.col("e")).withColumnRenamed("duplicate_of", "first")
    left = exact.where("doc_id = first")
    normed = D.duplicate_of(left, "doc_id", F.col("n"))
    held = table(spark, sf_dir, "benchmark").select(F.sha2(T.norm(F.col("text")), 256).alias("n"), F.lit(True).alias("held")).distinct()
    stage = F.when(F.col("duplicate_of") != F.col("doc_id"), "NORMALISED").when(F.col("held"), "EVALUATION").otherwise("KEPT")
    return normed.join(held, "n", "left").select("doc_id", stage.alias("stage")).unionByName(exact.where("doc_id <> first").select("doc_id", F.lit("EXACT").alias("stage")))


@query("d10_heldout_contamination")
def d10(spark, sf_dir):
    """Held-out items that stand in the corpus: exactly, normalised, or near, by a matching-blocks ratio of 0.80 or a trigram Jaccard of 0.65; tests hold it against all pairs."""
    return D.contamination(table(spark, sf_dir, "benchmark"), "item_id", _docs(spark, sf_dir), "doc_id", "text", 0.80, 0.65)


@query("d11_membership_overlap", rf"select item_id, text in (select text from documents) as raw, {_NORM.format('text')} in (select {_NORM.format('text')} from documents) as normalised, item_id in (select doc_id from documents) as id from benchmark")
def d11(spark, sf_dir):
    keys = lambda d, i: d.select(F.col(i).alias("id"), F.sha2("text", 256).alias("raw"), F.sha2(T.norm(F.col("text")), 256).alias("normalised"))
    items, docs = keys(table(spark, sf_dir, "benchmark"), "item_id"), keys(_docs(spark, sf_dir), "doc_id")
    out = items.withColumn("item_id", F.col("id"))
    for k in ("raw", "normalised", "id"):
        out = out.join(docs.select(k).distinct().withColumn(f"in_{k}", F.lit(True)), k, "left")
    return out.select("item_id", *[F.coalesce(f"in_{k}", F.lit(False)).alias(k) for k in ("raw", "normalised", "id")])


@query("d12_split_overlap", "with t as (select distinct sha256(text) as h from documents where doc_id % 5 <> 0), v as (select distinct sha256(text) as h from documents where doc_id % 5 = 0) select (select count(*) from t) as train, (select count(*) from v) as validation, (select count(*) from t join v using (h)) as shared")
def d12(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.sha2("text", 256).alias("h"), (F.col("doc_id") % 5 == 0).alias("v")).groupBy("h").agg(F.bool_or(~F.col("v")).alias("t"), F.bool_or("v").alias("v"))
    return rows.agg(F.count_if("t").alias("train"), F.count_if("v").alias("validation"), F.count_if(F.col("t") & F.col("v")).alias("shared"))


@query("d13_key_dedup", r"with p as (select conv_id, min(text) filter (where role = 'user' and turn < 4) as q, max(text) filter (where role = 'assistant') as a from conversations group by 1) select sha256(regexp_replace(lower(coalesce(q, '')), '\s+', '', 'g') || '|' || regexp_replace(lower(coalesce(a, '')), '\s+', '', 'g')) as key, min(conv_id) as conv_id from p group by 1")
def d13(spark, sf_dir):
    role = F.col("role")
    pairs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min(F.when((role == "user") & (F.col("turn") < 4), F.col("text"))).alias("q"), F.max(F.when(role == "assistant", F.col("text"))).alias("a"))
    dense = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")
    return pairs.groupBy(F.sha2(F.concat(dense("q"), F.lit("|"), dense("a")), 256).alias("key")).agg(F.min("conv_id").alias("conv_id"))


@query("d14_title_fuzzy")
def d14(spark, sf_dir):
    """Each title of 8 letters or more with the one most like it, at a matching-blocks ratio of 0.94 or more; equal titles are one. Tests hold it against all pairs."""
    titles = M.sources(_docs(spark, sf_dir)).where(F.char_length("title") >= 8).groupBy("title").agg(F.min("doc_id").alias("doc_id"))
    pairs = D.like_pairs(titles, "doc_id", "title", 0.94)
    best = pairs.groupBy("a").agg(F.max_by(F.struct("b", "ratio"), F.struct("ratio", (-F.col("b")).alias("o"))).alias("m"))
    return best.select(F.col("a").alias("doc_id"), F.col("m.b").alias("match_id"), F.col("m.ratio").alias("ratio"))


@query("d15_exclusion_registry", "select sha256(lower(json_extract_string(props, '$.' || k))) as query_hash, count(*) as n from events, unnest(json_keys(props)) as u(k) group by 1")
def d15(spark, sf_dir):
    values = table(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return values.groupBy(F.sha2(F.lower("v"), 256).alias("query_hash")).agg(F.count("*").alias("n"))


_NEST = """case when event_id % 50 = 0 then '{"query": "cut off' when event_id % 50 = 1 then null when event_id % 50 = 2 then '[1, null, "text"]' else '{"id": ' || event_id || ', "query": ' || case event_id % 3 when 0 then '"Where is Hall ' || user_id || '?"' when 1 then '7' else '"  "' end || ', "user_question": "Who  asks, ' || event_type || '?", "items": [{"question": "What of ' || user_id || '"}, 5, [' || props || ', {"deep": {"candidate_user_question": "Dél ' || event_id % 40 || '!", "record_id": "r' || event_id || '"}}], null]}' end"""


@query("d15_nested_registry", rf"""
with t as (select event_id as id, {_NEST} as j from events), o as (select t.id as id, x.fullkey as path, x.value as v from t, lateral (select * from json_tree(case when json_valid(j) then j end)) as x where x.type = 'OBJECT'),
q as (select id, v, coalesce({", ".join(f"case when json_type(v, '$.{k}') = 'VARCHAR' and trim(json_extract_string(v, '$.{k}')) <> '' then json_extract_string(v, '$.{k}') end" for k in DI.QUESTIONS)}) as raw, coalesce({", ".join(f"nullif(json_extract_string(v, '$.{k}'), '')" for k in DI.NAMES)}, '') as query_id from o)
select id, query_id, sha256(raw) as raw_sha256, regexp_replace(lower(raw), '[^\p{{L}}\p{{N}}]+', '', 'g') as normalized from q where length(raw) <= 2000""")
def d15_nested(spark, sf_dir):
    """Questions at any depth of nested JSON that is made of the events, null and broken texts among it."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_NEST).alias("j"))
    return DI.excluded_questions(DI.json_objects(rows, "event_id", "j")).select("id", "query_id", "raw_sha256", "normalized")


@query("d16_version_supersession", f"""
with m as ({M.META_SQL}), k as (select source_id, effective_date, policy_key, max(effective_date) over (partition by policy_key) as newest, count(effective_date) over (partition by policy_key) as dated from m), n as (select policy_key, max(source_id) as top from k where effective_date = newest group by 1)
select source_id, case when dated >= 2 and (effective_date is null or effective_date < newest) then top end as superseded_by from k left join n using (policy_key)""")
def d16(spark, sf_dir):
    return D.superseded(M.sources(_docs(spark, sf_dir)), "policy_key", "effective_date", "source_id").select("source_id", "superseded_by")


@query("d17_seen_policy", """
with r as (select doc_id, n_chars, doc_id % 3 <> 0 as ok from documents)
select doc_id, coalesce(max(ok::int) over w, 0) > 0 as after_kept, coalesce(max(1) over w, 0) > 0 as after_any from r window w as (partition by n_chars order by doc_id rows between unbounded preceding and 1 preceding)""")
def d17(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "n_chars")
    ok = F.col("doc_id") % 3 != 0
    kept = D.seen_before(rows, "n_chars", "doc_id", ok).withColumnRenamed("duplicate", "after_kept")
    return D.seen_before(kept, "n_chars", "doc_id", ok, "all").select("doc_id", "after_kept", F.col("duplicate").alias("after_any"))


@query("d18_expansion_crawl", f"""
with p as (select page_id, {_HOST} || {_PART.format(3)} as u, sha256(html) as h from pages), hist as (select * from p where page_id % 3 = 0), new as (select *, row_number() over (partition by u order by page_id) as n from p where page_id % 3 <> 0)
select page_id, not (n > 1 or u in (select u from hist) or h in (select h from hist)) as accepted from new""")
def d18(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(U.host(F.col("url")), U.part(F.col("url"), 3)).alias("u"), F.sha2("html", 256).alias("h"))
    new = D.in_core(rows.where("page_id % 3 <> 0"), rows.where("page_id % 3 = 0"), "page_id", ["u", "h"])
    new = D.seen_before(new, "u", "page_id", F.lit(True), "all")
    return new.select("page_id", (~F.col("in_core") & ~F.col("duplicate")).alias("accepted"))


@query("d9_full_cascade")
def d9_full(spark, sf_dir):
    """The whole cascade. Every fourth document is protected, the others are candidates, and the benchmark's items are for evaluation. No SQL: of 60,000 features every pair of texts would have
    to be weighed; tests hold it against a loop over all pairs."""
    docs = _docs(spark, sf_dir)
    return D.cascade(docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0"), table(spark, sf_dir, "benchmark"), "doc_id", "text")


@query("d12_split_audit")
def d12_audit(spark, sf_dir):
    """All four overlaps of two splits, a fifth of the documents against the rest. No SQL, as for d9; tests hold it against a loop over all pairs."""
    docs = _docs(spark, sf_dir)
    return D.split_audit(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0"), "doc_id", "text")


@query("d18_accepted_pages")
def d18_pages(spark, sf_dir):
    """Pages accepted one after the other by URL, hash, title and SimHash of their main content; a third of the pages is history. No SQL (BLAKE2b, and each row depends on those accepted
    before); tests hold it against the loop."""
    pages = table(spark, sf_dir, "pages")
    url = F.concat(U.host(F.col("url")), U.part(F.col("url"), 3)).alias("url")
    rows = P.extract(spread(pages), ["page_id", "url"], "html", "url").select(F.col("page_id").alias("id"), url, "title", F.regexp_replace("plain_text", r"\s+", " ").alias("text"))
    rows = keep(rows)
    return D.accept_pages(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0")).withColumnRenamed("id", "page_id")
