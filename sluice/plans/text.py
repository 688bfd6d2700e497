"""Queries of text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from .registry import query, table

#: Fixed parts of the SQL below.
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_COMPACT = r"regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("t1_normalize_document", rf"""
select doc_id, sha256({_STRIP.format(r"regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\t \x{3000}]+', ' ', 'g'), chr(10)), lambda s: trim(s)), lambda s: not regexp_matches(s, '^- (Auth|Discovery):')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")}) as text_sha256
from documents""")
def t1(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.normalize_document(F.col("text")), 256).alias("text_sha256"))


@query("t2_clean_text", r"""
select page_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) as clean_sha256 from pages""")
def t2(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.clean_text(F.col("html")), 256).alias("clean_sha256"))


@query("t3_compact", f"select doc_id, sha256({_COMPACT}) as compact_sha256 from documents")
def t3(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.compact(F.col("text")), 256).alias("compact_sha256"))


@query("t4_norm", r"select doc_id, sha256(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))) as kept, sha256(" + _COMPACT + ") as dropped from documents")
def t4(spark, sf_dir):
    x = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.norm(x), 256).alias("kept"), F.sha2(T.norm(x, "drop"), 256).alias("dropped"))


@query("t5_citation_norm", r"select item_id, sha256(regexp_replace(lower(text), '\s+', '', 'g')) as norm_sha256 from benchmark")
def t5(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(T.citation_norm(F.col("text")), 256).alias("norm_sha256"))


@query("t6_hash_normalisers", r"""
select doc_id, sha256(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) as collapsed, sha256(regexp_replace(text, '\s+', '', 'g')) as dense, sha256(text) as raw from documents""")
def t6(spark, sf_dir):
    x = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", T.hash_collapsed(x).alias("collapsed"), T.hash_dense(x).alias("dense"), F.sha2(x, 256).alias("raw"))


@query("t7_bm25_tokens", "select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+'))::bigint as n_tokens, sha256(array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), ' ')) as tokens_sha256 from documents")
def t7(spark, sf_dir):
    t = T.bm25_tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.sha2(F.array_join(t, " "), 256).alias("tokens_sha256"))


@query("t8_unigrams", "select doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::bigint as n_terms from documents")
def t8(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(F.array_distinct(T.unigrams(F.col("text")))).cast("long").alias("n_terms"))


def _grams(source: str, n: int) -> str:
    return f"list_transform(range(1, length({source}) - {n - 2}), lambda i: substring({source}, i, {n}))"


@query("t9_content_grams", rf"with b as (select item_id, {_COMPACT} as c from benchmark) select item_id, len(list_distinct(list_concat({_grams('c', 2)}, list_concat({_grams('c', 3)}, {_grams('c', 4)}))))::bigint as n_grams from b")
def t9(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(T.content_grams(F.col("text"))).cast("long").alias("n_grams"))


@query("t10_bigram_set", rf"with b as (select item_id, regexp_replace(lower(text), '\s+', '', 'g') as c from benchmark) select item_id, len(list_distinct({_grams('c', 2)}))::bigint as n_bigrams from b")
def t10(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(T.bigram_set(F.col("text"))).cast("long").alias("n_bigrams"))


@query("t11_trigram_set", rf"with b as (select item_id, {_COMPACT} as c from benchmark) select item_id, len(list_distinct({_grams('c', 3)}))::bigint as n_trigrams from b")
def t11(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(T.trigram_set(F.col("text"))).cast("long").alias("n_trigrams"))


@query("t12_word_set", r"select doc_id, len(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: length(w) >= 2)))::bigint as n_words from documents")
def t12(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(T.word_set(F.col("text"))).cast("long").alias("n_words"))


@query("t13_canonical_offsets")
def t13(spark, sf_dir):
    """Canonical text with the source offset of each of its characters, both as digests; inherently sequential, so no SQL."""
    out = C.canonical_with_offsets(table(spark, sf_dir, "pages"), "page_id", "html")
    return out.select("page_id", F.char_length("canonical").alias("n_chars"), F.size("offsets").alias("n_offsets"), F.sha2("canonical", 256).alias("canonical_sha256"), F.sha2(F.array_join("offsets", ","), 256).alias("offsets_sha256"), F.array_join("reasons", ",").alias("reasons"))


@query("t14_visible_line", r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as s from documents)
select doc_id, count(*) as n_lines, sum(length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', '', 'g'), '^\s*(?:[-*+]|\d+[.)]|#{1,6})\s+', ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')))::bigint as visible_chars from l group by 1""")
def t14(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.char_length(T.visible_line(F.col("s")))).alias("visible_chars"))


_SENTENCES = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= {n})"


@query("t15_sentences", "select doc_id, len(" + _SENTENCES.format(n=8) + ")::bigint as n_sentences, sha256(array_to_string(" + _SENTENCES.format(n=8) + ", '|')) as sentences_sha256 from documents")
def t15(spark, sf_dir):
    s = T.sentences(F.col("text"), "latin", 8)
    return _docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.sha2(F.array_join(s, "|"), 256).alias("sentences_sha256"))


@query("t16_chinese_numbers", "select event_id, year(ts)::double as year, month(ts)::double as month, (floor(value) % 10 * 10000 + 100 * (1 + event_id % 9) + 5)::double as amount from events")
def t16(spark, sf_dir):
    """Years in positional numerals, months and amounts with units, written from the events' own numbers and read back; fixtures test more forms."""
    digit = lambda n: F.translate(n.cast("int").cast("string"), "0123456789", "〇一二三四五六七八九")
    n = F.month("ts")
    month = F.concat(F.when(n >= 10, "十").otherwise(""), F.when(n % 10 > 0, digit(n % 10)).otherwise(""))
    wan = F.floor("value") % 10
    amount = F.concat(F.when(wan > 0, F.concat(digit(wan), F.lit("万零"))).otherwise(""), digit(1 + F.col("event_id") % 9), F.lit("百零五"))
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("于"), digit(F.year("ts")), F.lit("年")).alias("y"), F.concat(month, F.lit("月")).alias("m"), F.concat(F.lit("共"), amount, F.lit("元")).alias("a"))
    return rows.select("event_id", C.chinese_number("y").alias("year"), C.chinese_number("m").alias("month"), C.chinese_number("a").alias("amount"))


@query("t17_excerpt", r"select doc_id, sha256(case when length(text) <= 500 then text else left(text, 220) || chr(10) || '...' || chr(10) || right(text, 280) end) as excerpt_sha256 from documents")
def t17(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.excerpt(F.col("text"), 220, 280), 256).alias("excerpt_sha256"))


@query("t18_template_key", r"select sha256(regexp_replace(lower(regexp_replace(regexp_replace(text, '[0-9]+(?:\.[0-9]+)?', '<N>', 'g'), '\s+', ' ', 'g')), '^\s+|\s+$', '', 'g')) as template_sha256, count(*) as n from documents group by 1")
def t18(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.sha2(T.template_key(F.col("text")), 256).alias("template_sha256")).agg(F.count("*").alias("n"))


@query("t19_policy_key", r"""
select doc_id, substring(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?:19|20)\d{2}[-/.年]\d{1,2}(?:[-/.月]\d{1,2}日?)?|(?:19|20)\d{2}年?', '', 'g'), '[(（\[【][^)）\]】]*(?:版|修订|version|rev|v\d)[^)）\]】]*[)）\]】]', '', 'g'), '第?\d+号|["''“”‘’《》]', '', 'g'), '[^\p{L}\p{N}_]+', '', 'g')), 1, 80) as policy_key from documents""")
def t19(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.policy_key(F.col("text")).alias("policy_key"))


@query("c1_boundary_chunks")
def c1(spark, sf_dir):
    return C.boundary_chunks(_docs(spark, sf_dir), "doc_id", "text").withColumn("text", F.sha2("text", 256))


@query("c2_half_break_chunks")
def c2(spark, sf_dir):
    return C.half_break_chunks(_docs(spark, sf_dir), "doc_id", "text").withColumn("text", F.sha2("text", 256))


@query("c3_paragraph_chunks")
def c3(spark, sf_dir):
    return C.paragraph_chunks(_docs(spark, sf_dir), "doc_id", "text").withColumn("text", F.sha2("text", 256))


#: Where sentences of the driver's texts end and may be parted.
_ENDS, _COMMAS = ".!?;", ",:"
_ALL = r"regexp_replace({}, '^[\s\p{{Z}}\x1c-\x1f\x85]+|[\s\p{{Z}}\x1c-\x1f\x85]+$', '', 'g')"
_BEHIND = "regexp_extract_all({x}, '[^{m}]*[{m}]|[^{m}]+$')"
_PACK = f"list_reduce(list_transform(list_transform({_BEHIND.format(x='p', m=_COMMAS)}, lambda t: regexp_replace(t, '^[\\s\\p{{Z}}]+', '')), lambda t: [t]), lambda acc, t: case when length(acc[-1]) + length(t[1]) <= {C.PACKED} then list_concat(acc[:-2], [acc[-1] || t[1]]) else list_concat(acc, t) end)"
_CITED = rf"""d as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?s)```.*?```', ' ', 'g'), '\n+'), lambda x: {_ALL.format('x')}), lambda x: x not in ('', '---')) as ls from documents),
l as (select doc_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as x from d), h as (select *, starts_with(x, '#') or (length(x) <= 30 and starts_with(x, '**') and ends_with(x, '**')) as is_h from l),
c as (select *, coalesce(last_value(case when is_h then regexp_replace(x, '^[#*\s]+|[*\s]+$', '', 'g') end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and current row), '') as heading from h),
q as (select doc_id, i, heading, list_filter(list_transform({_BEHIND.format(x="regexp_replace(x, '^[-*][\\s]+', '')", m=_ENDS)}, lambda p: {_ALL.format('p')}), lambda p: p <> '') as ps from c where not is_h),
u as (select doc_id, i, j, heading, p from q, unnest(range(1, len(ps) + 1)) as r(j), lateral (select ps[j] as p)), v as (select doc_id, i, j, heading, case when length(p) > {C.LONGEST} then {_PACK} else [p] end as ts from u),
units as (select doc_id, row_number() over (partition by doc_id order by i, j, k) - 1 as n, heading, ts[k] as text from v, unnest(range(1, len(ts) + 1)) as r(k))"""


@query("t15_cited_sentences", f"with {_CITED} select doc_id, count(*) as n_sentences, sha256(string_agg(heading || '|' || text, chr(10) order by n)) as sentences_sha256 from units group by 1")
def t15_cited(spark, sf_dir):
    s = C.cited_sentences(F.col("text"), _ENDS, _COMMAS)
    rows = _docs(spark, sf_dir).select("doc_id", s.alias("s")).where(F.size("s") > 0)
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.sha2(F.array_join(F.transform("s", lambda x: F.concat_ws("|", x["heading"], x["text"])), "\n"), 256).alias("sentences_sha256"))


_TEACH = ("est", "the", "und", "de")


@query("t15_training_sentences", rf"""
with x as (select doc_id, regexp_replace(regexp_replace({_ALL.format("coalesce(text, '')")}, '^#+[^\n]*\n+', ''), '[\s\p{{Z}}\x1c-\x1f\x85]+', ' ', 'g') as t from documents),
s as (select doc_id, list_filter(list_transform(regexp_extract_all(t, '[^.!?;]*[.!?;]|[^.!?;]+$'), lambda s: regexp_replace(s, '^[ \-•]+|[ \-•]+$', '', 'g')), lambda s: length(s) between 24 and 180 and len(regexp_extract_all(s, '\d')) <= 10 and regexp_matches(s, 'est|the|und|de') and not regexp_matches(s, '&|password') and len(regexp_extract_all(s, ':')) <= 3) as ss from x)
select doc_id, len(ss)::bigint as n_sentences, sha256(array_to_string(ss, '|')) as sentences_sha256 from s""")
def t15_training(spark, sf_dir):
    """With words of the driver's languages for signals, and their colon."""
    s = C.training_sentences(F.col("text"), _TEACH, ("&", "password"), ".!?;", colon=":")
    return _docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.sha2(F.array_join(s, "|"), 256).alias("sentences_sha256"))


@query("c5_citation_spans", rf"""
with {_CITED}, w as (select a.doc_id, a.n as s, a.n + width - 1 as e, a.heading, (select string_agg(b.text, '' order by b.n) from units b where b.doc_id = a.doc_id and b.n between a.n and a.n + width - 1) as body from units a, unnest(range(1, 4)) as r(width) where exists (select 1 from units b where b.doc_id = a.doc_id and b.n = a.n + width - 1)),
x as (select doc_id, s, e, {_ALL.format("case when heading <> '' and not contains(body, heading) then heading || '：' || body else body end")} as span from w), f as (select * from x where length(span) between 12 and 600 qualify row_number() over (partition by doc_id, regexp_replace(lower(span), '\s+', '', 'g') order by s, e) = 1)
select doc_id, row_number() over (partition by doc_id order by s, e) as span_no, s as sentence_start, e as sentence_end, sha256(span) as span_sha256 from f""")
def c5_cited(spark, sf_dir):
    out = C.cited_spans(_docs(spark, sf_dir), "doc_id", "text", T.citation_norm, 3, 12, 600, _ENDS, _COMMAS)
    return out.select("doc_id", "span_no", "sentence_start", "sentence_end", F.sha2("span", 256).alias("span_sha256"))


@query("c4_stride_chunks", """
select doc_id, (i // 680)::bigint as chunk_index, i as char_start, least(i + 800, length(text))::bigint as char_end, sha256(substring(text, i + 1, 800)) as chunk_sha256
from documents, unnest(range(0, greatest(length(text), 1), 680)) as u(i)""")
def c4(spark, sf_dir):
    out = C.stride_chunks(_docs(spark, sf_dir), "doc_id", "text")
    return out.select("doc_id", "chunk_index", "char_start", "char_end", F.sha2("text", 256).alias("chunk_sha256"))


@query("c5_sentence_spans", "with s as (select doc_id, " + _SENTENCES.format(n=8) + """ as ss from documents), p as (select doc_id, ss, unnest(range(1, len(ss) + 1)) as i from s), w as (select doc_id, i, unnest(range(1, 4)) as width, ss from p)
select doc_id, (i - 1)::bigint as first, width::bigint as width, sha256(array_to_string(ss[i : i + width - 1], ' ')) as span_sha256 from w where i + width - 1 <= len(ss)""")
def c5(spark, sf_dir):
    out = C.sentence_spans(_docs(spark, sf_dir), "doc_id", "text", 3, "latin", 8)
    return out.select("doc_id", "first", "width", F.sha2("span", 256).alias("span_sha256"))


@query("c6_paragraph_spans", r"""
with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 50)[1:3] as ps from documents)
select doc_id, len(ps)::bigint as n_spans, sha256(array_to_string(ps, '|')) as spans_sha256 from p""")
def c6(spark, sf_dir):
    s = C.paragraph_spans(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n_spans"), F.sha2(F.array_join(s, "|"), 256).alias("spans_sha256"))


@query("c7_chunk_audit", """
with c as (select doc_id, (i // 680) as chunk_index, substring(text, i + 1, 800) as t from documents, unnest(range(0, greatest(length(text), 1), 680)) as u(i))
select doc_id, count(*) as n_chunks, max(chunk_index) + 1 = count(*) as contiguous, count(distinct chunk_index) = count(*) as is_unique, count(*) filter (where length(t) < 80) as short_chunks from c group by 1""")
def c7(spark, sf_dir):
    return C.chunk_audit(C.stride_chunks(_docs(spark, sf_dir), "doc_id", "text"), "doc_id")


@query("c7_chunk_contract", """
with c as (select doc_id, (i // 680)::bigint as k, substring(text, i + 1, 800) as t, source, lang from documents, unnest(range(0, greatest(length(text), 1), 680)) as u(i)),
x as (select doc_id, case when doc_id % 31 = 0 and k > 0 then k + 1 else k end as k, t, doc_id || '-' || case when doc_id % 37 = 0 then 0 else k end as id, sha256(case when doc_id % 41 = 0 and k = 0 then t || ' ' else t end) as h, case when doc_id % 43 = 0 then ' ' else source end as s, case when doc_id % 47 = 0 and k = 1 then null else lang end as l from c)
select doc_id, count(*) as n_chunks, min(k) as first, max(k) - min(k) + 1 = count(*) and count(distinct k) = count(*) as contiguous, count(*) filter (where n > 1) as repeated_ids, count(*) filter (where sha256(t) <> h) as wrong_hashes, count(*) filter (where trim(s) = '' or l is null or trim(t) = '') as lacking
from (select *, count(*) over (partition by id) as n from x) group by 1""")
def c7_contract(spark, sf_dir):
    """Strides of all documents with faults planted by number: gaps, ids that come again, other hashes, blank and lacking fields."""
    d, k = F.col("doc_id"), F.col("chunk_index")
    rows = C.stride_chunks(_docs(spark, sf_dir), "doc_id", "text").join(_docs(spark, sf_dir).select("doc_id", "source", "lang"), "doc_id")
    rows = rows.select(
        "doc_id", F.when((d % 31 == 0) & (k > 0), k + 1).otherwise(k).alias("chunk_index"), F.concat_ws("-", d, F.when(d % 37 == 0, F.lit(0).cast("long")).otherwise(k)).alias("chunk_id"), "text", F.sha2(F.when((d % 41 == 0) & (k == 0), F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("h"),
        F.when(d % 43 == 0, " ").otherwise(F.col("source")).alias("source"), F.when(~((d % 47 == 0) & (k == 1)), F.col("lang")).alias("lang"),
    )
    return C.chunk_contract(rows, "doc_id", "chunk_id", "text", "h", ["source", "lang", "text"])
