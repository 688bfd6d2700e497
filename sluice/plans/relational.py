"""Queries of joins, set operations, sources and generic relational work."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import discovery as DI
from ..operators import metadata as M
from ..sources import readers as R
from ..sources import sinks as K
from .registry import query, table


def _t(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


@query("s1_json_fields", "select event_id, json_extract_string(props, '$.k') as k from events")
def s1(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("s6_sitemap_urls", "select page_id, url as loc from pages")
def s6(spark, sf_dir):
    xml = F.concat(F.lit("<urlset><url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url></urlset>"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(R.sitemap_urls(xml)).alias("loc"))


def _sites(spark, sf_dir):
    """(url, body) of what five sites would serve, made of `pages`: robots.txt, indexes three deep with loops, foreign hosts and more than twenty children, sitemaps of pages, and broken files."""
    site, section = (F.col("page_id") % 5).cast("string"), (F.floor(F.col("page_id") / 5) % 30).cast("int")
    link = lambda *parts: F.concat(F.lit("https://s"), F.col("site"), F.lit(".example.org/"), *[p if not isinstance(p, str) else F.lit(p) for p in parts])
    locs = lambda tag, entry, urls: F.concat(F.lit(f'<?xml version="1.0"?><{tag} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.transform(urls, lambda u: F.concat(F.lit(f"<{entry}><loc> "), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit(f" </loc></{entry}>"))), ""), F.lit(f"</{tag}>"))
    own = link("p/", F.col("page_id").cast("string"), F.lit("?a=1&b="), (F.col("page_id") % 7).cast("string"))
    pages = table(spark, sf_dir, "pages").select("page_id", site.alias("site"), section.alias("section"))
    pages = pages.select("site", "section", F.struct("page_id", F.when(F.col("page_id") % 11 == 0, "https://elsewhere.net/x").otherwise(own).alias("u")).alias("p")).groupBy("site", "section").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["u"]).alias("us"))
    k = F.col("section").cast("string")
    body = F.when(F.col("section") % 9 == 8, "<urlset><url>").otherwise(locs("urlset", "url", F.col("us")))
    deep = pages.select(link(F.when(F.col("section") % 2 == 0, "l2-").otherwise("l1-"), k, ".xml").alias("url"), body.alias("body"))
    even = pages.where("section % 2 = 0").select(link("l1-", k, ".xml").alias("url"), locs("sitemapindex", "sitemap", F.array(link("l2-", k, ".xml"), link("sitemap.xml"), F.lit("https://foreign.net/s.xml"), link("missing.xml"))).alias("body"))
    sites = pages.select("site").distinct()
    numbers = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: link("l1-", i.cast("string"), ".xml"))
    top = sites.select(link("sitemap.xml").alias("url"), locs("sitemapindex", "sitemap", F.concat(F.array(link("sitemap.xml#again")), numbers)).alias("body"))
    robots = sites.select(link("robots.txt").alias("url"), F.concat(F.lit("User-agent: *\n sitemap: "), link("l1-27.xml"), F.lit("\nSITEMAP:"), link("l1-29.xml"), F.lit("\n")).alias("body"))
    return deep.unionByName(even).unionByName(top).unionByName(robots), sites.select("site", F.regexp_replace(link(""), "/$", "").alias("origin"))


@query("s6_sitemap_tree")
def s6_tree(spark, sf_dir):
    """Sitemaps of sitemaps, over pages dealt to five sites. No SQL: what is seen in one round keeps the next from it; tests compare it with going through a queue."""
    fetched, sites = _sites(spark, sf_dir)
    return DI.sitemap_pages(sites.withColumnRenamed("site", "seed"), fetched, lambda u: F.regexp_replace(u, "#.*$", ""), lambda u: F.regexp_extract(u, r"^https?://([^/]+)", 1).endswith(".example.org"))


@query("s8_source_adapters", "select 'doc' || doc_id as id, 'documents' as dataset, length(text)::bigint as n from documents union all select 'page' || page_id, 'pages', length(html) from pages union all select 'item' || item_id, 'benchmark', length(text) from benchmark")
def s8(spark, sf_dir):
    d, p, b = _t(spark, sf_dir, "documents", "pages", "benchmark")
    one = lambda df, prefix, i, name, text: df.select(F.concat(F.lit(prefix), i).alias("id"), F.lit(name).alias("dataset"), F.char_length(text).cast("long").alias("n"))
    return one(d, "doc", "doc_id", "documents", "text").unionByName(one(p, "page", "page_id", "pages", "html")).unionByName(one(b, "item", "item_id", "benchmark", "text"))


@query("s12_parquet_slice", "select doc_id, lang from documents where doc_id >= 100 and doc_id < 200")
def s12(spark, sf_dir):
    return R.parquet_slice(table(spark, sf_dir, "documents"), "doc_id", 100, 200).select("doc_id", "lang")


@query("s13_conversation_pairs", "with u as (select conv_id, min(turn) as u from conversations where role = 'user' group by 1), a as (select c.conv_id, u, min(turn) as a from conversations c join u using (conv_id) where role = 'assistant' and turn > u group by 1, 2) select conv_id, sha256(p.text) as prompt, sha256(r.text) as response from a join conversations p using (conv_id) join conversations r using (conv_id) where p.turn = u and r.turn = a and length(r.text) <= 12000 and not contains(r.text, '<tool_call>')")
def s13(spark, sf_dir):
    return R.conversations(table(spark, sf_dir, "conversations")).select("conv_id", F.sha2("prompt", 256).alias("prompt"), F.sha2("response", 256).alias("response"))


@query("s14_checkpoint_replay", "with e as (select *, event_type <> 'error' and event_id % 3 <> 0 as ok from events), r as (select *, row_number() over (partition by user_id order by ok desc, event_id desc) as n from e) select user_id, event_id, ok from r where n = 1")
def s14(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_type") != "error") & (F.col("event_id") % 3 != 0)).alias("ok"))
    return R.replay(rows, "user_id", "event_id", "ok")


@query("k1_canonical_json", "select doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}') as row_sha256 from documents")
def k1(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("n_chars", "doc_id", "lang")
    return rows.select("doc_id", F.sha2(K.canonical_json(rows), 256).alias("row_sha256"))


@query("k6_markdown_card", f"select source_id, sha256('# ' || title || chr(10) || chr(10) || '- department: ' || department || chr(10) || '- published: ' || publish_date || chr(10) || chr(10) || text) as card_sha256 from ({M.META_SQL})")
def k6(spark, sf_dir):
    m = M.sources(table(spark, sf_dir, "documents"))
    card = K.markdown_card(F.col("title"), [("department", F.col("department")), ("published", F.col("publish_date"))], F.col("text"))
    return m.select("source_id", F.sha2(card, 256).alias("card_sha256"))


@query("k8_ics_export", "select user_id, count(*) as entries, sha256(concat_ws(chr(13) || chr(10), 'BEGIN:VCALENDAR', 'VERSION:2.0', string_agg(concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || event_id, 'DTSTART;VALUE=DATE:' || strftime(ts, '%Y%m%d'), 'SUMMARY:' || event_type, 'END:VEVENT'), chr(13) || chr(10) order by ts::date, event_id::varchar), 'END:VCALENDAR', '')) as ics_sha256 from events group by 1")
def k8(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = K.ics(e, "user_id", F.col("event_id"), F.col("event_type"), F.to_date("ts"))
    return out.join(e.groupBy("user_id").agg(F.count("*").alias("entries")), "user_id").select("user_id", "entries", F.sha2("ics", 256).alias("ics_sha256"))


@query("k9_faq_rows", f"select source_id, row_number() over (partition by department order by source_id) as faq_no, '[' || department || '] ' || title as question from ({M.META_SQL})")
def k9(spark, sf_dir):
    m = M.sources(table(spark, sf_dir, "documents"))
    return m.select("source_id", F.row_number().over(W.partitionBy("department").orderBy("source_id")).cast("long").alias("faq_no"), F.format_string("[%s] %s", "department", "title").alias("question"))


@query("j1_lookup_left", "select d.doc_id, coalesce(quality, -1) as quality from documents d left join labels l using (doc_id)")
def j1(spark, sf_dir):
    d, l = _t(spark, sf_dir, "documents", "labels")
    return d.join(l, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("j2_four_way_inner", "select o_orderkey, count(*) as lines, sum((l_extendedprice * (1 - l_discount))::decimal(18, 4))::double as revenue from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join lineitem on l_orderkey = o_orderkey where n_regionkey = 2 group by 1")
def j2(spark, sf_dir):
    o, c, n, li = _t(spark, sf_dir, "orders", "customer", "nation", "lineitem")
    rows = n.where("n_regionkey = 2").join(c, F.col("n_nationkey") == F.col("c_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("o_orderkey").agg(F.count("*").alias("lines"), F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double").alias("revenue"))


@query("j3_two_hop_lookup", "select s_suppkey, r_name from supplier left join nation on n_nationkey = s_nationkey left join region on r_regionkey = n_regionkey")
def j3(spark, sf_dir):
    s, n, r = _t(spark, sf_dir, "supplier", "nation", "region")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "r_name")


@query("j4_semi_anti", "select c_custkey, c_custkey in (select o_custkey from orders) as has_orders from customer")
def j4(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    keys = o.select(F.col("o_custkey").alias("c_custkey"))
    return c.join(keys, "c_custkey", "left_semi").select("c_custkey", F.lit(True).alias("has_orders")).unionByName(c.join(keys, "c_custkey", "left_anti").select("c_custkey", F.lit(False).alias("has_orders")))


@query("j5_parent_child", "select c.doc_id, p.doc_id as parent_id from documents c join documents p on p.doc_id = c.doc_id // 10 * 10 where c.doc_id <> p.doc_id")
def j5(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.withColumn("parent_id", F.floor(F.col("doc_id") / 10) * 10).join(d.select(F.col("doc_id").alias("parent_id")), "parent_id").where("doc_id <> parent_id").select("doc_id", "parent_id")


@query("j7_priority_merge", "with u as (select doc_id % 300 as k, doc_id, 1 as layer from documents where doc_id % 2 = 0 union all select doc_id % 300, doc_id, 2 from documents where doc_id % 2 = 1), r as (select *, row_number() over (partition by k order by layer, doc_id) as n from u) select k, doc_id, layer from r where n = 1")
def j7(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 300).alias("k"), "doc_id")
    u = d.where("doc_id % 2 = 0").withColumn("layer", F.lit(1)).unionByName(d.where("doc_id % 2 = 1").withColumn("layer", F.lit(2)))
    return u.groupBy("k").agg(F.min(F.struct("layer", "doc_id")).alias("m")).select("k", "m.doc_id", "m.layer")


@query("x1_set_operations", "with a as (select lang, source from documents where doc_id % 2 = 0), b as (select lang, source from documents where doc_id % 3 = 0) select 'both' as part, count(*) as n from (select * from a intersect select * from b) union all select 'left', count(*) from (select * from a except select * from b) union all select 'right', count(*) from (select * from b except select * from a)")
def x1(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a, b = d.where("doc_id % 2 = 0").select("lang", "source"), d.where("doc_id % 3 = 0").select("lang", "source")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return one(a.intersect(b), "both").unionByName(one(a.subtract(b), "left")).unionByName(one(b.subtract(a), "right"))


@query("x3_ordered_distinct", "select doc_id, sha256(array_to_string(list_transform(list_sort(list_transform(list_distinct(ts), lambda t: {'i': list_position(ts, t), 't': t})), lambda s: s.t), ' ')) as words_sha256 from (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as ts from documents)")
def x3(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)), " "), 256).alias("words_sha256"))


@query("q1_pricing_summary", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def q1(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("q2_top_customers_per_nation", "with r as (select c_nationkey, c_custkey, round(sum(o_totalprice), 2) as total from customer join orders on o_custkey = c_custkey group by 1, 2), k as (select *, row_number() over (partition by c_nationkey order by total desc, c_custkey) as place from r) select c_nationkey, c_custkey, total, place from k where place <= 3")
def q2(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    sums = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total")).join(c, "c_custkey")
    place = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("total"), "c_custkey"))
    return sums.withColumn("place", place.cast("long")).where("place <= 3").select("c_nationkey", "c_custkey", "total", "place")


@query("j6_theta_screen", "select c_custkey, count(*) as cheaper_orders from customer join orders on o_custkey = c_custkey and o_totalprice < c_acctbal * 10 group by 1")
def j6(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") < F.col("c_acctbal") * 10)).groupBy("c_custkey").agg(F.count("*").alias("cheaper_orders"))


_WORDS = r"list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: length(w) >= 2))"


@query("j6_similarity_join", f"with d as (select doc_id as id, {_WORDS} as s from documents), b as (select item_id as id, {_WORDS} as s from benchmark), i as (select d.id as doc_id, b.id as item_id, len(list_intersect(d.s, b.s)) as c, len(d.s) as n, len(b.s) as m from d, b where len(d.s) > 0 and len(b.s) > 0) select doc_id, item_id, round(c / (n + m - c), 6) as jaccard from i where round(c / (n + m - c), 6) >= 0.2")
def j6_similarity(spark, sf_dir):
    """All pairs of documents and items whose word sets have a Jaccard similarity of 0.2, found by rare words."""
    from ..functions import text as T
    from ..operators import dedup as D

    d, b = _t(spark, sf_dir, "documents", "benchmark")
    sets = lambda df, i: df.select(i, F.filter(T.word_set(F.col("text")), lambda w: w != "").alias("tokens"))
    return D.overlap_pairs(sets(d, "doc_id"), "doc_id", sets(b, "item_id"), "item_id", 0.2).select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), "jaccard")


@query("j8_term_join", r"with t as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) as term from documents), q as (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) as term from benchmark) select item_id, count(distinct doc_id) as docs, count(*) as postings from q join t using (term) group by 1")
def j8(spark, sf_dir):
    from ..functions import text as T

    d, b = _t(spark, sf_dir, "documents", "benchmark")
    terms = lambda df, i: df.select(i, F.explode(F.array_distinct(T.word_tokens(F.col("text")))).alias("term"))
    hits = terms(b, "item_id").join(terms(d, "doc_id"), "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("n"))
    return hits.groupBy("item_id").agg(F.count("*").alias("docs"), F.sum("n").alias("postings"))


@query("x2_symmetric_difference", "with a as (select distinct n_chars as n from documents where doc_id % 2 = 0), b as (select distinct n_chars as n from documents where doc_id % 2 = 1) select n, case when b.n is null then 'left' else 'right' end as side from a full join b using (n) where a.n is null or b.n is null".replace("select n, case", "select coalesce(a.n, b.n) as n, case").replace("full join b using (n)", "full join b on a.n = b.n"))
def x2(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.col("n_chars").alias("n")).agg(F.bool_or(F.col("doc_id") % 2 == 0).alias("l"), F.bool_or(F.col("doc_id") % 2 == 1).alias("r"))
    return d.where(F.col("l") != F.col("r")).select("n", F.when(F.col("l"), "left").otherwise("right").alias("side"))


@query("q3_cube_and_grouping", "select l_returnflag, l_linestatus, grouping(l_returnflag)::int as g, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def q3(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("int").alias("g"), F.count("*").alias("n"))


@query("q4_pivot", "select source, count(*) filter (where lang = 'en') as en, count(*) filter (where lang = 'de') as de, count(*) filter (where lang = 'fr') as fr, count(*) filter (where lang = 'es') as es from documents group by 1")
def q4(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).count().na.fill(0)
