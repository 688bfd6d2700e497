"""Queries of URL, page and metadata operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import pages as P
from ..operators import metadata as M
from ..operators.rounds import spread
from .registry import query, table

#: Parts of a URL in SQL, as the functions take them apart.
_RE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_PART = "regexp_extract(url, '" + _RE + "', {})"
_HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(" + _PART.format(2) + r"), '^[^@]*@', ''), ':(?:80|443)$', ''), '\.$', '')"
_TRACK = "^(?:utm_[^=]*|spm|from|source|share|fbclid|gclid|utm_source|utm_medium|utm_campaign|utm_term|utm_content)(?:=|$)"


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@query("u1_normalize_url_strict", f"""
with q as (select page_id, url, list_sort(list_filter(string_split({_PART.format(4)}, '&'), lambda p: p <> '' and not regexp_matches(p, '{_TRACK}'))) as ps from pages)
select page_id, case when lower({_PART.format(1)}) in ('http', 'https') and {_HOST} <> '' then lower({_PART.format(1)}) || '://' || {_HOST} || regexp_replace({_PART.format(3)}, '/+$', '') || case when len(ps) > 0 then '?' || array_to_string(ps, '&') else '' end end as normalized from q""")
def u1(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.normalize_strict(F.col("url")).alias("normalized"))


@query("u2_normalize_url_loose", f"""
with q as (select page_id, url, list_filter(string_split({_PART.format(4)}, '&'), lambda p: p <> '' and not regexp_matches(p, '^(?:utm_|from|scene)')) as ps from pages)
select page_id, lower({_PART.format(1)}) || '://' || lower({_PART.format(2)}) || regexp_replace({_PART.format(3)}, '/{{2,}}', '/', 'g') || case when len(ps) > 0 then '?' || array_to_string(ps, '&') else '' end as normalized from q""")
def u2(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.normalize_loose(F.col("url")).alias("normalized"))


@query("u3_canonical_url", f"""
select page_id, lower({_PART.format(1)}) || '://' || lower({_PART.format(2)}) || regexp_replace({_PART.format(3)}, '/{{2,}}', '/', 'g') || case when {_PART.format(4)} <> '' then '?' || {_PART.format(4)} else '' end as canonical from pages""")
def u3(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.canonical(F.col("url")).alias("canonical"))


@query("u4_host_allow_list", f"select page_id, ({_HOST} = 'example.org' or ends_with({_HOST}, '.example.org') or {_HOST} = 'example.com' or ends_with({_HOST}, '.example.com')) as allowed from pages")
def u4(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.allowed(F.col("url"), ["example.org", "example.com"]).alias("allowed"))


@query("u5_extension_class", rf"""
select page_id, case when lower(regexp_extract({_PART.format(3)}, '\.([A-Za-z0-9]+)$', 1)) in ('pdf','doc','docx','xls','xlsx','ppt','pptx','zip','rar','csv') then 'attachment'
 when lower(regexp_extract({_PART.format(3)}, '\.([A-Za-z0-9]+)$', 1)) in ('jpg','jpeg','png','gif','svg','ico','css','js','mp4','mp3','woff','woff2') then 'skip' else 'page' end as kind from pages""")
def u5(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.extension_class(F.col("url")).alias("kind"))


@query("u6_main_content")
def u6(spark, sf_dir):
    """Walks broken markup, which SQL can't; tested against hand-made pages."""
    out = P.extract(spread(_pages(spark, sf_dir)), ["page_id"], "html", "url")
    return out.select("page_id", "title", "method", "selector", F.col("quality.class").alias("class"), F.sha2("markdown", 256).alias("markdown_sha256"), F.char_length("plain_text").alias("n_chars"), F.size("links").alias("n_links"), F.size("images").alias("n_images"), F.size("attachments").alias("n_attachments"))


_VISIBLE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), '<[^>]+>', '', 'g'), '^[\\s#>*:+\\-|\\d.()（）]+', '', 'g'), '\\s+', ' ', 'g'))".replace("\\\\", "\\")
_NAVS = "list_contains([" + ", ".join(f"'{w}'" for w in P.NAV_WORDS) + "], t)"


@query("u7_content_quality_gate", rf"""
with d as (select doc_id, title, url, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')) as r from (select doc_id, title, case when doc_id % 3 = 0 then 'https://h/info/' || doc_id || '.html' else url end as url, text from ({M.META_SQL}))),
l as (select *, length(t) as n, {_NAVS} or (length(t) <= 12 and (regexp_matches(r, '^(?:- \[|:   \[|\[)') or contains(r, ']('))) or (length(t) <= 8 and not regexp_matches(t, '{P.ENDED}|\d{{4}}|电话|邮箱|时间|地点')) or regexp_matches(t, '{P.LIST_MARKERS}') as nav from (select *, {_VISIBLE.format('r')} as t from d) where t <> ''),
f as (select doc_id, sum(n)::int as total, count(*)::int as lines, count(*) filter (where n <= 12) as short, count(*) filter (where nav) as navs, (count(*) filter (where n >= 40 and regexp_matches(t, '{P.ENDED}') and not nav))::int as main, (count(*) filter (where n >= 100 and not nav))::int as long, (count(*) filter (where regexp_matches(r, '^(?:- |\* |\+ |:   )')))::int as items, bool_or(regexp_matches(t, '{P.LOADING}')) as loading, bool_or(regexp_matches(t, '{P.LIST_MARKERS}')) as listed, lower(string_agg(t, ' ')) as plain from l group by 1),
m as (select doc_id, case when doc_id % 3 = 0 then 'https://h/info/' || doc_id || '.html' else url end as url, title, list_distinct(regexp_extract_all(lower(title), '[\x{{4e00}}-\x{{9fff}}]{{2,}}|[a-z]{{3,}}')) as terms from ({M.META_SQL})),
x as (select m.doc_id, coalesce(total, 0) as total, coalesce(lines, 0) as lines, round(coalesce(short / lines, 0), 6)::double as short, round(coalesce(navs / lines, 0), 6)::double as nav, coalesce(main, 0) as main, coalesce(long, 0) as long, coalesce(items, 0) as items, round(case when len(terms) > 0 then len(list_filter(terms, lambda w: contains(coalesce(plain, ''), w))) / len(terms) else 1 end, 6)::double as match, coalesce(loading, false) as loading, coalesce(listed, false) as marks, regexp_matches(url, '{P.DETAIL_URL}') as detail, regexp_matches(title, '{P.LIST_TITLE}') as lt from m left join f using (doc_id)),
c as (select *, case when (marks or lt or (items >= 8 and main <= 1)) and not (detail and not lt) then 'list_page' when loading and main = 0 then 'extraction_failed' when nav >= 0.72 and main = 0 then 'navigation_only' when total < 120 and main = 0 then 'extraction_failed' when detail and main = 0 and long = 0 and match < 0.35 then 'extraction_failed' when nav >= 0.45 and main >= 1 then 'template_polluted' when total < 280 and (main >= 1 or long >= 1) then 'thin_content' when main >= 1 or long >= 1 then 'detail_content' else 'extraction_failed' end as class from x)
select doc_id, class, class in ('template_polluted', 'thin_content', 'detail_content') as passed, total as total_text_length, lines as line_count, short as short_line_ratio, nav as navigation_like_ratio, main as main_paragraph_count, long as long_paragraph_count, items as list_item_count, match as title_match_ratio, loading as loading_placeholder from c""")
def u7(spark, sf_dir):
    """The gate over documents as markdown; `u6` runs it over all that may be a page's main content."""
    url = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://h/info/"), "doc_id", F.lit(".html"))).otherwise(F.col("url"))
    rows = M.sources(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", P.quality(F.col("text"), F.col("title"), url, F.lit(False)).alias("q")).select("doc_id", "q.*")


def _resolved(x: str) -> str:
    for name, by in P.REFERENCES:
        x = f"replace({x}, '{name}', '{by.replace(chr(39), chr(39) * 2)}')"
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_TEXT = f"array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(html, ''), '{P.UNSEEN}', '<>', 'g'), '<[^>]*>'), lambda x: {_resolved('x')}), lambda x: x <> ''), ' ')"


@query("u8_page_state", rf"""
with t as (select page_id, coalesce(url, '') as u, {_resolved("coalesce(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '')")} as title, {_TEXT} as text from pages),
x as (select *, concat_ws(' ', title, left(text, 3000), u) as sample from t)
select page_id, case when regexp_matches(sample, '(?i){P.AUTH}') and (contains(lower(u), 'login') or length(replace(text, ' ', '')) < 2500) then 'login_required'
 when regexp_matches(left(sample, 1000), '(?i){P.GONE}') then 'soft_404' when regexp_matches(left(sample, 1500), '(?i){P.PERSONAL}') then 'private_or_sensitive' end as state from x""")
def u8(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", P.page_state(F.col("url"), F.col("html")).alias("state"))


@query("u9_page_classes")
def u9(spark, sf_dir):
    """Classes of the main content of pages; its text comes from broken markup, so fixtures test every class."""
    out = P.extract(spread(_pages(spark, sf_dir)), ["page_id", "url"], "html", "url")
    return out.select("page_id", M.page_class(F.col("markdown"), F.col("title"), F.col("url")).alias("c")).select("page_id", "c.*")


_HREFS = r"""regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1)"""
_PLAIN = r"""length(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"""


@query("u10_restricted_quality_gate", f"""
select page_id, len({_HREFS})::bigint as n_links, case when {_PLAIN} < 180 then 'thin' when {_PLAIN} > 12000 and len({_HREFS}) >= 20 then 'list' when len({_HREFS}) >= 25 and {_PLAIN} < 2500 then 'list' when {_PLAIN} > 300 then 'detail' else 'other' end as class from pages""")
def u10(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", *M.restricted_gate(F.col("html")))


@query("u11_link_discovery", f"""
with l as (select page_id, url as page, unnest({_HREFS}) as link from pages),
s as (select link, page_id, (case when regexp_matches(link, '/(?:info|detail|article|content)/|\\.html?$') then 6 else 0 end + case when regexp_matches(link, '/\\d+') then 4 else 0 end + case when length(link) >= 6 then 2 else 0 end + case when regexp_matches(link, '(?i)guide|policy|rule|notice|办法|指南') then 2 else 0 end - case when regexp_matches(link, '(?i)/news/') then 2 else 0 end)::bigint as score from l)
select link, max(score) as score, min(page_id) as first_page, count(*) as seen from s where score >= 2 group by 1""")
def u11(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("page_id", F.explode(P.hrefs(F.col("html"))).alias("link"))
    rows = rows.withColumn("score", P.link_score(F.col("link"), F.col("link")).cast("long")).where("score >= 2")
    return rows.groupBy("link").agg(F.max("score").alias("score"), F.min("page_id").alias("first_page"), F.count("*").alias("seen"))


@query("u12_follow_priority", rf"""
with l as (select page_id, unnest({_HREFS}) as link from pages), k as (select page_id, link, lower(regexp_extract(regexp_extract(link, '{_RE}', 3), '\.([A-Za-z0-9]+)$', 1)) as e, page_id % 6 as depth from l),
p as (select case when e in ('jpg','jpeg','png','gif','svg','ico','css','js','mp4','mp3','woff','woff2') then null when e in ('pdf','doc','docx','xls','xlsx','ppt','pptx','zip','rar','csv') then 1 when regexp_matches(link, '/(?:guide|policy|rules)/') then 2 when regexp_matches(link, '/(?:info|detail|article)/') then 3 when regexp_matches(link, '/\d+') then 4 when depth <= 1 then 5 when depth <= 3 then 6 else 7 end as priority from k)
select priority, count(*) as n from p group by 1""")
def u12(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("page_id", F.explode(P.hrefs(F.col("html"))).alias("link"))
    return rows.groupBy(P.follow_priority(F.col("link"), F.col("page_id") % 6).alias("priority")).agg(F.count("*").alias("n"))


_TIDY = r"nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '{}', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '')"


@query("u13_html_metadata", "select page_id, left(coalesce(" + ", ".join(_TIDY.format(p) for p in ("(?is)<h1[^>]*>(.*?)</h1>", "(?is)<title[^>]*>(.*?)</title>")) + "), 300) as title, case when page_id % 3 = 0 then strftime(date '2024-01-05' + (page_id % 500)::int, '%Y-%m-%d') end as published, case when page_id % 4 = 0 then '2025-02-03' end as updated, case when page_id % 5 > 0 then 'Dept ' || page_id % 7 end as department from pages")
def u13(spark, sf_dir):
    """The driver's pages have no dates or departments, so tags are put before them; fixtures test more forms."""
    i = F.col("page_id")
    tag = lambda c, *x: F.when(c, F.concat(*x)).otherwise("")
    day = F.date_format(F.date_add(F.lit("2024-01-05").cast("date"), (i % 500).cast("int")), "yyyy/M/d")
    head = F.concat(tag(i % 3 == 0, F.lit('<META content="'), day, F.lit(' 10:00" name="PubDate">')), tag(i % 4 == 0, F.lit("<meta property='article:modified_time' content='2025-02-03T01:00'>")), tag(i % 5 > 0, F.lit('<meta name="author" content="x"><meta name="Source" content=" Dept '), i % 7, F.lit(' ">')))
    return _pages(spark, sf_dir).select("page_id", M.html_metadata(F.concat(head, "html")).alias("m")).select("page_id", "m.title", "m.published", "m.updated", "m.department")


_COUNT = "len(regexp_extract_all(lower(text), '{}'))"


@query("u14_keyword_category", f"""
with c as (select doc_id, {_COUNT.format('the')} + {_COUNT.format('and')} as en, {_COUNT.format('und')} + {_COUNT.format('ich')} as de, {_COUNT.format('que')} + {_COUNT.format('les')} as fr, {_COUNT.format('los')} + {_COUNT.format('ción')} as es from documents)
select doc_id, case when greatest(en, de, fr, es) = 0 then 'other' when en = greatest(en, de, fr, es) then 'en' when de = greatest(en, de, fr, es) then 'de' when fr = greatest(en, de, fr, es) then 'fr' else 'es' end as category from c""")
def u14(spark, sf_dir):
    words = {"en": ["the", "and"], "de": ["und", "ich"], "fr": ["que", "les"], "es": ["los", "ción"]}
    return table(spark, sf_dir, "documents").select("doc_id", P.best_label(F.col("text"), words, "other").alias("category"))


_HOSTS = {"blog.example.org": "Blog", "example.org": "Registry", "example.net": "Network"}
_MARKS = (("the", "Library"), ("und", "Bibliothek"))
_TITLE = r"coalesce(" + ", ".join(_TIDY.format(p) for p in ("(?is)<h1[^>]*>(.*?)</h1>", "(?is)<title[^>]*>(.*?)</title>")) + ", '')"


@query("u15_authority_level", f"select page_id, case when page_id % 9 = 0 then 'official_internal' when {_HOST} = 'example.org' or ends_with({_HOST}, '.example.org') then 'official' when ends_with({_HOST}, '.net') then 'authoritative_external' else 'unverified' end as authority_level, case " + " ".join(f"when {_HOST} = '{d}' or ends_with({_HOST}, '.{d}') then '{n}'" for d, n in _HOSTS.items()) + " " + " ".join(f"when contains({_TITLE}, '{m}') then '{n}'" for m, n in _MARKS) + " else 'other' end as department from pages")
def u15(spark, sf_dir):
    title = F.coalesce(M.html_metadata(F.col("html"))["title"], F.lit(""))
    return _pages(spark, sf_dir).select("page_id", M.authority(F.col("url"), F.col("page_id") % 9 == 0, ("example.org",), ("net",)).alias("authority_level"), M.department(F.col("url"), title, _HOSTS, _MARKS, "other").alias("department"))


_GROUPS = {"umlauts": ("ü", "ß"), "spanish": ("ción", "ñ"), "licence": ("license", "licence"), "secret": ("token", "password"), "english": ("the ",)}
_OF_SOURCE = {"src0": "licence", "src1": "english"}
_SAYS = lambda x, t: "regexp_matches(lower({}), '{}')".format(x, "|".join(_GROUPS[t]))


@query("u16_topics", "select source_id, array_to_string(list_filter([" + ", ".join(f"case when {_SAYS('title', t)} then '{t}' end" for t in _GROUPS) + ", " + ", ".join(f"case when department = '{s}' and not {_SAYS('title', t)} then '{t}' end" for s, t in _OF_SOURCE.items()) + ", " + ", ".join(f"case when {_SAYS('left(text, 3000)', t)} and not {_SAYS('title', t)}" + "".join(f" and department <> '{s}'" for s, o in _OF_SOURCE.items() if o == t) + f" then '{t}' end" for t in _GROUPS) + ", case when not (" + " or ".join(f"{_SAYS('title', t)} or {_SAYS('left(text, 3000)', t)}" for t in _GROUPS) + " or department in ('src0', 'src1')) then 'other' end], lambda x: x is not null), ',') as topics from (" + M.META_SQL + ")")
def u16(spark, sf_dir):
    """Topics that title, category (here the source) and body say, by markers of the driver's languages."""
    m = M.sources(table(spark, sf_dir, "documents"))
    return m.select("source_id", F.array_join(M.topics(F.col("department"), F.col("title"), F.col("text"), _GROUPS, _OF_SOURCE, "other"), ",").alias("topics"))


_KINDS = (("policy", "(?i)license|rights"), ("procedure_guide", "(?i)token|step"), ("notice", "(?i)und|que"), ("faq", r"\?"))
_FOR = (("the ", "readers"), ("ü", "Leser"), ("ción", "lectores"), ("eau", "lecteurs"), ("and ", "readers"))


@query("u17_content_type_audience", "select source_id, case " + " ".join(f"when regexp_matches({'title' if k == 'notice' else 'title || chr(10) || left(text, 3000)'}, '{p}') then '{k}'" for k, p in _KINDS) + " else 'reference' end as content_type, case when len(a) > 0 then array_to_string(a, ',') else 'all' end as audience from (select *, list_sort(list_distinct(list_filter([" + ", ".join(f"case when contains(title || chr(10) || left(text, 1200), '{m}') then '{n}' end" for m, n in _FOR) + "], lambda x: x is not null))) as a from (" + M.META_SQL + "))")
def u17(spark, sf_dir):
    m = M.sources(table(spark, sf_dir, "documents"))
    return m.select("source_id", M.content_kind(F.col("title"), F.col("text"), _KINDS).alias("content_type"), F.array_join(M.audiences(F.col("title"), F.col("text"), _FOR, "all"), ",").alias("audience"))


@query("u18_date_extraction", r"""
with t as (select event_id, 'issued ' || strftime(ts, '%Y-%m-%d') || ' valid until ' || strftime(ts, '%Y') || '-13-01' as text from events)
select event_id, try_cast(regexp_extract(text, '((?:19|20)\d{2}-\d{1,2}-\d{1,2})', 1) as date) as first_date, try_cast(nullif(regexp_extract(text, 'until ((?:19|20)\d{2}-\d{1,2}-\d{1,2})', 1), '') as date) as expiry_date from t""")
def u18(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("issued "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" valid until "), F.date_format("ts", "yyyy"), F.lit("-13-01")).alias("text"))
    return rows.select("event_id", *M.dates(F.col("text")))


@query("u19_dated_facts")
def u19(spark, sf_dir):
    """Overlapping windows about each date; sequential, so fixtures test it."""
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Held on "), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(", apply before "), F.date_format("ts", "MM-dd")).alias("text"))
    return P.dated_facts(rows, "event_id", "text")


@query("u20_temporal_status", "select source_id, case when expiry_date < date '2025-06-01' then 'expired' when effective_date > date '2025-06-01' then 'upcoming' when expiry_date is null and effective_date is null then 'unknown' else 'active' end as temporal_status from (" + M.META_SQL + ")")
def u20(spark, sf_dir):
    return M.sources(table(spark, sf_dir, "documents")).select("source_id", M.temporal_status(F.col("effective_date"), F.col("expiry_date"), "2025-06-01").alias("temporal_status"))


@query("u21_metadata_completeness", "select round(sum((title <> '')::int + (publish_date is not null)::int + (effective_date is not null)::int + (expiry_date is not null)::int + (len(topics) > 0)::int + (len(audience) > 0)::int) / (count(*) * 6.0), 6) as completeness from (" + M.META_SQL + ")")
def u21(spark, sf_dir):
    return M.completeness(M.sources(table(spark, sf_dir, "documents")), ["title", "publish_date", "effective_date", "expiry_date", "topics", "audience"])


@query("u22_priority_score", "select page_id, (5 * contains(lower(url), 'article')::int + 3 * contains(lower(url), 'page')::int - 4 * contains(lower(url), 'tag')::int + 2 * contains(lower(html), '<article')::int)::bigint as priority from pages")
def u22(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", M.priority_score([("url", "article", 5), ("url", "page", 3), ("url", "tag", -4), ("html", "<article", 2)]).alias("priority"))


@query("u23_source_tier", f"select page_id, case when ends_with({_HOST}, '.edu') then 'A' when ends_with({_HOST}, '.org') then 'B' else 'C' end as tier, case when ends_with({_HOST}, '.edu') then 0.95 when ends_with({_HOST}, '.org') then 0.8 else 0.5 end::double as authority from pages")
def u23(spark, sf_dir):
    return M.source_tier(_pages(spark, sf_dir), "url", [(".edu", "A", 0.95), (".org", "B", 0.8)], ("C", 0.5)).select("page_id", "tier", "authority")


@query("u24_parent_inheritance", """
with child as (select doc_id, 'u' || doc_id as url, case when doc_id % 2 = 0 then doc_id // 10 * 10 end as parent_id, 'u' || (doc_id // 20 * 20) as parent_url, case when doc_id % 3 = 0 then 'own' end as department from documents where doc_id % 10 <> 0), parents as (select doc_id as pid, 'u' || doc_id as purl, source as department from documents where doc_id % 10 = 0 and doc_id % 70 <> 0)
select c.doc_id, case when c.doc_id % 50 = 7 then case when c.doc_id % 100 = 7 then 'seeded' else 'unknown' end else coalesce(a.department, b.department, c.department, 'unknown') end as department from child c left join parents a on a.pid = c.parent_id left join parents b on b.purl = c.parent_url""")
def u24(spark, sf_dir):
    """By the parent's id, else its URL; explicit seeds take the place of both."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    url = lambda x: F.concat(F.lit("u"), x)
    child = docs.where(i % 10 != 0).select("doc_id", url(i).alias("url"), F.when(i % 2 == 0, F.floor(i / 10) * 10).alias("parent_id"), url(F.floor(i / 20) * 20).alias("parent_url"), F.when(i % 3 == 0, "own").alias("department"))
    parents = docs.where((i % 10 == 0) & (i % 70 != 0)).select(i.alias("pid"), url(i).alias("purl"), F.col("source").alias("department"))
    seeds = docs.where(i % 50 == 7).select(url(i).alias("url"), F.when(i % 100 == 7, "seeded").alias("department"))
    return M.inherit(child, parents, [("parent_id", "pid"), ("parent_url", "purl")], ["department"], {"department": "unknown"}, seeds, "url").select("doc_id", "department")


@query("u25_record_subtype", r"select conv_id, turn, case when regexp_matches(lower(text), '```|def |select ') then 'code' when regexp_matches(text, '\d+\s*[-+*/=]\s*\d+') then 'math' when regexp_matches(lower(text), '\?\s*$') then 'question' when length(text) > 400 then 'long_form' else 'chat' end as subtype from conversations")
def u25(spark, sf_dir):
    x = F.col("text")
    rules = [("code", F.lower(x).rlike("```|def |select ")), ("math", x.rlike(r"\d+\s*[-+*/=]\s*\d+")), ("question", F.lower(x).rlike(r"\?\s*$")), ("long_form", F.char_length(x) > 400)]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.first_rule(rules, "chat").alias("subtype"))


@query("u26_content_status", r"""
select doc_id, case when length(text) = 0 then 'EMPTY' when length(text) < 30 then 'TITLE_ONLY' when length(text) < 120 then 'PARTIAL' when length(text) < 300 and regexp_matches(text, '\|') then 'SHELL' else 'FULL' end as content_status,
 case when regexp_matches(text, '(?:19|20)\d{2}') then 'DYNAMIC' when length(text) >= 120 then 'STABLE' else 'UNKNOWN' end as temporal_class, length(text) < 120 as needs_recovery from documents""")
def u26(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *M.content_status(F.col("text")))
