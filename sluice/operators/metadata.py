"""Metadata of sources and rules over it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import AUDIENCES, CONTENT_KINDS, EVERYONE, TITLE_DEPARTMENTS, TOPICS
from ..functions.urls import host
from .pages import DETAIL_URL, first_rule, hrefs, quality, visible

#: What `sources` derives from documents, as SQL.
META_SQL = r"""
select 'S' || doc_id as source_id, doc_id, trim(regexp_replace(regexp_extract(text, '^\s*([^.!?\n]*)', 1), '\s+', ' ', 'g')) as title, text, 'https://' || source || '.example.org/info/' || doc_id as url, source as department,
 date '2024-01-01' + (doc_id % 700)::int as publish_date, case when doc_id % 5 <> 0 then date '2024-02-01' + (doc_id % 600)::int end as effective_date, case when doc_id % 3 = 0 then date '2024-06-01' + (doc_id % 500)::int end as expiry_date,
 case when source in ('src0', 'src1', 'src2') then 'official_internal' when source in ('src3', 'src4', 'src5', 'src6') then 'official' when doc_id % 11 = 0 then 'unverified' else 'authoritative_external' end as authority_level,
 list_filter([case when contains(lower(text), 'license') then 'license' end, case when contains(lower(text), 'token') then 'secrets' end, case when lang <> 'en' then 'foreign' end, case when n_chars > 5000 then 'long' end], lambda t: t is not null) as topics,
 case when regexp_matches(text, '\|') then 'table' when n_chars < 200 then 'note' else 'article' end as content_type, list_filter([case when doc_id % 2 = 0 then 'staff' end, case when doc_id % 3 = 0 then 'student' end], lambda t: t is not null) as audience,
 case when doc_id % 7 = 0 then 'restricted' else 'public' end as access_level, case when doc_id % 13 = 0 then 'review_required' else 'serving' end as admission_status, 'P' || (doc_id % 97) as policy_key from documents"""


def sources(docs: DataFrame) -> DataFrame:
    """Source metadata for the driver's documents, which have none: a title (the first sentence), and dates, standing, topics, kinds and audiences by rule. What rules infer from titles and texts is below."""
    d, low = F.col("doc_id"), F.lower("text")
    day = lambda start, n: F.date_add(F.lit(start).cast("date"), (d % n).cast("int"))
    return docs.select(
        F.concat(F.lit("S"), d).alias("source_id"), "doc_id", F.trim(F.regexp_replace(F.regexp_extract("text", r"^\s*([^.!?\n]*)", 1), r"\s+", " ")).alias("title"), "text", F.concat(F.lit("https://"), "source", F.lit(".example.org/info/"), d).alias("url"), F.col("source").alias("department"),
        day("2024-01-01", 700).alias("publish_date"), F.when(d % 5 != 0, day("2024-02-01", 600)).alias("effective_date"), F.when(d % 3 == 0, day("2024-06-01", 500)).alias("expiry_date"),
        first_rule([("official_internal", F.col("source").isin("src0", "src1", "src2")), ("official", F.col("source").isin("src3", "src4", "src5", "src6")), ("unverified", d % 11 == 0)], "authoritative_external").alias("authority_level"),
        labels([("license", low.contains("license")), ("secrets", low.contains("token")), ("foreign", F.col("lang") != "en"), ("long", F.col("n_chars") > 5000)]).alias("topics"),
        first_rule([("table", F.col("text").rlike(r"\|")), ("note", F.col("n_chars") < 200)], "article").alias("content_type"), labels([("staff", d % 2 == 0), ("student", d % 3 == 0)]).alias("audience"),
        F.when(d % 7 == 0, "restricted").otherwise("public").alias("access_level"), F.when(d % 13 == 0, "review_required").otherwise("serving").alias("admission_status"), F.concat(F.lit("P"), d % 97).alias("policy_key"),
    )


def labels(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))


def dates(text: Column) -> list[Column]:
    """The first date of a text and the one that ends its validity; null where a date is none."""
    day = r"((?:19|20)\d{2}-\d{1,2}-\d{1,2})"
    found = lambda p: F.try_to_date(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), "yyyy-M-d")
    return [found(day).alias("first_date"), found("until " + day).alias("expiry_date")]


def temporal_status(effective: Column, expiry: Column, as_of: str) -> Column:
    """expired, upcoming, unknown (no date at all) or active on the day `as_of`."""
    day = F.lit(as_of).cast("date")
    return F.when(expiry < day, "expired").when(effective > day, "upcoming").when(effective.isNull() & expiry.isNull(), "unknown").otherwise("active")


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """The share of the fields that rows fill; strings and arrays must not be empty."""
    kind = dict(df.dtypes)
    filled = [F.size(f) > 0 if kind[f].startswith("array") else F.col(f) != "" if kind[f] == "string" else F.col(f).isNotNull() for f in fields]
    total = sum((F.coalesce(c, F.lit(False)).cast("int") for c in filled), F.lit(0))
    return df.agg(F.round(F.sum(total) / (F.count("*") * len(fields)), 6).alias("completeness"))


def priority_score(rules: list[tuple[str, str, int]]) -> Column:
    """The weights of the (column, word, weight) rules whose word is in the column."""
    return sum((F.contains(F.lower(c), F.lit(w)).cast("int") * n for c, w, n in rules), F.lit(0)).cast("long")


def source_tier(df: DataFrame, url_col: str, tiers: list[tuple[str, str, float]], default: tuple[str, float]) -> DataFrame:
    h = host(F.col(url_col))
    tier, score = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for suffix, name, value in tiers:
        tier, score = tier.when(h.endswith(suffix), name), score.when(h.endswith(suffix), value)
    return df.withColumns({"tier": tier.otherwise(default[0]), "authority": score.otherwise(default[1])})


def inherit(child: DataFrame, parents: DataFrame, links: list[tuple[str, str]], fields: list[str], defaults: dict[str, str], seeds: DataFrame | None = None, seed_key: str | None = None) -> DataFrame:
    """Fields of a row come from its parent, else they are what the row has itself, else a default.

    links: pairs of (column of the row, column of the parents), tried in order: by id first, then by URL. A row that stands in `seeds`, which name it by
    `seed_key`, takes their fields, nulls too, and nothing from a parent. Parents with equal keys count by their least values.
    """
    out, sources = child, {f: [] for f in fields}
    for i, (own, theirs) in enumerate(links):
        p = parents.where(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias(f"_k{i}")).agg(*[F.min(f).alias(f"_p{i}_{f}") for f in fields])
        out = out.join(p, out[own] == F.col(f"_k{i}"), "left")
        for f in fields:
            sources[f].append(F.col(f"_p{i}_{f}"))
    held = F.lit(False)
    if seeds is not None:
        s = seeds.groupBy(F.col(seed_key).alias("_s")).agg(*[F.min(f).alias(f"_s_{f}") for f in fields])
        out = out.join(s, out[seed_key] == F.col("_s"), "left")
        held = F.col("_s").isNotNull()
    value = lambda f: F.coalesce(*sources[f], F.col(f))
    out = out.withColumns({f: F.coalesce(F.when(held, F.col(f"_s_{f}")).otherwise(value(f)) if seeds is not None else value(f), F.lit(defaults.get(f))) for f in fields})
    return out.select(*child.columns)


def html_metadata(html: Column) -> Column:
    """(title, published, updated, department) of a page: by its meta tags, whatever the order of their attributes; the title else by h1 and title, the date else by a label at the head."""
    attr = lambda m, name: F.regexp_extract(m, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    tags = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), 1), lambda m: F.struct(F.lower(F.coalesce(F.nullif(attr(m, "property"), F.lit("")), attr(m, "name"))).alias("k"), F.trim(attr(m, "content")).alias("v")))
    tags = F.filter(tags, lambda t: t["v"] != "")
    of = lambda *names: F.filter(tags, lambda t: t["k"].isin(*names))
    tidy = lambda x: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " ")), F.lit(""))
    day = r"((?:19|20)\d{2})\s*[年./-]\s*(\d{1,2})\s*[月./-]\s*(\d{1,2})"
    iso = lambda x, p=day: F.when(x.rlike(p), F.format_string("%04d-%02d-%02d", *[F.regexp_extract(x, p, i).cast("int") for i in (1, 2, 3)]))
    last = lambda *names: iso(F.try_element_at(of(*names), F.lit(-1))["v"])
    head = F.substring(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " "), 1, 1500)
    title = F.coalesce(F.try_element_at(of("og:title"), F.lit(1))["v"], F.try_element_at(of("articletitle"), F.lit(1))["v"], tidy(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)), tidy(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)))
    named = [F.try_element_at(F.filter(of(k), lambda t: F.char_length(t["v"]).between(2, 50)), F.lit(1))["v"] for k in ("author", "source", "department")]
    published = F.coalesce(last("article:published_time", "pubdate", "publishdate"), iso(head, r"(?:发布时间|发布日期|发布于|时间)\s*[：:]?\s*" + day))
    return F.struct(F.substring(title, 1, 300).alias("title"), published.alias("published"), last("article:modified_time", "last-modified").alias("updated"), F.coalesce(*named).alias("department"))


def within(host_: Column, domain: str) -> Column:
    return (host_ == domain) | host_.endswith("." + domain)


def department(url: Column, title: Column, hosts: dict[str, str], markers=TITLE_DEPARTMENTS, default: str = "相关部门") -> Column:
    """By the host, the first domain that holds; else by the first marker in the title."""
    return first_rule([*[(name, within(host(url), d)) for d, name in hosts.items()], *[(name, F.contains(title, F.lit(m))) for m, name in markers]], default)


def authority(url: Column, restricted: Column, own: tuple[str, ...], trusted: tuple[str, ...] = ("edu.cn", "gov.cn")) -> Column:
    """official_internal where access is restricted, official on one's own domains, authoritative_external below trusted ones, else unverified."""
    h = host(url)
    any_ = lambda cs: reduce(lambda a, b: a | b, cs, F.lit(False))
    return first_rule([("official_internal", restricted), ("official", any_([within(h, d) for d in own])), ("authoritative_external", any_([h.endswith("." + d) for d in trusted]))], "unverified")


def topics(category: Column, title: Column, text: Column, groups: dict[str, tuple[str, ...]] = TOPICS, of_category: dict[str, str] | None = None, default: str = "学生事务", head: int = 3000) -> Column:
    """What title, category and body say, in this order and each topic once. The body, of which the first `head` characters count by the rule itself, never gives the first topic before the others."""
    says = lambda x: labels([(t, F.lower(x).rlike("|".join(map(re.escape, words)))) for t, words in groups.items()])
    mapped = labels([(t, category == c) for c, t in (of_category or {}).items()])
    found = F.array_distinct(F.concat(says(title), mapped, says(F.substring(text, 1, head))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def content_status(text: Column) -> list[Column]:
    n = F.char_length(text)
    status = first_rule([("EMPTY", n == 0), ("TITLE_ONLY", n < 30), ("PARTIAL", n < 120), ("SHELL", (n < 300) & text.rlike(r"\|"))], "FULL")
    return [status.alias("content_status"), first_rule([("DYNAMIC", text.rlike(r"(?:19|20)\d{2}")), ("STABLE", n >= 120)], "UNKNOWN").alias("temporal_class"), (n < 120).alias("needs_recovery")]


def restricted_gate(html: Column) -> list[Column]:
    n = F.char_length(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))
    links = F.size(hrefs(html))
    kind = first_rule([("thin", n < 180), ("list", (n > 12000) & (links >= 20)), ("list", (links >= 25) & (n < 2500)), ("detail", n > 300)], "other")
    return [links.cast("long").alias("n_links"), kind.alias("class")]


#: Marks of templates, of lists by their titles, of pages of a list, and lines that are a date only.
TEMPLATE_MARKS = ("智能问答", "咨询电话", "服务时间", "(?i)copyright|版权所有", "友情链接", "网站地图", "返回顶部")
LIST_WORDS = r"通知公告|新闻动态|招聘信息|政策文件|规章制度|目录|列表|(?i:archive|index of)"
PAGING = r"首页.*(?:上页|下页|尾页)|第\s*/?\s*\d+\s*页|\[下页\]"
DATE_LINE = r"^(?:\[|\()?(?:19|20)\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2}日?(?:\]|\))?$"


def page_class(markdown: Column, title: Column, url: Column) -> Column:
    """(class, link_text_ratio, date_line_count, template_marker_count): one of seven classes of a page's text, told by its links, dated lines and template marks."""
    q = quality(markdown, title, url, F.lit(False))
    raw = F.filter(F.transform(F.split(markdown, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    lines = F.filter(F.transform(raw, visible), lambda t: t != "")
    linked = F.aggregate(F.regexp_extract_all(markdown, F.lit(r"\[([^\]]+)\]\([^)]*\)"), 1), F.lit(0), lambda a, x: a + F.char_length(x))
    core = F.trim(F.regexp_replace(title, "[-—|_].*$", ""))
    # what follows names the lines, the text and the numbers several times, and they are made once a page
    made = F.transform(F.array(F.struct(q.alias("q"), lines.alias("lines"), linked.alias("linked"))), lambda m: F.struct(m["q"].alias("q"), m["lines"].alias("lines"), m["linked"].alias("linked"), F.array_join(m["lines"], "\n").alias("text")))

    def told(m: Column) -> Column:
        total, text = m["q"]["total_text_length"], m["text"]
        marks = sum((text.rlike(p).cast("int") for p in TEMPLATE_MARKS), F.lit(0))
        links = F.when(total > 0, F.round(m["linked"] / total, 4)).otherwise(F.lit(0.0))
        return F.struct(m["q"].alias("q"), links.alias("links"), F.size(F.filter(m["lines"], lambda t: t.rlike(DATE_LINE))).alias("dates"), marks.alias("marks"), text.rlike(PAGING).alias("paged"))

    specific, detail = (F.char_length(core) >= 12) & ~core.rlike(LIST_WORDS), url.rlike(DETAIL_URL)

    def judged(f: Column) -> Column:
        main, nav, total = f["q"]["main_paragraph_count"], f["q"]["navigation_like_ratio"], f["q"]["total_text_length"]
        listed = core.rlike(LIST_WORDS) | f["paged"] | ((f["q"]["list_item_count"] >= 8) & (f["links"] >= 0.18) & (main <= 2))
        bare = (main == 0) & ((nav >= 0.35) | f["q"]["loading_placeholder"] | (f["links"] >= 0.35))
        kind = first_rule([
            ("list_page", listed & ~(detail & specific & f["q"]["loading_placeholder"])), ("content_missing", bare & (detail | specific)), ("navigation_only", bare), ("template_polluted", (f["marks"] >= 2) & ((nav >= 0.18) | (f["links"] >= 0.22)) & (main >= 1)),
            ("thin_content", (total < 260) & (main <= 2)), ("detail_content", (main >= 2) | (f["q"]["long_paragraph_count"] >= 1) | (total >= 550)),
        ], "mixed_or_uncertain")
        return F.struct(kind.alias("class"), f["links"].alias("link_text_ratio"), f["dates"].alias("date_line_count"), f["marks"].alias("template_marker_count"))

    return F.transform(F.transform(made, told), judged)[0]


def content_kind(title: Column, text: Column, kinds=CONTENT_KINDS, head: int = 3000) -> Column:
    """The first of the kinds whose pattern title or text bear (notice by the title alone), else reference; the first `head` characters of the text count, by the rule itself."""
    joined = F.concat(title, F.lit("\n"), F.substring(text, 1, head))
    return first_rule([(kind, (title if kind == "notice" else joined).rlike(p)) for kind, p in kinds], "reference")


def audiences(title: Column, text: Column, markers=AUDIENCES, everyone: str = EVERYONE, head: int = 1200) -> Column:
    """Whom a text is for, sorted; everyone if it names no one; the first `head` characters of the text count, by the rule itself."""
    joined = F.concat(title, F.lit("\n"), F.substring(text, 1, head))
    found = F.array_sort(F.array_distinct(labels([(label, joined.contains(marker)) for marker, label in markers])))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(everyone)))
