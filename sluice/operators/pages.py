"""Pages: main content, links, metadata and quality."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

#: Elements and classes that never hold main content, and containers that do, in the order in which they are tried.
NOISE = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "template", "iframe"}
NOISE_CLASSES = {
    "nav", "navbar", "footer", "header", "sidebar", "breadcrumb", "share", "search", "qrcode", "ewm", "print", "relatenews", "related", "recommend", "xgyd", "page", "pages", "pagination", "prev-next", "tools", "source", "views", "ad", "ads",
}
SELECTORS = ("article", "main article", "main .content", "[role=main]", ".article-content", ".news_content", ".v_news_content", "#vsb_content", ".detail-content", ".detail", "#content", "main")
#: Lines that lead elsewhere, marks of lists, of pages that still load, and of detail pages.
NAV_WORDS = ("首页", "学校概况", "教育教学", "科学研究", "招生就业", "人才招聘", "合作交流", "校园生活", "借阅", "资源", "空间", "学习支持", "科研支持", "概况", "联系我们", "网站地图", "通知公告", "上一页", "下一页", "上页", "下页", "尾页", "打印", "关闭", "分享", "友情链接")
LIST_MARKERS = r"(?i)(?:首页|上页|下页|尾页).*第\s*/?\s*\d+\s*页|共\s*\d+\s*条"
LIST_TITLE = r"(?i)(?:通知公告|新闻动态|动态新闻|招聘信息|政策文件|法律法规|规章制度|服务通知|站点地图|热门排序|默认排序|目录|列表)(?:[-—|_].*)?$"
LOADING = r"(?i)读取内容中|请等待|(?:正在|数据)?加载中|\bloading\b"
DETAIL_URL = r"(?i)/(?:info|article|news|content|detail)/[^?#]*\d+[^/?#]*\.(?:htm|html)$"
ENDED = r"[。！？；：.!?;]"
BLOCKS = {"p", "div", "li", "ul", "ol", "br", "tr", "table", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}


Element = tuple[str, set[str], str, str]  # tag, classes, id, role


def _is(simple: str, e: Element) -> bool:
    """Whether an element is what a simple selector names: a tag, .class, #id or [role=x]."""
    tag, classes, name, role = e
    if simple[0] == ".":
        return simple[1:] in classes
    if simple[0] == "#":
        return simple[1:] == name
    return role == simple[6:-1] if simple.startswith("[role=") else tag == simple


def _fits(chain: list[str], e: Element, above: list[Element]) -> bool:
    """Whether an element is what the last selector of a chain names, and the others hold, in order, for elements above it."""
    if not _is(chain[-1], e):
        return False
    rest = iter(above)
    return all(any(_is(simple, a) for a in rest) for simple in chain[:-1])


class _Extract(HTMLParser):
    """Walks a page once; text outside of noise goes to the body and to every wanted container that is open, the first of its kind."""

    def __init__(self, selectors: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.wanted = {s: s.split() for s in selectors}
        self.stack: list[tuple[Element, bool, list[str]]] = []
        self.noise, self.headings, self.open = 0, 0, []
        self.held: dict[str, list[str]] = {}
        self.body: list[str] = []
        self.title, self.in_title, self.h1 = [], False, []
        self.links, self.images, self.anchor = [], [], None
        self.meta: dict[str, str] = {}

    def _write(self, s: str) -> None:
        if self.noise:
            return
        self.body.append(s)
        for text in self.open:
            text.append(s)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes = set(a.get("class", "").split())
        if tag == "meta" and (a.get("property") or a.get("name")):
            self.meta[a.get("property") or a["name"]] = a.get("content", "")
        if tag not in VOID:
            e, above = (tag, classes, a.get("id", ""), a.get("role", "")), [x for x, _, _ in self.stack]
            opened = [s for s, chain in self.wanted.items() if _fits(chain, e, above)]
            for s in opened:
                del self.wanted[s]
                self.held[s] = []
                self.open.append(self.held[s])
            noisy = tag in NOISE or not classes.isdisjoint(NOISE_CLASSES)
            self.noise += noisy
            self.headings += tag == "h1"
            self.stack.append((e, noisy, opened))
        self.in_title |= tag == "title"
        if tag in BLOCKS:
            self._write("\n" + ("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "- " if tag == "li" else ""))
        if tag == "a" and a.get("href"):
            self.anchor = (a["href"], [])
        if tag == "img" and a.get("src") and not self.noise:
            self.images.append((a.get("alt", ""), a["src"]))

    def handle_endtag(self, tag):
        if tag == "a" and self.anchor:
            self.links.append((self.anchor[0], " ".join("".join(self.anchor[1]).split())))
            self.anchor = None
        self.in_title &= tag != "title"
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0][0] == tag), None)
        if at is not None:
            if tag in BLOCKS:
                self._write("\n")
            for e, noisy, opened in self.stack[at:]:
                self.noise -= noisy
                self.headings -= e[0] == "h1"
                if opened:
                    closed = {id(self.held[s]) for s in opened}
                    self.open = [x for x in self.open if id(x) not in closed]
            del self.stack[at:]

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
            return
        if self.anchor and not self.noise:
            self.anchor[1].append(data)
        if self.headings:
            self.h1.append(data)
        self._write(re.sub(r"\s+", " ", data))


def _lines(parts: list[str]) -> str:
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x and x != "-")


def _dense(markdown: str, least: int = 25) -> str:
    """The stretch of lines with most text: lines of `least` characters or more, and headings and items; short lines of other kinds part stretches."""
    runs: list[list[str]] = [[]]
    for line in markdown.split("\n"):
        if len(line) >= least or re.match("#+ |- ", line):
            runs[-1].append(line)
        elif runs[-1]:
            runs.append([])
    return "\n".join(max(runs, key=lambda r: sum(map(len, r)))) or markdown


def parse(html: str | None, site: tuple[str, ...] = ()) -> dict:
    """What a page holds: its title, links, images and attachments, and all that may be its main content, as (method, selector, markdown): containers of `site`, of any site, the densest stretch."""
    p = _Extract((*site, *SELECTORS))
    p.feed(html or "")
    p.close()
    found = [("site_selector", s, _lines(p.held[s])) for s in site if s in p.held] + [("generic_selector", s, _lines(p.held[s])) for s in SELECTORS if s in p.held and s not in site]
    found = [c for c in found if len(c[2]) >= 30] + [("readability", "", _dense(_lines(p.body)))]
    title = p.meta.get("og:title") or " ".join("".join(p.h1).split()) or " ".join("".join(p.title).split())
    files = [(t, u, k) for u, t in p.links if (k := (re.search(r"\.([a-z]{3,4})(?:[?#]|$)", u.lower()) or [None, ""])[1]) in U.ATTACHMENTS]
    return {"title": title, "candidates": found, "links": [{"url": u, "text": t} for u, t in p.links], "images": [{"alt": a, "url": u} for a, u in p.images], "attachments": [{"name": n, "url": u, "kind": k} for n, u, k in files]}


RANKS = {"detail_content": 5, "thin_content": 4, "template_polluted": 3, "list_page": 2, "navigation_only": 1, "extraction_failed": 0}
NUMBERS = ("total_text_length", "line_count", "short_line_ratio", "navigation_like_ratio", "main_paragraph_count", "long_paragraph_count", "list_item_count", "title_match_ratio", "loading_placeholder")
#: Marks at the start of a line, links and images, as both judges of quality take them off.
MARKS = ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"<[^>]+>", ""), (r"^[\s#>*:+\-|\d.()（）]+", ""), (r"\s+", " "))
LINKED, ITEM, FACTUAL, TERM = r"^(?:- \[|:   \[|\[)", r"^(?:- |\* |\+ |:   )", r"\d{4}|电话|邮箱|时间|地点", r"[\u4e00-\u9fff]{2,}|[a-z]{3,}"
_PATTERNS = {k: re.compile(v) for k, v in {"linked": LINKED, "item": ITEM, "ended": ENDED, "plain": ENDED + "|" + FACTUAL, "list": LIST_MARKERS, "list_title": LIST_TITLE, "loading": LOADING, "detail": DETAIL_URL, "term": TERM}.items()}
_MARKS = [(re.compile(p), by) for p, by in MARKS]


def judge(markdown: str, title: str | None, url: str | None, selected: bool) -> dict:
    """What `quality` says, for text that Python holds already."""
    p, total, n, short, nav, main, long, items, seen, words = _PATTERNS, 0, 0, 0, 0, 0, 0, 0, [], set(NAV_WORDS)
    for raw in filter(None, (x.strip() for x in markdown.split("\n"))):
        text = raw
        for pattern, by in _MARKS:
            text = pattern.sub(by, text)
        text = text.strip()
        if not text:
            continue
        size, link = len(text), len(text) <= 12 and ("](" in raw or p["linked"].search(raw))
        leads = bool(text in words or link or (size <= 8 and not p["plain"].search(text)) or p["list"].search(text))
        seen.append(text)
        total, n, short, nav, items = total + size, n + 1, short + (size <= 12), nav + leads, items + bool(p["item"].search(raw))
        if not leads:
            main, long = main + (size >= 40 and bool(p["ended"].search(text))), long + (size >= 100)
    plain, title = " ".join(seen), title or ""
    low, terms = plain.lower(), set(p["term"].findall(title.lower()))
    share = lambda k: round(k / n, 6) if n else 0.0
    f = dict(zip(NUMBERS, (total, n, share(short), share(nav), main, long, items, round(sum(t in low for t in terms) / len(terms), 6) if terms else 1.0, bool(p["loading"].search(plain)))))
    marks = {"list_marks": bool(p["list"].search(plain)), "detail": np.bool_(p["detail"].search(url or "") is not None), "list_title": np.bool_(p["list_title"].search(title) is not None), "selected": selected}
    name = next((k for k, holds in class_rules(f | marks) if holds), "extraction_failed")
    return {"class": name, "passed": name in PASSED, **f}


QUALITY = "struct<class:string,passed:boolean,total_text_length:int,line_count:int,short_line_ratio:double,navigation_like_ratio:double,main_paragraph_count:int,long_paragraph_count:int,list_item_count:int,title_match_ratio:double,loading_placeholder:boolean>"


def extract(df: DataFrame, id_cols: list[str], html_col: str, url_col: str | None = None, sites: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Title, links, images and attachments of each page, and its main content: method, selector, markdown, plain_text and quality.

    sites: for a host, selectors (tags, .classes, #ids, chains of these) of its main content, which are tried before those of any site. Of all candidates that one is taken whose quality has the
    best class, then most main paragraphs, least navigation, most text; the first, if they tie. All of it happens within a row, so pages that share an id stay apart and nothing is
    shuffled. Broken markup and null pages give what can be read.
    """
    kinds = f"struct<title:string,links:array<struct<url:string,text:string>>,images:array<struct<alt:string,url:string>>,attachments:array<struct<name:string,url:string,kind:string>>,method:string,selector:string,markdown:string,plain_text:string,quality:{QUALITY}>"
    sites, mark = sites or {}, re.compile("(?m)^(?:#+|-) ")

    def one(html: str | None, url: str | None, host: str | None) -> dict:
        page = parse(html, sites.get(host or "", ()))
        judged = [(judge(text, page["title"], url, bool(selector)), method, selector, text) for method, selector, text in page.pop("candidates")]
        q, method, selector, text = max(judged, key=lambda c: (RANKS[c[0]["class"]], c[0]["main_paragraph_count"], -c[0]["navigation_like_ratio"], c[0]["total_text_length"]))
        return page | {"method": method, "selector": selector, "markdown": text, "plain_text": mark.sub("", text), "quality": q}

    @F.pandas_udf(kinds)
    def run(html: pd.Series, url: pd.Series, host: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*x) for x in zip(html, url, host)], columns=["title", "links", "images", "attachments", "method", "selector", "markdown", "plain_text", "quality"])

    url = F.col(url_col) if url_col else F.lit("")
    return df.select(*id_cols, run(F.col(html_col), url, U.host(url) if sites else F.lit("")).alias("p")).select(*id_cols, "p.*")


def visible(line: Column) -> Column:
    """A line of markdown as a reader sees it, without the marks at its start."""
    for pattern, by in MARKS:
        line = F.regexp_replace(line, pattern, by.replace("\\", "$"))
    return F.trim(line)


def quality(markdown: Column, title: Column, url: Column, selected: Column) -> Column:
    """(class, passed, and the numbers it goes by) of a page's main content: the first rule that holds decides. `selected`: the content is of a container that was asked for."""
    raw = F.filter(F.transform(F.split(markdown, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    pairs = F.filter(F.transform(raw, lambda r: F.struct(r.alias("r"), visible(r).alias("t"))), lambda p: p["t"] != "")

    def leads_on(p: Column) -> Column:
        r, t, n = p["r"], p["t"], F.char_length(p["t"])
        link = r.rlike(LINKED) | F.contains(r, F.lit("]("))
        return t.isin(*NAV_WORDS) | ((n <= 12) & link) | ((n <= 8) & ~t.rlike(ENDED + "|" + FACTUAL)) | t.rlike(LIST_MARKERS)

    lines = F.transform(pairs, lambda p: F.struct(p["r"].alias("r"), p["t"].alias("t"), leads_on(p).alias("nav"), F.char_length(p["t"]).alias("n")))
    made = F.transform(F.array(lines), lambda ls: F.struct(ls.alias("ls"), F.array_join(F.transform(ls, lambda x: x["t"]), " ").alias("plain")))  # once a page
    terms = F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(r"([\x{4e00}-\x{9fff}]{2,}|[a-z]{3,})"), 1))

    def told(m: Column) -> Column:
        ls, plain = m["ls"], m["plain"]
        count = lambda f: F.size(F.filter(ls, f))
        total, n = F.aggregate(ls, F.lit(0), lambda a, x: a + x["n"]), F.size(ls)
        share = lambda k: F.when(n > 0, k / n).otherwise(F.lit(0.0))
        main, long = count(lambda x: (x["n"] >= 40) & x["t"].rlike(ENDED) & ~x["nav"]), count(lambda x: (x["n"] >= 100) & ~x["nav"])
        items = count(lambda x: x["r"].rlike(ITEM))
        match = F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda w: F.contains(F.lower(plain), w))) / F.size(terms)).otherwise(F.lit(1.0))
        return F.struct(
            total.alias("total_text_length"), n.alias("line_count"), F.round(share(count(lambda x: x["n"] <= 12)), 6).alias("short_line_ratio"), F.round(share(count(lambda x: x["nav"])), 6).alias("navigation_like_ratio"), main.alias("main_paragraph_count"), long.alias("long_paragraph_count"),
            items.alias("list_item_count"), F.round(match, 6).alias("title_match_ratio"), plain.rlike(LOADING).alias("loading_placeholder"), plain.rlike(LIST_MARKERS).alias("list_marks"),
        )

    marks = {"detail": url.rlike(DETAIL_URL), "list_title": title.rlike(LIST_TITLE), "selected": selected}

    def out(f: Column) -> Column:
        name = first_rule(class_rules({k: f[k] for k in (*NUMBERS, "list_marks")} | marks), "extraction_failed")
        return F.struct(name.alias("class"), name.isin(*PASSED).alias("passed"), *[f[x].alias(x) for x in NUMBERS])

    return F.transform(F.transform(made, told), out)[0]  # so that the numbers are made once


PASSED = ("template_polluted", "thin_content", "detail_content")


def class_rules(f: dict) -> list[tuple]:
    """The classes of main content with what each asks for, of columns or of plain numbers; the first that holds decides."""
    main, long, nav, total, match = (f[k] for k in ("main_paragraph_count", "long_paragraph_count", "navigation_like_ratio", "total_text_length", "title_match_ratio"))
    bare, detail = main == 0, f["detail"]
    listed = f["list_marks"] | f["list_title"] | ((f["list_item_count"] >= 8) & (main <= 1))
    return [
        ("list_page", listed & ~(detail & ~f["list_title"])), ("extraction_failed", f["loading_placeholder"] & bare), ("navigation_only", (nav >= 0.72) & bare), ("extraction_failed", (total < 120) & bare),
        ("extraction_failed", detail & bare & (long == 0) & (match < 0.35)), ("template_polluted", (nav >= 0.45) & (main >= 1)), ("thin_content", (total < 280) & ((main >= 1) | (long >= 1))),
        ("detail_content", (main >= 1) | (long >= 1) | (f["selected"] & (total >= 220) & (match >= 0.25))),
    ]


#: What pages say that ask for a login, that are gone, or that are private.
AUTH = r"统一身份认证|账号密码|验证码|access denied|\bCAS\b|\bSSO\b|oauth|请登录|用户登录"
GONE = r"页面不存在|内容已删除|您访问的页面不存在|404\s*(?:not found)?"
PERSONAL = r"个人成绩|个人课表|个人借阅记录|个人财务|身份证号码|个人档案|私人申请状态|个人住宿信息|个人医疗记录|账号凭证"
#: Character references that visible text resolves; others stay as they are.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
UNSEEN = r"(?is)<(?:script|style|template)\b.*?</(?:script|style|template)\s*>|<!--.*?-->"


def visible_text(html: Column) -> Column:
    """The text between tags, pieces trimmed and joined by a space, without scripts, styles and comments; null counts as empty."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "<>")
    pieces = F.transform(F.split(x, "<[^>]*>"), lambda s: F.regexp_replace(_resolved(s), r"^\s+|\s+$", ""))
    return F.array_join(F.filter(pieces, lambda s: s != ""), " ")


def _resolved(x: Column) -> Column:
    for name, by in REFERENCES:
        x = F.replace(x, F.lit(name), F.lit(by))
    return x


def page_state(url: Column, html: Column) -> Column:
    """login_required, soft_404 or private_or_sensitive, by a page's title, the first 3,000 characters of its visible text and its URL, as the rule itself asks; null if it is none of these.

    A page that asks for a login has a URL that says so, or fewer than 2,500 visible characters; the others are known by the first 1,000 and 1,500 of the sample. Patterns count in either case.
    """
    has = lambda x, pattern: x.rlike("(?i)" + pattern)
    title = F.coalesce(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))
    seen = F.struct(F.regexp_replace(_resolved(title), r"^\s+|\s+$", "").alias("title"), visible_text(html).alias("text"), F.coalesce(url, F.lit("")).alias("url"))

    def judged(x: Column) -> Column:
        sample = F.concat_ws(" ", x["title"], F.substring(x["text"], 1, 3000), x["url"])
        asked = F.contains(F.lower(x["url"]), F.lit("login")) | (F.char_length(F.replace(x["text"], F.lit(" "), F.lit(""))) < 2500)
        return F.when(has(sample, AUTH) & asked, "login_required").when(has(F.substring(sample, 1, 1000), GONE), "soft_404").when(has(F.substring(sample, 1, 1500), PERSONAL), "private_or_sensitive")

    return F.transform(F.array(seen), judged)[0]


HREF = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(HREF), 1)


def link_score(url: Column, text: Column) -> Column:
    """Points for what looks like a page with substance: detail paths, numbers, a title's length, value words; news costs."""
    s = lambda c, n: F.when(c, n).otherwise(0)
    return s(url.rlike(r"/(?:info|detail|article|content)/|\.html?$"), 6) + s(url.rlike(r"/\d+"), 4) + s(F.char_length(text) >= 6, 2) + s(text.rlike(r"(?i)guide|policy|rule|notice|办法|指南"), 2) - s(url.rlike(r"(?i)/news/"), 2)


def follow_priority(url: Column, depth: Column) -> Column:
    """1 (first) to 7; null if the link isn't followed."""
    kind = U.extension_class(url)
    return F.when(kind == "skip", None).when(kind == "attachment", 1).when(url.rlike(r"/(?:guide|policy|rules)/"), 2).when(url.rlike(r"/(?:info|detail|article)/"), 3).when(url.rlike(r"/\d+"), 4).when(depth <= 1, 5).when(depth <= 3, 6).otherwise(7)


def html_title(html: Column) -> Column:
    """og:title, else the first h1, else the title; tags and white space folded."""
    tidy = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), r"\s+", " "))
    found = [F.regexp_extract(html, p, 1) for p in (r'(?is)<meta[^>]+property="og:title"[^>]+content="([^"]*)"', r"(?is)<h1[^>]*>(.*?)</h1>", r"(?is)<title[^>]*>(.*?)</title>")]
    return F.coalesce(*[F.nullif(tidy(x), F.lit("")) for x in found])


def best_label(text: Column, lexicon: dict[str, list[str]], default: str) -> Column:
    """The label whose words occur most often, ties to the earlier one; the default if none does."""
    counts = [(label, sum((F.regexp_count(F.lower(text), F.lit(w)) for w in words), F.lit(0))) for label, words in lexicon.items()]
    best = F.greatest(*[c for _, c in counts], F.lit(0))
    out = F.when(best == 0, default)
    for label, c in counts:
        out = out.when(c == best, label)
    return out


def first_rule(rules: list[tuple[str, Column]], default: str | None) -> Column:
    """The name of the first rule that holds."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, c in rules:
        out = out.when(c, name)
    return out.otherwise(F.lit(default))


def all_rules(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))


DATE = re.compile(r"(?:(\d{4})[-/.年])?(\d{1,2})[-/.月](\d{1,2})日?(?:\s*(上午|下午|am|pm)?\s*(\d{1,2}):(\d{2}))?", re.I)
#: Words near a date that tell its part.
ROLES = (("deadline", re.compile(r"deadline|before|until|by|截止|之前", re.I)), ("start", re.compile(r"from|start|begins|开始|起", re.I)), ("event", re.compile(r"held|on|举行|时间", re.I)))


def dated_facts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every date of a text with its time, a missing year taken from the 30 characters before it, and its part by the words within 25 characters."""

    def facts(t: str) -> list[dict]:
        out = []
        for m in DATE.finditer(t or ""):
            y, mo, d, half, h, mi = m.groups()
            if not y:
                years = re.findall(r"(?:19|20)\d{2}", t[max(0, m.start() - 30) : m.start()])
                y = years[-1] if years else None
            if not 1 <= int(mo) <= 12 or not 1 <= int(d) <= 31 or not y:
                continue
            h = int(h) + 12 * (half is not None and half.lower() in ("下午", "pm") and int(h) < 12) if h else None
            near = t[max(0, m.start() - 25) : m.end() + 25]
            out.append({"date": f"{int(y):04d}-{int(mo):02d}-{int(d):02d}", "time": f"{h:02d}:{mi}" if h is not None else None, "role": next((r for r, p in ROLES if p.search(near)), "mention"), "at": m.start()})
        return out

    @F.pandas_udf("array<struct<date:string,time:string,role:string,at:int>>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(facts)

    rows = df.select(id_col, F.explode(run(F.col(text_col))).alias("f")).select(id_col, "f.*")
    return rows.withColumn("date", F.try_to_date("date", "yyyy-MM-dd")).where("date is not null")
