"""URLs as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track, and endings of files.
TRACKING = ("spm", "from", "source", "share", "fbclid", "gclid", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")
ATTACHMENTS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "csv")
SKIPPED = ("jpg", "jpeg", "png", "gif", "svg", "ico", "css", "js", "mp4", "mp3", "woff", "woff2")

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, PARTS, i)


def host(url: Column) -> Column:
    """Lower case, without user, default port or final dot."""
    h = F.regexp_replace(F.lower(part(url, 2)), r"^[^@]*@", "")
    return F.regexp_replace(F.regexp_replace(h, r":(?:80|443)$", ""), r"\.$", "")


def _query(url: Column, dropped: Column | None, ordered: bool) -> Column:
    keep = F.filter(F.split(part(url, 4), "&"), lambda p: (p != "") & (~dropped_by(p, dropped)))
    keep = F.array_sort(keep) if ordered else keep
    return F.when(F.size(keep) > 0, F.concat(F.lit("?"), F.array_join(keep, "&"))).otherwise(F.lit(""))


def dropped_by(p: Column, pattern: str | None) -> Column:
    return p.rlike(pattern) if pattern else F.lit(False)


def normalize_strict(url: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """http(s) only (else null): lower host, no default port, fragment, tracking parameter or final slash; parameters sorted."""
    path = F.regexp_replace(part(url, 3), r"/+$", "")
    pattern = "^(?:utm_[^=]*|" + "|".join(tracking) + ")(?:=|$)"
    out = F.concat(F.lower(part(url, 1)), F.lit("://"), host(url), path, _query(url, pattern, True))
    return F.when(F.lower(part(url, 1)).isin("http", "https") & (host(url) != ""), out)


def normalize_loose(url: Column) -> Column:
    """Parameters keep their order; those that begin with utm_, from or scene go; double slashes of the path collapse."""
    path = F.regexp_replace(part(url, 3), r"/{2,}", "/")
    return F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path, _query(url, "^(?:utm_|from|scene)", False))


def canonical(url: Column) -> Column:
    """Lower scheme and host, single slashes, the query as it is."""
    query = F.when(part(url, 4) != "", F.concat(F.lit("?"), part(url, 4))).otherwise(F.lit(""))
    return F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), F.regexp_replace(part(url, 3), r"/{2,}", "/"), query)


def allowed(url: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    h = host(url)
    out = F.lit(False)
    for d in domains:
        out = out | (h == d) | h.endswith("." + d)
    return out


def extension_class(url: Column) -> Column:
    e = F.lower(F.regexp_extract(part(url, 3), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(e.isin(*ATTACHMENTS), "attachment").when(e.isin(*SKIPPED), "skip").otherwise("page")
