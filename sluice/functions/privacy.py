"""Redaction and screening of private, secret and injected content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import PRIVATE_URL, PRIVATE_VALUES, PRIVATE_WORDS

#: The order matters, as a long number is an id before it can be a phone.
PII = ((r"\b\d{10,14}\b", "[ID_REDACTED]"), (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL_REDACTED]"), (r"\b1\d{10}\b|\b\d{3,4}-\d{7,8}\b", "[PHONE_REDACTED]"))
SECRETS = ((r"(?i)(Authorization:\s*Bearer\s+)\S+", "$1[REDACTED]"), (r"sk-[A-Za-z0-9_-]{12,}", "[REDACTED]"), (r"(?i)\b((?:api[_-]?key|token|secret|password)\s*[=:]\s*)[\"']?[A-Za-z0-9_\-./+]{8,}[\"']?", "$1[REDACTED]"))
#: What an injected line says.
INJECTION = (r"ignore (?:all |any )?(?:previous|prior|above) instructions", r"disregard (?:the )?(?:system|previous)", r"system prompt", r"you are now", r"忽略(?:以上|之前|前面)", r"系统提示词")
def _all(x: Column, rules) -> Column:
    for pattern, by in rules:
        x = F.regexp_replace(x, pattern, by)
    return x


def redact_pii(x: Column) -> Column:
    return _all(x, PII)


def redact_secrets(x: Column) -> Column:
    return _all(x, SECRETS)


def private_reason(url: Column, title: Column, text: Column, address: str = PRIVATE_URL, words: tuple[str, ...] = PRIVATE_WORDS, values: tuple[str, ...] = PRIVATE_VALUES, head: int = 8000) -> Column:
    """The first reason that holds: the URL's pattern, a word of URL or title, a value in the first `head` characters of the text (by the rule itself); null if none does."""
    low = F.lower(F.concat_ws(" ", url, title))
    out = F.when(F.lower(url).rlike(address), "private_url")
    for w in words:
        out = out.when(F.contains(low, F.lit(w.lower())), f"private_word:{w}")
    seen = F.substring(text, 1, head)
    for i, pattern in enumerate(values):
        out = out.when(seen.rlike(pattern), f"private_value:{i + 1}")
    return out


def quarantine_lines(x: Column, patterns: tuple[str, ...] = INJECTION, by: str = "[QUARANTINED]") -> tuple[Column, Column]:
    """(the text with injected lines replaced, the first 160 characters of each of those)."""
    bad = "(?i)" + "|".join(patterns)
    lines = F.split(x, "\n")
    return F.array_join(F.transform(lines, lambda s: F.when(s.rlike(bad), by).otherwise(s)), "\n"), F.transform(F.filter(lines, lambda s: s.rlike(bad)), lambda s: F.substring(s, 1, 160))


def contains_phrase(x: Column, phrases: list[str]) -> Column:
    """Any literal phrase, whatever its case."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(F.lower(x), F.lit(p.lower()))
    return out


def redact_phrases(x: Column, phrases: list[str], by: str = "[REDACTED]") -> Column:
    for p in phrases:
        x = F.regexp_replace(x, "(?i)\\Q" + p + "\\E", by)
    return x
