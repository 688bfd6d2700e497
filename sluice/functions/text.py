"""Text normalisation, tokenisation and splitting as expressions over columns.

Everything but NFKC and offset maps stays inside the JVM. Letters and digits are those of Unicode, as `\\p{L}` and `\\p{N}` name them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"\x{4e00}-\x{9fff}"


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def nfkc(x: Column) -> Column:
    """Unicode compatibility composition, by the JVM's own tables."""
    return F.when(F.octet_length(x) == F.char_length(x), x).otherwise(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True)))


def casefold(x: Column) -> Column:
    """Unicode's full case folding, by the JVM's own tables."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True)))


def normalize_document(x: Column) -> Column:
    """NFKC, one kind of line end, blanks in lines collapsed, provenance lines dropped, at most one empty line in a row."""
    x = F.regexp_replace(nfkc(x), r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[\t \x{3000}]+", " ")
    lines = F.transform(F.split(x, "\n"), lambda s: F.trim(s))
    x = F.array_join(F.filter(lines, lambda s: ~s.rlike(r"^- (Auth|Discovery):")), "\n")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def clean_text(x: Column) -> Column:
    """NFKC; markdown links become their labels, tags and runs of white space one space."""
    x = F.regexp_replace(nfkc(x), r"\[([^\]]*)\]\([^)]*\)", "$1")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    return strip(F.regexp_replace(x, r"\s+", " "))


def compact(x: Column) -> Column:
    """Only letters and digits, in lower case."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")


def norm(x: Column, separators: str = "keep") -> Column:
    """Lower case; what isn't a letter or digit becomes one space (`keep`) or nothing (`drop`)."""
    if separators == "drop":
        return compact(x)
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


#: Full-width punctuation and what it stands for.
WIDE, NARROW = "，。！？；：（）【】“”‘’、", ",.!?;:()[]\"\"'',"


def citation_norm(x: Column) -> Column:
    """Lower case, full-width punctuation narrowed, no white space."""
    return F.regexp_replace(F.translate(F.lower(nfkc(x)), WIDE, NARROW), r"\s+", "")


def hash_collapsed(x: Column) -> Column:
    return F.sha2(strip(F.regexp_replace(x, r"\s+", " ")), 256)


def hash_dense(x: Column) -> Column:
    return F.sha2(F.regexp_replace(x, r"\s+", ""), 256)


def ngrams(x: Column, n: int) -> Column:
    """Runs of n characters, in order; none if the text is shorter. The text is cut into characters once, as finding one in UTF-8 takes a walk."""
    runs = lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, n), ""))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(F.split(x, "")), runs)[0]


def bm25_tokens(x: Column) -> Column:
    """Words of a-z, 0-9 and _, and runs of Han characters as 1-, 2- and 3-grams; a bag."""
    x = F.lower(x)
    han = F.regexp_extract_all(x, F.lit(f"([{HAN}]+)"), 1)
    return F.concat(F.regexp_extract_all(x, F.lit("([a-z0-9_]+)"), 1), F.flatten(F.transform(han, lambda r: F.concat(ngrams(r, 1), ngrams(r, 2), ngrams(r, 3)))))


def word_tokens(x: Column) -> Column:
    """Words of any script, in lower case."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}]+)"), 1)


def unigrams(x: Column) -> Column:
    """One Han character, or one run of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(x), F.lit(f"([{HAN}]|[a-z0-9]+)"), 1)


def content_grams(x: Column, stops: tuple[str, ...] = ()) -> Column:
    """The set of 2-, 3- and 4-grams of a compacted text without stop strings."""
    x = compact(x)
    for s in stops:
        x = F.replace(x, F.lit(s), F.lit(""))
    return F.array_distinct(F.concat(ngrams(x, 2), ngrams(x, 3), ngrams(x, 4)))


def bigram_set(x: Column) -> Column:
    """The set of character pairs of a normalised text; a text of one character is its own only member."""
    x = citation_norm(x)
    return F.when(F.char_length(x) < 2, F.array(x)).otherwise(F.array_distinct(ngrams(x, 2)))


def trigram_set(x: Column) -> Column:
    """The set of runs of three characters; a shorter text gives itself."""
    x = compact(x)
    return F.when(F.char_length(x) < 3, F.array(x)).otherwise(F.array_distinct(ngrams(x, 3)))


def word_set(x: Column, least: int = 2) -> Column:
    return F.array_distinct(F.filter(F.split(norm(x), " "), lambda w: F.char_length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def coverage(query: Column, evidence: Column) -> Column:
    """The part of the query's set that the evidence has."""
    return F.size(F.array_intersect(query, evidence)) / F.greatest(F.lit(1), F.size(query))


def visible_line(x: Column) -> Column:
    """A markdown line as a reader sees it: no images, link targets, tags or list marks."""
    x = F.regexp_replace(x, r"!\[[^\]]*\]\([^)]*\)", "")
    x = F.regexp_replace(x, r"\[([^\]]*)\]\([^)]*\)", "$1")
    x = F.regexp_replace(x, r"<[^>]+>", "")
    return strip(F.regexp_replace(F.regexp_replace(x, r"^\s*(?:[-*+]|\d+[.)]|#{1,6})\s+", ""), r"\s+", " "))


#: Where sentences end, by dialect.
SENTENCE_ENDS = {"evidence": r"[。！？!?\n；]", "answer": r"[。！？!?\n；;.]", "latin": r"[.!?\n]+"}


def sentences(x: Column, dialect: str = "evidence", least: int = 6) -> Column:
    """Trimmed sentences of `least` characters or more."""
    return F.filter(F.transform(F.split(x, SENTENCE_ENDS[dialect]), strip), lambda s: F.char_length(s) >= least)


def excerpt(x: Column, head: int, tail: int, mark: str = "\n...\n") -> Column:
    """The whole of a short text; else its head and its tail."""
    return F.when(F.char_length(x) <= head + tail, x).otherwise(F.concat(F.substring(x, 1, head), F.lit(mark), F.right(x, F.lit(tail))))


def excerpt3(x: Column, budget: int, mark: str = "\n...\n") -> Column:
    """45 % from the head, 25 % about the middle, 30 % from the tail."""
    a, b, c = budget * 45 // 100, budget * 25 // 100, budget * 30 // 100
    middle = F.substring(x, (F.floor(F.char_length(x) / 2) - b // 2 + 1).cast("int"), F.lit(b))
    return F.when(F.char_length(x) <= budget, x).otherwise(F.concat(F.substring(x, 1, a), F.lit(mark), middle, F.lit(mark), F.right(x, F.lit(c))))


def template_key(x: Column) -> Column:
    """Numbers become <n>; white space collapses; lower case."""
    return strip(F.lower(F.regexp_replace(F.regexp_replace(x, r"[0-9]+(?:\.[0-9]+)?", "<N>"), r"\s+", " ")))


def policy_key(title: Column) -> Column:
    """What versions of one policy share: no dates, version brackets, document numbers or quotes; letters and digits, 80 at most."""
    x = F.regexp_replace(title, r"(?:19|20)\d{2}[-/.年]\d{1,2}(?:[-/.月]\d{1,2}日?)?|(?:19|20)\d{2}年?", "")
    x = F.regexp_replace(x, r"[(（\[【][^)）\]】]*(?:版|修订|version|rev|v\d)[^)）\]】]*[)）\]】]", "")
    x = F.regexp_replace(x, r"第?\d+号|[\"'“”‘’《》]", "")
    return F.substring(F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}_]+", "")), 1, 80)


def numbers(x: Column) -> Column:
    """Numbers of a text as they are written, percentages included."""
    return F.regexp_extract_all(x, F.lit(r"([0-9]+(?:\.[0-9]+)?%?)"), 1)
