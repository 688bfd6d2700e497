"""Brute-force versions and awkward rows for the training-data operators."""

import re
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = " ".join(f"long{i % 977}x{i}" for i in range(30_000))
#: (doc_id, text): null, empty and blank texts, ties, repeated rows, a very long text, marks and scripts.
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "one two three four"), (6, "one two three four"), (7, "ONE  two\nthree four"), (8, "é Ünï 日本語 🙂 ½"), (9, LONG), (10, LONG), (None, "no id here at all"), (12, "x " * 200), (13, 'quote "he said" <|endoftext|> 3.5%')]


def docs(spark, rows=AWKWARD):
    """Documents with columns besides, some of which bear names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "extra", 1.5, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, uid string, salt double, `key` int")


def crc_fold(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def lower_az(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def components(ids, linked):
    """{id: least id reachable}."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
