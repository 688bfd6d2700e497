"""Near duplicates by cosine, and acceptance one after the other, against plain versions."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import acceptance as A
from sluice.operators import cosine as C
from sluice.operators import dedup as D

WORDS = [f"{a}{b}{c}" for a in ("lo", "mar", "ten", "qui", "sab") for b in ("ri", "den", "pol", "u") for c in ("", "s", "ta", "mok")]


def made(n, seed, length=140):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) + (str(r.randrange(40)) if r.random() < 0.3 else "") for _ in range(length)) for _ in range(n)]


def grams(text):
    out = Counter()
    for w in text.lower().split():
        w = f" {w} "
        for n in (3, 4, 5):
            for i in range(len(w) - n + 1):
                out[w[i : i + n]] += 1
    return out


def weighed(corpus, features):
    """A function of a text that gives its weights by gram."""
    counts = [grams(t) for t in corpus]
    total, df = Counter(), Counter()
    for c in counts:
        total.update(c)
        df.update(c.keys())
    known = set(sorted(total, key=lambda g: (-total[g], g))[:features])

    def weigh(text):
        w = {g: (1 + math.log(k)) * (math.log((1 + len(corpus)) / (1 + df[g])) + 1) for g, k in grams(text).items() if g in known}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / norm for g, x in w.items()}

    return weigh


def dot(x, y):
    return sum(v * y.get(g, 0) for g, v in x.items())


def near_copies(texts, seed):
    """Copies with a word or two changed, so that similarities lie about the bound."""
    r, out = random.Random(seed), []
    for t in texts:
        w = t.split()
        for _ in range(r.choice((1, 1, 1, 2, 3))):
            w[r.randrange(len(w))] += r.choice("sxz")
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("least, features", [(0.985, 60_000), (0.985, 150), (0.9, 60_000), (0.6, 60_000)])
def test_cosine_pairs_equal_all_pairs(spark, least, features):
    pool = made(40, 1)
    rows = near_copies(pool, 2) + made(10, 3) + [pool[0], pool[0], "", None]
    both = pool + rows
    weigh = weighed([t or "" for t in both], features)
    a, b = [weigh(t or "") for t in rows], [weigh(t) for t in pool]
    want = {(i, j): s for i, x in enumerate(a) for j, y in enumerate(b) if (s := dot(x, y)) >= least}
    frame = lambda ts: spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "id long, t string")
    vectors = C.tfidf(frame(both), "t", features)
    got = {(r.a, r.b): r.cosine for r in C.cosine_pairs(vectors(frame(rows), "id", "t"), vectors(frame(pool), "id", "t"), least).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert 8 < len(want) < len(rows) * len(pool)
    if least == 0.985 and features > 1000:  # planted on both sides of the bound
        missed = [s for i, x in enumerate(a) for y in b if 0.97 < (s := dot(x, y)) < least]
        assert missed and min(want.values()) < 0.995


def test_cosine_candidates_are_few(spark):
    """Texts that share their frequent words only meet in no tail."""
    texts = made(200, 9)
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    vectors = C.tfidf(frame, "t")(frame, "id", "t")
    tails = C._tails(vectors, 0.985)
    assert tails.count() < 0.25 * vectors.select(F.sum(F.size("at"))).first()[0]
    assert C.cosine_pairs(vectors, vectors, 0.985).count() == len(texts)


def test_cosine_join_keeps_no_vectors(spark, monkeypatch):
    """Whole vectors are ten times as large as texts, so neither they nor pairs that only share a frequent word are kept."""
    kept = []
    monkeypatch.setattr(C, "keep", lambda d, keep=C.keep: kept.append(keep(d)) or kept[-1])
    texts = made(150, 21)
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    weigh = C.tfidf(frame, "t")
    entries = weigh(frame, "id", "t").select(F.sum(F.size("at"))).first()[0]
    vectors = weigh(frame, "id", "t")
    assert C.cosine_pairs(vectors, vectors, 0.985).count() == len(texts)
    assert all(d.select(F.sum(F.size("at"))).first()[0] < 0.25 * entries for d in kept if "at" in d.columns)
    assert all(d.count() <= 2 * len(texts) for d in kept)


def plain_cascade(candidates, protected, evaluation, features):
    def norm(t):
        return " ".join(re.sub(r"[^\w]+", " ", unicodedata.normalize("NFKC", t or "").casefold()).split())

    exact, normed, held, out = set(protected), {norm(t) for t in protected}, {norm(t) for t in evaluation}, {}
    kept = []
    for i, t in sorted(candidates):
        t = t or ""
        reason = "EMPTY_PROMPT" if not t.strip() else "MALFORMED" if "�" in t else "TOO_LONG" if len(t) > 12_000 else "EXACT_DUPLICATE" if t in exact else "NORMALIZED_DUPLICATE" if norm(t) in normed else "EVALUATION_EXACT_OR_NORMALIZED" if norm(t) in held else None
        out[i] = (reason, None)
        if reason is None:
            exact.add(t), normed.add(norm(t)), kept.append((i, t))
    pool = [*protected, *evaluation]
    weigh = weighed(pool + [t for _, t in kept], features)
    sides = [weigh(t) for t in pool]
    for i, t in kept:
        scores = [round(dot(weigh(t), y), 9) for y in sides]
        best = max(scores)
        if best >= 0.985:
            out[i] = ("SEMANTIC_NEAR_DUPLICATE_EVAL" if scores.index(best) >= len(protected) else "SEMANTIC_NEAR_DUPLICATE_TRAINING", round(best, 6))
    return out


def test_cascade_equals_the_loop(spark):
    protected, evaluation = made(25, 4), made(15, 5)
    texts = near_copies(protected, 6) + near_copies(evaluation, 7) + made(20, 8)
    texts += [protected[0], protected[1].upper(), evaluation[0], evaluation[1] + " !!", "", None, "  \n", "bad � mark", "x " * 6_001, "fine " * 2_400, texts[-1], texts[-1].upper(), texts[-1].upper(), "Straße", "STRASSE", "ﬁne ½"]
    candidates = list(enumerate(texts))
    random.Random(1).shuffle(candidates)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.reason, r.max_reference_tfidf_cosine) for r in D.cascade(frame(candidates), frame(list(enumerate(protected))), frame(list(enumerate(evaluation))), "doc_id", "text").collect()}
    want = plain_cascade(candidates, protected, evaluation, 60_000)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(v[1] is None if want[k][1] is None else abs(v[1] - want[k][1]) < 2e-6 for k, v in got.items())
    assert {"SEMANTIC_NEAR_DUPLICATE_EVAL", "SEMANTIC_NEAR_DUPLICATE_TRAINING", "EXACT_DUPLICATE", "NORMALIZED_DUPLICATE", "EVALUATION_EXACT_OR_NORMALIZED", None} <= {v[0] for v in got.values()}


def test_split_audit_equals_the_loop(spark):
    train = made(30, 11)
    validation = near_copies(train[:12], 12) + made(5, 13) + [train[0], train[1].upper(), "", None]
    frame = lambda ts, at: spark.createDataFrame([(at + i, t) for i, t in enumerate(ts)], "doc_id long, text string")
    got = D.split_audit(frame(train, 0), frame(validation, 1000), "doc_id", "text").first()
    norm = lambda t: " ".join(re.sub(r"[^\w]+", " ", unicodedata.normalize("NFKC", t or "").casefold()).split())
    words = lambda t: {w for w in norm(t).split() if len(w) > 1}
    weigh = weighed(train + [t or "" for t in validation], 60_000)
    lexical = sum(any(words(t) and len(words(t) & words(s)) / len(words(t) | words(s)) >= 0.9 for s in train) for t in validation)
    semantic = sum(any(dot(weigh(t or ""), weigh(s)) >= 0.985 for s in train) for t in validation)
    want = (len({t or "" for t in validation} & set(train)), len({norm(t) for t in validation} & {norm(t) for t in train}), lexical, semantic)
    assert tuple(got)[1:] == want and got.status == "FAIL" and min(want) > 0
    assert D.split_audit(frame(train[:5], 0), frame(made(5, 14), 1000), "doc_id", "text").first().status == "PASS"


def one_by_one(pairs):
    keys = {}
    for i, k in pairs:
        keys.setdefault(i, set()).add(k)
    seen, out = set(), set()
    for i in sorted(keys):
        if not keys[i] & seen:
            out.add(i)
            seen |= keys[i]
    return out


@pytest.mark.parametrize("most", [500_000, 30])
def test_acceptance_equals_going_through_the_rows(spark, most):
    r = random.Random(most)
    pairs = [(i, f"k{r.randrange(60)}") for i in range(120) for _ in range(r.choice((1, 2)))]  # a tangle
    pairs += [(1000 + i, f"c{j}") for i in range(30) for j in (i, i + 1)]  # a chain longer than a part at the lowest bound
    pairs += [(2000 + i, "hot") for i in range(100)] + [(2100, "alone"), (2101, "alone2"), (2101, None), (None, "x"), (2100, "alone")]
    got = [x.id for x in A.accepted(spark.createDataFrame(pairs, "id long, key string"), most).collect()]
    assert len(got) == len(set(got)) and set(got) == one_by_one([p for p in pairs if None not in p])


def test_a_chain_of_a_thousand_rows(spark):
    rows = [(i, f"h{i // 2}", f"u{(i + 1) // 2}") for i in range(1_000)]  # each row shares a key with the one before and the one after
    got = sorted(r.id for r in D.greedy(spark.createDataFrame(rows, "id long, h string, u string"), ["h", "u"], "id").collect())
    assert got == list(range(0, 1_000, 2))


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (5000, 5000)]
    got = {r.id: r.root for r in A.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_accept_pages_equals_the_loop(spark):
    def simhash(t):
        w = re.findall("[一-鿿]|[a-z0-9]+", t.lower())
        runs = ["".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in runs]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) >= len(h))

    base = made(12, 21, 300)
    r = random.Random(5)
    texts = []
    for t in base:
        for _ in range(6):  # each a word away from the one before: chains of near prints
            texts.append(t)
            w = t.split()
            w[r.randrange(len(w))] = r.choice(WORDS)
            t = " ".join(w)
    pages = [(i, f"u{i if i % 9 else 0}", f"Title {i if i % 7 else 1}", t) for i, t in enumerate(texts)] + [(900, "u900", None, None), (901, None, "", ""), (902, "u902", "!", "?")]
    history = [("u5", "Old title", base[3]), ("x", "title 12", "short"), ("y", "z", None)]
    got = {x.id: x.decision for x in D.accept_pages(spark.createDataFrame(pages, "id long, url string, title string, text string"), spark.createDataFrame(history, "url string, title string, text string")).collect()}
    tidy = lambda x: re.sub(r"[^\w]", "", (x or "").lower())
    digest = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    near = lambda s, others: any((s ^ o).bit_count() <= 1 for o in others)
    urls, hashes, titles, prints = {u for u, _, _ in history}, {digest(t) for _, _, t in history}, {tidy(t) for _, t, _ in history}, [simhash(t) for _, _, t in history if len(t or "") > 150]
    seen, mine, want = set(), (set(), set(), []), {}
    for i, u, title, t in pages:
        h, k, s = digest(t), tidy(title), simhash(t or "")
        if u in urls:
            want[i] = "historical_url"
        elif u is not None and u in seen:
            want[i] = "repeated_url"
        elif h in hashes or k in titles or near(s, prints):
            want[i] = "historical_content"
        elif h in mine[0] or k in mine[1] or near(s, mine[2]):
            want[i] = "internal_content"
        else:
            want[i] = "accepted"
            mine[0].add(h), mine[1].add(k), mine[2].append(s)
        seen.add(u)
    assert got == want and set(want.values()) == {"historical_url", "repeated_url", "historical_content", "internal_content", "accepted"}


@pytest.mark.parametrize("least", [0.9, 0.6])
def test_like_sets_equal_all_pairs(spark, least):
    """sets of words meet by hashes of their rarest words on both sides, and no pair is lost; equal sets come once."""
    from sluice.operators.dedup import like_sets

    texts = made(60, 31)
    sets = [sorted(set(t.split())) for t in [*texts, *near_copies(texts, 32), texts[0], "one"]]
    rows = spark.createDataFrame([(" ".join(s), s) for s in sets], "s string, tokens array<string>")
    mine, pool = rows.where("hash(s) % 2 = 0 or s like 'a%'"), rows.where("hash(s) % 2 <> 0 or s like 'a%'")
    alike = lambda a, b: round(len(a & b) / len(a | b), 6) >= least
    want = {(x.s, y.s) for x in mine.collect() for y in pool.collect() if alike(set(x.tokens), set(y.tokens))}
    got = [tuple(r) for r in like_sets(mine, pool, least, pool).select("a", "b").collect()]
    assert set(got) == want and len(got) == len(want) > 10


def test_places_bound_similarities(spark):
    """rows lie in cells by places, which never are farther apart than their vectors; so pairs met in a cell and pairs weighed are few, and none at the bound is lost, whatever the sample was."""
    texts = made(80, 41)
    texts += near_copies(texts, 42)
    weigh = weighed(texts, 60_000)
    names = {g: i for i, g in enumerate(sorted({g for t in texts for g in weigh(t)}))}
    vectors = []
    for t in texts:
        w = sorted((names[g], v) for g, v in weigh(t).items())
        vectors.append((np.array([i for i, _ in w], np.int64), np.array([v for _, v in w])))
    for sample in (vectors[:30], vectors, []):
        directions, centres, apart = C._basis_of(sample, len(names))
        z = np.array([C._place(directions, *v) for v in vectors])
        dense = np.zeros((len(vectors), len(names)))
        for row, (at, w) in zip(dense, vectors):
            row[at] = w
        exact = dense @ dense.T
        assert (z @ z.T >= exact - 1e-5).all()
        cells = [C._cells(centres, apart, x, 0.9) for x in z]
        assert all(cells[j][0] in cells[i] for i, j in zip(*np.nonzero(exact >= 0.9)))


def test_frequent_grams_of_odd_texts(spark, monkeypatch):
    """grams counted as numbers are those counted one by one, with few letters and with more than numbers have room for."""
    texts = [*made(20, 51), "ΑΣ ΑΣ\x00", "İx İx 水火木 水火木", "", None, "  ", "a", "😀😀😀 ab", "x y"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (50, 2_000):
        want = [r.gram for r in C.gram_statistics(frame, "t").orderBy(F.desc("tf"), "gram").limit(n).collect()]
        assert C.frequent_grams(frame, "t", n) == want
        monkeypatch.setattr(C, "_letters", lambda high: 16)
        assert C.frequent_grams(frame, "t", n) in (None, want)
        monkeypatch.undo()
