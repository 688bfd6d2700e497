"""Each operator against a plain reading of its definition, on whole small tables and on awkward rows."""

import hashlib
import json
import math
import unicodedata

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import op1_shard, op2_simhash, op3_warc, op4_packing, op5_bpe, op6_digest, op7_substring, op8_toxicity, op9_imi, op10_quality
from sluice.llm.components import connected_components
from sluice.llm.queries import queries

from .helpers import AWKWARD, LONG, WORD, components, crc_fold, docs, lower_az

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


# 1


def test_op1_laws(spark):
    rows = queries()["op1_histogram_shards"](spark, SF).collect()
    known, sizes, slots = texts(spark), np.zeros(40, int), {}
    for r in rows:
        b = known[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 16, __import__("zlib").crc32(b), "bytes", None)
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(known) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in rows)
    assert abs(sizes - sizes.mean()).max() <= largest + 0.01 * sizes.mean()


@pytest.mark.parametrize("shards, per_task", [(1, 100), (4, 100), (4, 2)])
def test_op1_awkward(spark, shards, per_task):
    df = docs(spark)
    out = op1_shard.histogram_shards(df, shards, F.col("doc_id"), F.col("text"), F.octet_length(F.coalesce("text", F.lit(""))), rows_per_task=per_task)
    rows = out.collect()
    assert len(rows) == len(AWKWARD) and set(df.columns) <= set(out.columns)
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert op1_shard.histogram_shards(df.limit(0), 3, F.col("doc_id"), F.col("text"), F.lit(1)).count() == 0


def test_op1_hot_key_is_split(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 < 2, "same").otherwise(F.col("id").cast("string")).alias("t"))
    got = op1_shard.histogram_shards(df, 10, F.col("id"), F.col("t"), F.lit(10)).groupBy("shard").count().collect()
    assert sorted(r["shard"] for r in got) == list(range(10)) and all(abs(r["count"] - 300) <= 2 for r in got)


# 2


def fingerprint(text, n=3):
    words = WORD.findall(lower_az(text or ""))
    runs = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(pairs):
    ids = [i for i, _ in pairs]
    return components(set(ids), [(a, b) for k, (a, x) in enumerate(pairs) for b, y in pairs[:k] if (x ^ y).bit_count() <= 2])


def test_op2_equals_brute_force(spark):
    known = texts(spark)
    prints = {i: fingerprint(t) for i, t in known.items()}
    want = brute_components(list(prints.items()))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op2_simhash_vptree"](spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in known}


def test_op2_awkward(spark):
    got = op2_simhash.simhash_components(docs(spark), "doc_id", "text").collect()
    assert len(got) == len(AWKWARD)
    by = {r.id: r for r in got}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[3].component_id == 1 and by[10].component_id == 9
    assert by[6].fp & (2**64 - 1) == fingerprint("one two three four")
    assert op2_simhash.simhash_components(docs(spark).limit(0), "doc_id", "text").count() == 0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.lists(st.tuples(st.integers(0, 59), st.integers(0, 63), st.integers(0, 63)), max_size=60), st.integers(1, 40))
def test_op2_trees_lose_no_link(base, flips, leaf):
    v = np.unique(np.array(base + [base[i % len(base)] ^ (1 << a) ^ (1 << b) for i, a, b in flips], np.uint64))
    want = brute_components([(i, int(x)) for i, x in enumerate(v)])
    assert {i: int(r) for i, r in enumerate(op2_simhash.local_links(v, 2, leaf=leaf))} == want
    nodes = op2_simhash.grow(v, 2, leaf)
    where, shard = op2_simhash.route(nodes, v, 2)
    seen = {}
    for w, s in zip(where.tolist(), shard.tolist()):
        seen.setdefault(w, set()).add(s)
    for i in range(len(v)):
        for j in range(i):
            if int(v[i] ^ v[j]).bit_count() <= 2:
                assert seen[i] & seen[j]


def test_op2_knots_are_dealt_in_chunks(spark):
    """Fingerprints of which each lies within four bits of all others: no vantage point parts them, and no link may be lost between chunks."""
    base = 0x0123456789ABCDEF
    v = sorted({base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)} | {base ^ (0xFF << 50) ^ (1 << a) for a in range(20)})
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in v], "fp long")
    edges = {r.node: r.root for r in op2_simhash.hamming_components(df, "fp", 2, per_shard=50).collect()}
    want = brute_components(list(enumerate(v)))
    groups = {}
    for i, root in want.items():
        groups.setdefault(root, set()).add(v[i] - 2**64 if v[i] >> 63 else v[i])
    for g in groups.values():
        assert len({edges.get(x, x) for x in g}) == 1
    assert len({edges.get(min(g), min(g)) for g in groups.values()}) == len(groups) < len(v)


def test_similar_components(spark):
    base = [f"w{i}" for i in range(400)]
    near = lambda k: " ".join(x if i % 100 != k else f"new{k}" for i, x in enumerate(base))
    rows = [(1, " ".join(base)), (2, near(3)), (3, near(50)), (4, " ".join(f"z{i}" for i in range(400))), (5, " ".join(base)), (6, " ".join(base[:200] + [f"q{i}" for i in range(200)]))]
    got = {r.id: r.component_id for r in op2_simhash.similar_components(docs(spark, rows), "doc_id", "text").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 6}


@pytest.mark.parametrize("per_shard", [100_000, 60])
def test_similar_components_are_exact(spark, per_shard):
    """Repeated lines don't link texts of their own; pairs a little above 0.8 link, those a little below don't; short texts and chains too.

    With few rows a shard, trees part views, and knots are cut into chunks that meet pairwise; no pair may be lost either way.
    """
    rng = np.random.default_rng(5)
    line = " ".join(f"line{i}" for i in range(20))
    rows = [(i, "\n".join([line] * 20 + [" ".join(f"own{i}x{j}" for j in range(200))])) for i in (1, 2)]
    for k in range(150):
        n = int(rng.integers(5, 400))
        words = [f"d{k}w{j}" for j in range(n)]
        cut_ = int(n * rng.uniform(0.02, 0.3))
        rows += [(10 + 3 * k, " ".join(words)), (11 + 3 * k, " ".join(words[cut_:])), (12 + 3 * k, " ".join(words[cut_:] + [f"e{k}w{j}" for j in range(cut_)]))]
    sets = {i: {tuple(w[j : j + 5]) for w in [t.split()] for j in range(max(1, len(w) - 4))} for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    got = {r.id: r.component_id for r in op2_simhash.similar_components(docs(spark, rows), "doc_id", "text", per_shard=per_shard).collect()}
    assert len(pairs) > 100 and got == components(ids, pairs)


def test_similar_components_in_passes(spark, monkeypatch):
    """views are gone through in passes that deal so many rows at most, and what each has shuffled is dropped; the components are the same."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(120):
        words = [f"d{k}w{j}" for j in range(int(rng.integers(50, 300)))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[int(len(words) * rng.uniform(0.02, 0.3)) :]))]
    kept, cut_ = [], op2_simhash.cut
    monkeypatch.setattr(op2_simhash, "cut", lambda d: kept.append(d.columns) or cut_(d))
    run = lambda n: sorted(map(tuple, op2_simhash.similar_components(docs(spark, rows), "doc_id", "text", per_shard=60, dealt_rows=n).collect()))
    whole = run(10_000)
    assert kept.count(["a", "b"]) == 1  # the star of `verified_edges`
    kept.clear()
    assert run(1) == whole and kept.count(["a", "b"]) == 1 + 24
    kept.clear()
    assert run(8) == whole and 3 <= kept.count(["a", "b"]) < 25


def test_verified_edges_of_chunks(spark, monkeypatch):
    """A group whose root isn't like most of it, over several chunks."""
    monkeypatch.setattr(op2_simhash, "CHUNK", 8)
    texts = [(i, i, " ".join(f"w{j}" for j in range(20 * i, 20 * i + 200))) for i in range(40)] + [(50 + i, i, f"other text {i} of its own words") for i in range(9)]
    members = spark.createDataFrame([(i, k, 0) for i, k, _ in texts], "id long, key long, root long")
    edges = op2_simhash.verified_edges(spark.createDataFrame(texts, "id long, key long, text string"), members, 5, 0.8).collect()
    got = components([i for i, _, _ in texts], [(r.a, r.b) for r in edges])
    assert got == {i: 0 if i < 40 else i for i, _, _ in texts}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[1000 + i] for i in range(200)}) == 1 and len(set(got.values())) == 2


# 3


def test_op3_equals_brute_force(spark, tmp_path):
    big = "<p>" + "déjà " * 120_000 + "</p>"
    pages = [(5, "http://a/1", big), (2, "http://a 2", big), (9, None, big), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "x" * 100), (7, "u", "x" * 100), (None, "u", "y" * 200), (8, "u", "y" * 200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    chunks = op3_warc.read_archives(op3_warc.write_archives(df, f"file://{tmp_path}/w", chunk=1000), chunk=1000)
    rows = chunks.collect()
    assert max(len(r.chunk) for r in rows) <= 1000
    last = sorted((r.page_id if r.page_id is not None else 99, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in rows if r.is_last)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want, told = [], set()
    for i, _, t in pages:
        same = [j for j, _, u in pages if u == t and len((t or "").encode()) >= 100 and j is not None]
        first = min(same) if same else None
        again = first is not None and (i is None or first < i or (i, t) in told)  # of rows that tie one is the response
        told.add((i, t))
        want.append((99 if i is None else i, "revisit" if again else "response", first if again else None, len((t or "").encode()), sha(t)))
    key = lambda r: tuple(map(str, r))
    assert sorted(last, key=key) == sorted(want, key=key)
    whole = b"".join(r.chunk for r in sorted((r for r in rows if r.page_id == 2), key=lambda r: r.chunk_no))
    assert whole.decode() == big
    assert op3_warc.read_archives(op3_warc.write_archives(df.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_op3_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    sha = {r.page_id: hashlib.sha256((r.html or "").encode()).hexdigest() for r in pages}
    size = {r.page_id: len((r.html or "").encode()) for r in pages}
    first = {}
    for i in sorted(sha):
        first.setdefault(sha[i], i)
    want = {(i, size[i], sha[i], *(("revisit", first[sha[i]]) if size[i] >= 100 and first[sha[i]] < i else ("response", None))) for i in sha}
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries()["op3_warc_chunks"](spark, SF).collect()} == want


def test_op3_refuses_a_changed_payload(tmp_path):
    import gzip
    import io

    head = op3_warc._header({"page_id": 1, "refers_to": None, "url": "u", "n": 5, "digest": hashlib.sha256(b"right").hexdigest()})
    assert [r["is_last"] for r in op3_warc.records(io.BytesIO(gzip.compress(head + b"right\r\n\r\n")))] == [True]
    with pytest.raises(ValueError):
        list(op3_warc.records(io.BytesIO(gzip.compress(head + b"wrong\r\n\r\n"))))


# 4


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=20))
def test_op4_plans_place_every_piece(histogram):
    groups = op4_packing.plan(histogram, [16, 32, 64])
    placed = {}
    for capacity, n, contents in groups:
        used = sum(length * q for length, q in contents)
        assert used <= capacity and not any(c < capacity and c >= used for c in (16, 32, 64))
        for length, q in contents:
            placed[length] = placed.get(length, 0) + n * q
    assert placed == histogram


def plain_best_fit(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        fit = [r for r in range(len(bins)) if bins[r] >= length]
        if fit:
            i = min(fit, key=lambda r: bins[r])
            bins[i] -= length
        else:
            bins.append(capacity - length)
    return len(bins)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
def test_op4_histogram_packs_like_piece_by_piece(lengths):
    histogram = {x: lengths.count(x) for x in lengths}
    assert sum(n for _, _, n, _ in op4_packing.best_fit(histogram, lambda length, n: 50)) == plain_best_fit(lengths, 50)


def test_op4_whole_table(spark):
    rows = queries()["op4_best_fit_packing"](spark, SF).collect()
    known, bins, pieces = texts(spark), {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        if r.length:
            bins.setdefault((r.bin_id, r.capacity), []).append((r.offset, r.length))
    for i, t in known.items():
        assert sum(n for _, n in pieces[i]) == len(WORD.findall(t)) and all(a[0] + a[1] == b[0] for a, b in zip(sorted(pieces[i]), sorted(pieces[i])[1:]))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), held in bins.items():
        held.sort()
        assert held[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(held, held[1:])) and sum(held[-1]) <= capacity


def test_op4_hot_length_is_ranked_in_parts(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id") % 20).alias("n"))
    rows = op4_packing.pack(df, "id", "n", [16, 64], ranked=50).collect()
    bins = {}
    for r in rows:
        if r.length:
            bins.setdefault((r.bin_id, r.capacity), []).append((r.offset, r.length))
    assert len(rows) == 900 and len({b for b, _ in bins}) == len(bins)
    for (_, capacity), held in bins.items():
        held.sort()
        assert held[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(held, held[1:])) and sum(held[-1]) <= capacity


def test_op4_awkward(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 5), (3, 5), (None, 9000), (4, -3)], "salt long, n long")
    rows = op4_packing.pack(df, "salt", "n", [16, 64]).collect()
    assert sorted((r.id, r.length) for r in rows if r.bin_id is None) == [(1, 0), (2, 0), (4, 0)]
    assert sum(r.length for r in rows) == 9010 and op4_packing.pack(df.limit(0), "salt", "n", [16]).count() == 0


# 5


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return path, t


def test_op5_equals_the_library(spark, library):
    path, t = library
    got = {(r.id, r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in op5_bpe.encode_decode(docs(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True), "doc_id", "text", path, lexicon_words=500).collect()}
    want = set()
    for i, x in AWKWARD + [(i + 1000, x) for i, x in texts(spark).items()]:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.add((i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), len(ids)))
    assert got == want
    assert op5_bpe.encode_decode(docs(spark).limit(0), "doc_id", "text", path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abC' \nΣİß́ \u0085\x1c​1½!?<|endotxs>日\U0001f642", max_size=60))
def test_op5_any_text(library, text):
    path, t = library
    if "codec" not in test_op5_any_text.__dict__:
        voc = op5_bpe.Vocabulary(json.load(open(path, encoding="utf-8")))
        test_op5_any_text.codec = op5_bpe.Codec(voc, op5_bpe.Lexicon(op5_bpe.compile_lexicon(["ab", "abc", "bc", "nd", "end"], voc)))
    ids, decoded = test_op5_any_text.codec.text(text)
    want = t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want and decoded.decode() == t.decode(want, skip_special_tokens=False)


def test_op5_automaton_is_exact_and_minimal(library):
    voc = op5_bpe.Vocabulary(json.load(open(library[0], encoding="utf-8")))
    words = ["car", "cars", "bar", "bars", "card", "é", "tarred", "barred"]
    lex = op5_bpe.Lexicon(op5_bpe.compile_lexicon(words, voc))
    assert all(lex.get(w.encode()) == voc.merge(w) for w in words) and all(lex.get(w) is None for w in (b"", b"ca", b"carss", b"x", b"barre"))
    assert len(lex.ends) < len({w.encode()[:i] for w in words for i in range(9)})


def test_op5_refuses_other_vocabularies(library):
    spec = json.load(open(library[0], encoding="utf-8"))
    with pytest.raises(ValueError):
        op5_bpe.Vocabulary(spec | {"normalizer": None})
    with pytest.raises(ValueError):
        op5_bpe.Vocabulary(spec | {"model": spec["model"] | {"byte_fallback": True}})


# 6


def canonical(text):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold()).split())


def test_op6_equals_brute_force(spark):
    rows = {r.doc_id: r for r in queries()["op6_canonical_digest"](spark, SF).collect()}
    known = sorted(texts(spark).items())
    groups = {}
    for k, (i, t) in enumerate(known):
        nxt, m = known[(k + 1) % len(known)][1], len(t) // 4
        edited = t[: len(t) - m] + nxt[:m]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert rows[i].near_edited == float(rows[i].fingerprint == rows[i].edited_fingerprint)
        groups.setdefault(canonical(t), []).append(i)
    for ids in groups.values():
        assert len({rows[i].fingerprint for i in ids}) == 1 and {rows[i].group_id for i in ids} == {min(ids)}
    assert len({r.fingerprint for r in rows.values()}) == len(groups)


def test_op6_awkward(spark):
    rows = [(1, "Ａb  c"), (2, "ab C\n"), (3, None), (4, ""), (7, "same"), (7, "same"), (None, "tail")]
    out = op6_digest.with_next(docs(spark, rows), "doc_id", "text", ["lang"], rows_per_range=2).collect()
    assert len(out) == 7 and sorted((str(r.id), r.text, r.next_text) for r in out) == sorted([("None", "tail", "Ａb  c"), ("1", "Ａb  c", "ab C\n"), ("2", "ab C\n", ""), ("3", "", ""), ("4", "", "same"), ("7", "same", "same"), ("7", "same", "tail")])
    groups = {r.group_id: r.copies for r in op6_digest.digest_groups(docs(spark, rows), "doc_id", "text").collect()}
    assert groups[1] == 2 and groups[3] == 2 and groups[7] == 2
    assert op6_digest.with_next(docs(spark).limit(0), "doc_id", "text", []).count() == 0
    one = op6_digest.with_next(docs(spark, [(5, "only")]), "doc_id", "text", []).first()
    assert one.next_text == "only"


def test_op6_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(op6_digest, "halves", lambda c: (F.lit(1).cast("long"), F.lit(2).cast("long")))
    got = {(r.group_id, r.canon, r.copies) for r in op6_digest.digest_groups(docs(spark, [(1, "a"), (2, "b"), (3, "A")]), "doc_id", "text").collect()}
    assert got == {(1, "a", 2), (2, "b", 1)}


FOLDS = [(1, "Straße ΣΊΣΥΦΟΣ"), (2, "STRASSE σίσυφος"), (3, None), (4, " \n"), (5, "ﬁne Ⅷ"), (6, "FINE viii"), (7, "same"), (7, "same"), (8, LONG), (9, LONG.upper())]


@pytest.mark.parametrize("collide", [False, True])
def test_op6_query_on_awkward_rows(spark, tmp_path, monkeypatch, collide):
    """Folding as Python's; and where all fingerprints are made equal, groups are still told apart by their bytes."""
    if collide:
        monkeypatch.setattr(op6_digest, "halves", lambda c: (F.lit(1).cast("long"), F.length(c).cast("long") * 0))
    docs(spark, FOLDS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries()["op6_canonical_digest"](spark, str(tmp_path)).collect()
    groups = {}
    for i, t in FOLDS:
        groups.setdefault(canonical(t), []).append(i)
    assert sorted((r.doc_id, r.group_id, r.copies) for r in rows) == sorted((i, min(g), len(g)) for g in groups.values() for i in g)
    known = sorted((i, t or "") for i, t in FOLDS)
    for r in rows:
        at = [k for k, x in enumerate(known) if x[0] == r.doc_id]
        edits = {known[k][1][: len(known[k][1]) - len(known[k][1]) // 4] + known[(k + 1) % len(known)][1][: len(known[k][1]) // 4] for k in at}
        assert r.edited_sha256 in {hashlib.sha256(e.encode()).hexdigest() for e in edits}
        assert r.near_next in {float(canonical(known[k][1]) == canonical(known[(k + 1) % len(known)][1])) for k in at}


# 7


def brute_repeats(rows, window=50):
    first = {}
    for i, t in sorted(rows, key=lambda r: -(1 << 62) if r[0] is None else r[0]):
        w = WORD.findall(t or "")
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - window + 1):
            f = first[tuple(w[p : p + window])]
            if (-(1 << 62) if f is None else f) < (-(1 << 62) if i is None else i):
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_op7_equals_brute_force(spark):
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in queries()["op7_fixed_block_anchors"](spark, SF).collect()), key=str)
    assert got == brute_repeats(list(texts(spark).items()))


def test_op7_awkward(spark):
    rng = np.random.default_rng(1)
    passage = [f"p{i}" for i in range(120)]
    rows = list(AWKWARD)
    for k in range(40):
        own, at, n = [f"d{k}w{i}" for i in range(rng.integers(0, 200))], int(rng.integers(0, 60)), int(rng.integers(30, 110))
        rows.append((100 + k, "\n".join(own[: len(own) // 2] + passage[at : at + n] + own[len(own) // 2 :])))
    rows += [(200, "same " * 130), (201, "same " * 60), (201, "same " * 60), (202, " ".join(passage[:49])), (203, " ".join(passage[:50]))]
    df = docs(spark, rows)
    out = op7_substring.drop_repeats(df, "doc_id", "text", 50)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in out.collect()), key=str)
    assert got == brute_repeats(rows) and set(df.columns) <= set(out.columns)
    assert op7_substring.drop_repeats(df.limit(0), "doc_id", "text", 50).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.booleans()), max_size=60), st.integers(1, 5))
def test_op7_what_a_slab_knows_and_sends(entries, docs_):
    """Shared hashes are those of two documents; of each shared one, the first and last document go on, as blocks and as probes; the others all do."""
    h = np.array([x for x, _ in entries], np.uint64)
    block = np.array([b for _, b in entries], bool)
    doc = np.sort(np.arange(len(h)) % docs_)
    shared, blocks, probes = op7_substring.met_here(h, doc, block)
    for x in set(h.tolist()):
        here = h == x
        many = len(set(doc[here].tolist())) > 1
        assert (shared[here] == many).all()
        if many:
            assert probes[here].sum() <= 2 and set(doc[here & probes].tolist()) == {doc[here].min(), doc[here].max()}
            if (here & block).any():
                assert blocks[here].sum() <= 2 and set(doc[here & blocks].tolist()) == {doc[here & block].min(), doc[here & block].max()}
        else:
            assert probes[here].all()
            assert not (here & block).any() or blocks[here & block].any()
    assert not (blocks & ~block).any()


def test_op7_hot_passage_over_many_slabs(spark, monkeypatch):
    monkeypatch.setattr(op7_substring, "SLAB_BYTES", 3000)
    rng = np.random.default_rng(2)
    passage = [f"hot{i}" for i in range(60)]
    rows = [(k, " ".join([f"a{k}x{i}" for i in range(int(rng.integers(0, 40)))] + (passage if k % 3 else []) + [f"b{k}x{i}" for i in range(20)])) for k in range(150)]
    out = op7_substring.drop_repeats(docs(spark, rows), "doc_id", "text", 50)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in out.collect()), key=str) == brute_repeats(rows)


def test_op7_ids_are_wide(spark, monkeypatch):
    """Rows whose 64-bit ids collide lose their own words only."""
    same = op7_substring.F.xxhash64
    monkeypatch.setattr(op7_substring.F, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 2 else same(*c))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"{passage} a b"), (2, f"c d {passage}"), (3, " ".join(f"q{i}" for i in range(80)))]
    out = op7_substring.drop_repeats(docs(spark, rows), "doc_id", "text", 50).collect()
    assert {r.doc_id: r.n_removed for r in out}[3] == 0 and len(out) == 3


# 8 and 10


@pytest.mark.parametrize("name, label, least, cut", [("op8_levenshtein_lexicon", "toxic", 0.9, 0.7), ("op10_factorisation_machine", "quality", 0.95, 0.5)])
def test_classifiers_on_the_held_out_third(spark, name, label, least, cut):
    sf = "/root/testdata/sf0.01"
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries()[name](spark, sf).collect()
    assert len(rows) == 1000 and all(r.held_out == crc_fold(r.doc_id) and r.predicted == int(r.score >= cut) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in y]
    assert sum(r.predicted == y[r.doc_id] for r in held) / len(held) >= least


def test_classifiers_awkward(spark):
    df = docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op10_quality.fit_quality(df, none) is None
    assert {r.score for r in op10_quality.score_quality(df, "doc_id", "text", None).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2, None) for i in range(14)] + [(None, 1, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")
    model = op10_quality.fit_quality(df, some)
    scored = op10_quality.score_quality(df, "doc_id", "text", model, df.columns)
    assert scored.count() == len(AWKWARD) and set(df.columns) <= set(scored.columns)
    tox = op8_toxicity.score_toxicity(df, "doc_id", "text", op8_toxicity.fit_toxicity(df, none), df.columns)
    assert tox.count() == len(AWKWARD) and all(0 <= r.score < 0.7 for r in tox.collect())
    assert op8_toxicity.score_toxicity(df.limit(0), "doc_id", "text", ({}, op8_toxicity.PRIOR)).count() == 0


def test_the_sample_is_bounded_where_ids_repeat(spark):
    df = docs(spark, [(1, f"text {i}") for i in range(60)] + [(2, "other")])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    rows = op10_quality.labelled(df, labels, "quality", 10).collect()
    assert sorted((r.text, r.y) for r in rows) == sorted((t, y) for i, t, y in ((1, "text 0", 0), (2, "other", 1)) if not crc_fold(i))


def test_op10_sum_of_squares_identity():
    m = op10_quality.Machine(inputs=40, factors=3)
    m.w[:], rng = np.arange(40) / 50, np.random.default_rng(0)
    m.v[:] = rng.normal(size=m.v.shape)
    at, x = np.array([3, 9, 20, 5, 7]), np.array([1.0, 0.5, 2.0, 1.0, -1.0], np.float32)
    got = m.margins(at, x, np.array([0, 3]))[0]
    for (s, e), z in zip(((0, 3), (3, 5)), got):
        i, v = at[s:e], x[s:e]
        pairs = sum(float(m.v[i[a]] @ m.v[i[b]]) * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert abs(float(m.w[i] @ v) + pairs - z) < 1e-4


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcde", min_size=1, max_size=14))
def test_op8_automaton_equals_distances(word):
    terms = ["abcde", "bcdeabcde", "abcd", "edcba", "ddddddddd", "acede*"]
    best = None
    for t in terms:
        body = t.rstrip("*")
        row = distance(body, word)
        d = min(row) if t.endswith("*") else row[-1]
        if d <= op8_toxicity.edits(len(body)) and (best is None or d < best):
            best = d
    got = op8_toxicity.FuzzyLexicon({t: 1.0 for t in terms}).meet(word)
    assert (got[0] if got else None) == best


def test_op8_keeps_long_terms(spark):
    """A term of 45 letters is learned and matched whole, and no number of terms is too large."""
    long = "".join(chr(97 + i * 7 % 26) for i in range(45))
    rows = [(f"some talk w{'abcdefghij'[i % 10]}x {long} n{'klmnopqrst'[i % 10]} on", 1) for i in range(40)] + [(f"calm words here num{chr(97 + i % 26)}", 0) for i in range(60)]
    terms = op8_toxicity.learn_terms(spark.createDataFrame([(t + " x" * i, y) for i, (t, y) in enumerate(rows)], "text string, y int"))
    judge = op8_toxicity.Judge(terms)
    assert judge.match(long) == (0, long) and judge.match(long[:20] + "q" + long[21:]) == (1, long)
    assert judge.match(long[:40]) is None


def plain_features(text, terms):
    """What `Judge` says of a text, from edit distances to all terms and sums over all windows."""
    low = text.lower()
    hits, n = [], 0
    inside = [False] * (len(low) + 1)
    for m in op8_toxicity.QUOTED.finditer(low):
        for i in range(m.start(), m.end()):
            inside[i] = True
    for i, m in enumerate(op8_toxicity.WORD.finditer(low)):
        n, best = n + 1, None
        for t in terms:
            body = t.rstrip("*")
            row = distance(body, m.group())
            d = min(row) if t.endswith("*") else row[-1]
            if d <= op8_toxicity.edits(len(body)) and (best is None or (d, t) < best):
                best = (d, t)
        if best:
            hits.append((i, best[0] == 0, inside[m.start()], terms[best[1]]))
    if not hits:
        return [0.0] * 6
    part = lambda exact, quoted: math.log1p(sum(w for _, e, q, w in hits if (e, q) == (exact, quoted)))
    weight = lambda e, q, w: w * (1.0 if e else 0.4) * (0.3 if q else 1.0)
    near = max(sum(weight(e, q, w) for j, e, q, w in hits if abs(j - i) <= op8_toxicity.WINDOW) for i, *_ in hits)
    return [part(True, False), part(True, True), part(False, False), part(False, True), math.log1p(near), min(1.0, 20 * sum(weight(e, q, w) for _, e, q, w in hits) / n)]


def test_op8_scores_equal_a_plain_scorer(spark):
    terms = {"scoundrel": 0.9, "vermin": 0.5, "idiot*": 0.8, "fool": 0.3, "scoundrels": 0.7}
    weights = op8_toxicity.PRIOR
    texts = ["", "no hit at all here", 'you scoundrle said "vermin and idiotic fools" ' + "calm " * 30 + "scoundrels, vermni!", "idiots idoit fool Fool", "“vermin” «scoundrel» vermin " * 9, "é ünï " + "word " * 200 + "idiot"]
    got = {r.doc_id: r.score for r in op8_toxicity.score_toxicity(docs(spark, list(enumerate(texts))), "doc_id", "text", (terms, weights)).collect()}
    for i, t in enumerate(texts):
        z = sum(a * b for a, b in zip([*plain_features(t, terms), 1.0], weights))
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9
    assert got[2] > got[1]


def test_op10_scores_equal_a_plain_scorer(spark):
    """All pairs of inputs, one by one, from the words of the text."""
    texts = ["", "one two two three", "A line.\nAnother | line, here!\n" * 3, "é ünï 日本 $$ 12"]
    rng, inputs = np.random.default_rng(3), op10_quality.Inputs()
    m = op10_quality.Machine(seed=8)
    m.w0, m.w[:] = 0.25, rng.normal(0, 0.3, len(m.w))
    m.v[:] = rng.normal(0, 0.3, m.v.shape)
    scale = (np.full(op10_quality.STATS, 0.2), np.full(op10_quality.STATS, 0.7))
    got = {r.doc_id: r.score for r in op10_quality.score_quality(docs(spark, list(enumerate(texts))), "doc_id", "text", (m, scale)).collect()}
    for i, t in enumerate(texts):
        counts = {}
        for w in t.encode().lower().split():
            counts[w] = counts.get(w, 0) + 1
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
        x = [(xxhash.xxh64_intdigest(w, 10) % op10_quality.BUCKETS, math.log1p(c) / norm) for w, c in counts.items()]
        stats = inputs.of(t.encode())[2]
        x += [(op10_quality.BUCKETS + k, max(-4, min(4, (s - 0.2) / 0.7)) / 4) for k, s in enumerate(stats)]
        z = m.w0 + sum(float(m.w[a]) * v for a, v in x) + sum(float(m.v[a].astype(float) @ m.v[b].astype(float)) * v * u for n, (a, v) in enumerate(x) for b, u in x[:n])
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-4
    none = docs(spark).limit(0)
    assert op10_quality.score_quality(none, "doc_id", "text", (m, scale)).count() == 0
    assert op10_quality.fit_quality(none, spark.createDataFrame([(1, 1)], "doc_id long, quality int")) is None


def test_op8_quotation_counts_less():
    judge = op8_toxicity.Judge({"scoundrel": 1.0})
    score = lambda t: float(np.array([*judge.features(t), 1.0]) @ op8_toxicity.PRIOR)
    assert score("you are a scoundrel") > score("you are a scoundrle") > score("a plain text")
    assert score("you are a scoundrel") > score('he wrote "you are a scoundrel" there')


# 9


def op9_recall(found, x, ids):
    """Recall of the rows found, against brute force; ranks, ties and scores are checked on the way."""
    got, hits, total = {}, 0, 0
    for r in found:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        want = [ids[j] for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 11)) and all(abs(d[ids == v][0] - s) < 1e-12 for _, v, s in rows)
        hits, total = hits + len(set(want) & {r[1] for r in rows}), total + 10
    return hits / total


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_op9_recall_and_exactness(spark, sf):
    sf = f"/root/testdata/sf{sf}"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    found = queries()["op9_inverted_multi_index"](spark, sf).collect()
    assert op9_recall(found, np.stack(e.embedding).astype(float), e.vec_id.to_numpy()) >= 0.9


@pytest.mark.parametrize("clusters", [0, 200])
def test_op9_recall_on_made_tables(spark, tmp_path, clusters):
    """20,000 vectors without clusters, and with them; what is looked at is the share that the index learned."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 24))
    if clusters:
        x = 6 * rng.normal(size=(clusters, 24))[rng.integers(0, clusters, 20_000)] + 0.5 * x
    x = x.astype(np.float32)
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vec_id": np.arange(20_000), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), f"{tmp_path}/v.parquet")
    found = op9_imi.multi_index_search(spark.read.parquet(f"{tmp_path}/v.parquet"), "vec_id", "embedding", lambda i: i % 100 == 0).collect()
    assert op9_recall(found, x.astype(float), np.arange(20_000)) >= 0.9


def test_op9_visits_take_little_memory():
    """A block of 256 queries over 1,024 x 1,024 cells."""
    import tracemalloc

    rng = np.random.default_rng(2)
    a, b, held = rng.random((256, 1024)), rng.random((256, 1024)), np.ones(1 << 20, np.int64)
    tracemalloc.start()
    bits = op9_imi.visited(a, b, held, 2_000, 1024)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and bits.shape == (256, 1024, 128)
    for i in (0, 17, 255):
        got = np.nonzero(np.unpackbits(bits[i], axis=1).ravel())[0]
        assert sorted(op9_imi.walk(a[i], b[i], held, 2_000)) == got.tolist()


def test_op9_awkward(spark):
    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0, 0.0]), (2, None), (3, [0.0] * 4), (4, [1.0, float("nan"), 0.0, 0.0]), (5, [None, 1.0, 0.0, 0.0]), (6, [float("inf"), 1.0, 0.0, 0.0]), (7, [1.0, 2.0]), (100, [0.0, 1.0, 0.0, 0.0]), (8, []), (None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, part string")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in op9_imi.multi_index_search(df, "vec_id", "embedding", lambda i: i % 100 == 0).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, round(2**0.5, 6)), (100, 1, 0, round(2**0.5, 6)), (100, 2, 1, round(2**0.5, 6))]
    assert op9_imi.multi_index_search(df.limit(0), "vec_id", "embedding", lambda i: i % 100 == 0).count() == 0
    close = spark.createDataFrame([(i, [1.0, i * 1e-12]) for i in range(40)], "vec_id long, embedding array<double>")  # alike as floats
    got = op9_imi.multi_index_search(close, "vec_id", "embedding", lambda i: i == 20).orderBy("rank").collect()
    assert {r.vec_id for r in got} == {*range(15, 26)} - {20} and all(abs(r.score - abs(r.vec_id - 20) * 1e-12) < 1e-20 for r in got)
    ties = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(300)], "vec_id long, embedding array<float>")
    got = op9_imi.multi_index_search(ties, "vec_id", "embedding", lambda i: i == 100).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(10))
