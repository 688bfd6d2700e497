"""Hand-made rows for what SQL can't express, and invariants."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sluice.functions import text as T
from sluice.functions import urls as U
from sluice.operators import chunking as C
from sluice.operators import dedup as D
from sluice.operators import evidence as E
from sluice.operators import metadata as M
from sluice.operators import pages as P
from sluice.operators import sampling as S
from sluice.sources import readers as R
from sluice.sources import sinks as K


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_han_tokens_are_ngrams(spark):
    got = frame(spark, [("奖学金 GPA_1",)], "x string").select(T.bm25_tokens(F.col("x"))).first()[0]
    assert sorted(got) == sorted(["gpa_1", "奖", "学", "金", "奖学", "学金", "奖学金"])


def test_nfkc_and_lines(spark):
    text = "Ａ１\r\n- Auth: x\r\n\n\n\n  b　c  \n"
    assert frame(spark, [(text,)], "x string").select(T.normalize_document(F.col("x"))).first()[0] == "A1\n\nb c"


def test_numerals(spark):
    words = {"三十二": 32.0, "一百零五": 105.0, "二万三千": 23000.0, "十": 10.0, "二〇二六": 2026.0, "两千零二十": 2020.0, "十万": 100000.0, "第十二条第三": 12.0, "无": None, "": None}
    rows = frame(spark, [*((w, v) for w, v in words.items()), (None, None)], "w string, v double")
    assert [r for r in rows.withColumn("got", C.chinese_number("w")).collect() if r.v != r.got] == []


def test_offsets_point_at_sources():
    text = "a [label](http://x) &amp; <b>Ｂ</b>\n\n c"
    canon, at, did = C.canonical(text)
    assert canon == "a label &amp; B c" and len(at) == len(canon) and all(text[i] == c for i, c in zip(at, canon) if c in "alebc")
    assert did == ["HTML_TEXT_NORMALIZED", "MARKDOWN_TEXT_NORMALIZED", "UNICODE_WHITESPACE_NORMALIZED"]
    assert C.canonical("a<b>c")[:2] == ("a c", [0, 1, 4]) and C.canonical("x <unclosed y")[0] == "x" and C.canonical("a \n b")[1] == [0, 3, 4]
    assert C.canonical(None) == ("", [], ["SPAN_INVALID"]) and C.canonical("")[0] == ""


def test_clean_text_folds_compatibility_forms(spark):
    assert frame(spark, [("Ａ１ [name](u) <b>x</b>　y",)], "x string").select(T.clean_text(F.col("x"))).first()[0] == "A1 name x y"


def test_strict_urls(spark):
    rows = [("HTTP://Ex.COM.:80/a/b/?utm_x=1&b=2&a=1#f",), ("ftp://x/y",), ("https://h/p?from=1",)]
    got = [r[0] for r in frame(spark, rows, "u string").select(U.normalize_strict(F.col("u"))).collect()]
    assert got == ["http://ex.com/a/b?a=1&b=2", None, "https://h/p"]


@pytest.mark.parametrize("cut", [C._boundary, lambda *a: C._half_break(*a, 80)])
def test_chunks_cover_and_round_trip(cut):
    text = "\n".join(f"Sentence number {i} is here. And more words follow it" for i in range(120))
    out = cut(text, 800, 120)
    assert all(text[s:e].strip() == t for s, e, t in out)
    assert out[0][0] == 0 and out[-1][1] == len(text)
    assert all(b[0] <= a[1] for a, b in zip(out, out[1:]))


def test_boundary_chunks_by_hand(spark):
    """A break counts from 55 % of the width on; a chunk starts with a word behind the overlap; only the last chunk joins, by an empty line."""
    first = "x" * 5 + "。" + "y" * 3 + "\n" + "z" * 11 + " tail words"
    cut = lambda t, *a: [(r.char_start, r.char_end, r.text) for r in C.boundary_chunks(frame(spark, [(1, t)], "id long, t string"), "id", "t", *a).orderBy("chunk_index").collect()]
    assert cut(first, 10, 3, 2)[:2] == [(0, 10, "xxxxx。yyy"), (10, 20, "z" * 10)]
    assert cut("a" * 9 + "。" + "b" * 4, 10, 0, 6) == [(0, 14, "a" * 9 + "。\n\n" + "b" * 4)]
    assert cut("a" * 9 + "。" + "b" * 8, 10, 0, 6) == [(0, 10, "a" * 9 + "。"), (10, 18, "b" * 8)] and cut("", 10, 2, 3) == cut(None, 10, 2, 3) == [] and cut("short", 10, 2, 6) == [(0, 5, "short")]
    assert cut("a" * 9 + "。" + "c" * 9 + "。" + "b" * 5, 10, 0, 6) == [(0, 10, "a" * 9 + "。"), (10, 20, "c" * 9 + "。"), (20, 25, "b" * 5)]  # too long together


def test_half_break_chunks_by_hand():
    assert C._half_break("\n a\n\n\n\nb ", 900, 120, 1) == [(0, 4, "a\n\nb")]
    assert C._half_break("x" * 5 + "。" + "y" * 9, 10, 2, 1) == [(0, 6, "xxxxx。"), (4, 14, "x。" + "y" * 8), (12, 15, "yyy")]  # a mark at half the size counts
    assert C._half_break("x" * 4 + "。" + "y" * 9, 10, 2, 1)[0] == (0, 10, "xxxx。yyyyy")


def test_half_break_indices_start_at_one(spark):
    got = C.half_break_chunks(frame(spark, [(1, "w " * 600), (2, "short"), (3, None)], "id long, t string"), "id", "t").collect()
    assert [(r.id, r.chunk_index) for r in got] == [(1, 1), (1, 2)]


def test_paragraph_chunks_by_hand(spark):
    """Paragraphs fill a chunk; the next begins with the last characters of the one before; strides neither give nor take any; what doesn't fit is cut off."""
    cut = lambda t, *a: [r.text for r in C.paragraph_chunks(frame(spark, [(1, t)], "id long, t string"), "id", "t", *a).orderBy("chunk_index").collect()]
    assert cut("\n\n".join(["a" * 50, "b" * 40, "c" * 30, "d" * 250, "e" * 5]), 100, 20, 10) == ["a" * 50 + "\n\n" + "b" * 40, "b" * 20 + "\n\n" + "c" * 30, "d" * 100, "d" * 100, "d" * 90]
    assert cut("a" * 20 + "\n \t\n" + "b" * 95 + "\n\n" + "c" * 3, 100, 20, 4) == ["a" * 20, "a" * 20 + "\n\n" + "b" * 78, "b" * 37 + "\n\nccc"]  # 20 + 2 + 95 is over 100: the rest has the carry too
    assert cut("d" * 101, 100, 20, 1) == ["d" * 100, "d" * 21] and cut("d" * 100, 100, 20, 1) == ["d" * 100] and cut("d" * 181, 100, 20, 1) == ["d" * 100, "d" * 100, "d" * 21]
    assert cut("x" * 150 + "\n\n" + "y" * 10, 100, 0, 1) == ["x" * 100, "x" * 50, "y" * 10] and cut("a b\n\n  c  ", 100, 20, 1) == ["a b\n\nc"]
    assert cut("", 100, 20, 10) == cut(None, 100, 20, 10) == cut(" \n\n ", 100, 20, 0) == []
    assert all(len(c) <= 800 for c in cut("\n\n".join("p" * (i * 37 % 700 + 1) for i in range(60)), 800, 120, 80))


def test_greedy_drops_by_kept_rows_only(spark):
    rows = [(1, "h1", "u1"), (2, "h1", "u2"), (3, "h3", "u2"), (4, None, "u1"), (5, None, "u9")]
    got = D.greedy(frame(spark, rows, "id long, h string, u string"), ["h", "u"], "id")
    assert sorted(r.id for r in got.collect()) == [1, 3, 5]  # 2 fell by 1's hash, so 3 may have its URL


def test_greedy_equals_going_through_the_rows(spark):
    rows = [(i, f"h{i * 7 % 23}", f"u{i * 11 % 31}") for i in range(120)]
    seen, want = (set(), set()), []
    for i, h, u in rows:
        if h not in seen[0] and u not in seen[1]:
            want.append(i)
            seen[0].add(h)
            seen[1].add(u)
    assert sorted(r.id for r in D.greedy(frame(spark, rows, "id long, h string, u string"), ["h", "u"], "id").collect()) == want


def test_simhash_is_what_it_says(spark):
    import hashlib

    texts = ["", "One two", "the quick brown fox jumps", "a b c d " * 30, None]

    def plain(t):
        w = (t or "").lower().split()
        runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [int.from_bytes(hashlib.blake2b(r.encode(), digest_size=8).digest(), "big") for r in runs]
        return f"{sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) >= len(h)):016x}"

    rows = D.simhash_blake(frame(spark, list(enumerate(texts)), "id long, t string"), "id", "t")
    got = {r.id: (r.simhash, r.n) for r in rows.select("id", "simhash", D.as_long(F.col("simhash")).alias("n")).collect()}
    assert got == {i: (plain(t), int(plain(t), 16) - (1 << 64) * (int(plain(t), 16) >> 63)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("most", [3, 5])
def test_near_pairs_equal_brute_force(spark, most):
    fps = [(i, ((i * 0x9E3779B97F4A7C15 + 7) & (2**64 - 1)) - 2**63) for i in range(60)]
    fps += [(100 + i, fps[i][1] ^ (1 << (i % 60)) ^ (1 << (i * 7 % 60)) ^ (1 << (i * 13 % 61))) for i in range(60)] + [(300, None), (301, fps[0][1])]
    got = {(r.a, r.b) for r in D.near_pairs(frame(spark, fps, "id long, fp long"), "id", "fp", most).collect()}
    bits = lambda x: (x & (2**64 - 1)).bit_count()
    assert got == {(a, b) for a, x in fps[:120] for b, y in fps[:120] if a < b and 0 < bits(x ^ y) <= most} and len(got) > 30


def test_ratio_pairs_equal_brute_force(spark):
    from difflib import SequenceMatcher

    base = ["Rules for the use of the library", "Opening hours of the dining hall", "ab", "a", "Exchange programme 2024 notice"]
    texts = [t[:k] + "x" * n + t[k + 1 :] for t in base for k, n in ((0, 0), (0, 1), (3, 1), (5, 2), (9, 3))] + [None, ""]
    rows = frame(spark, list(enumerate(texts)), "id long, t string")
    for least in (0.8, 0.94):
        want = {(i, j) for i, p in enumerate(texts) for j, q in enumerate(texts) if i != j and p and q and SequenceMatcher(None, p, q, autojunk=False).ratio() >= least}
        assert {(r.a, r.b) for r in D.ratio_pairs(rows, "id", rows, "id", "t", least).collect()} == want and want


def test_contamination_by_hand(spark):
    items = [(1, "The very same text stands there."), (2, "The SAME text, but for its marks"), (3, "An item of which some letters differ here"), (4, "nothing like it at all 12345"), (5, None)]
    docs = [(1, "The very same text stands there."), (7, "the same text but for its marks!"), (8, "An itxm of whixh some lettxrs diffxr herx"), (9, "An item of which some letters differ there"), (10, None)]
    got = {r.i: r for r in D.contamination(frame(spark, items, "i long, t string"), "i", frame(spark, docs, "d long, t string"), "d", "t", 0.80, 0.65).collect()}
    assert {i: (r.exact, r.normalised, r.match_id, r.contaminated) for i, r in got.items()} == {1: (True, True, 1, True), 2: (False, True, 7, True), 3: (False, False, 9, True), 4: (False, False, None, False), 5: (False, False, None, False)}
    only = D.contamination(frame(spark, items, "i long, t string"), "i", frame(spark, docs[2:3], "d long, t string"), "d", "t", 0.80, 0.65).where("i = 3").first()
    assert only.match_id == 8 and only.ratio >= 0.8 and only.jaccard < 0.65  # by the ratio alone


def test_copy_guard(spark):
    from sluice.operators import admission as A

    rows = [(1, "what is the capital of france", "What is the capital of France?"), (2, "what is the capital of france", "a text about quite other things"), (3, "alpha beta gamma delta", "delta and gamma then beta with alpha, in another order altogether"), (4, None, "x")]
    assert {r.id: r.copied for r in A.copy_guard(frame(spark, rows, "id long, a string, b string"), "a", "b").collect()} == {1: True, 2: False, 3: True, 4: False}


def test_best_overlap_equals_brute_force(spark):
    sets = [(i, [f"w{(i * j) % 17}" for j in range(1, 9)]) for i in range(30)]
    df = frame(spark, sets, "id long, tokens array<string>").withColumn("tokens", F.array_distinct("tokens"))
    got = {r.id: (r.match_id, r.jaccard) for r in D.best_overlap(df, "id", df.select(F.col("id").alias("o"), "tokens"), "o", 0.6).collect()}
    want = {}
    for i, a in sets:
        scored = sorted((-round(len(set(a) & set(b)) / len(set(a) | set(b)), 6), j) for j, b in sets)
        if -scored[0][0] >= 0.6:
            want[i] = (scored[0][1], -scored[0][0])
    assert got == want


def test_broken_html(spark):
    page = "<title>T</title><nav><p>menu</p></nav><script>var a='</p>'</script><article><h1>Head</h1><p>One <b>two<p>three &amp; four, which is a line of its own, and says so in a sentence.</article><a href='/f.pdf'>File</a>"
    r = P.extract(frame(spark, [(1, page), (2, None)], "id long, h string"), ["id"], "h").orderBy("id").collect()
    assert r[0].title == "Head" and r[0].plain_text == "three & four, which is a line of its own, and says so in a sentence." and r[0].method == "readability"  # the article is half short lines
    assert [tuple(x) for x in r[0].attachments] == [("File", "/f.pdf", "pdf")] and "menu" not in r[0].markdown and r[1].plain_text == ""


def test_the_best_container_is_taken(spark):
    line = "A sentence of the main text that is long enough to count as a paragraph."
    page = f"<html><body><article><p>Share this with your friends now</p></article><p>x</p><div class='detail extra'><p>{line}</p><p>{line}</p></div><p>y</p><div id='content'><p>No sentence that counts is in here</p></div><p>outside</p></body></html>"
    r = P.extract(frame(spark, [(1, page)], "id long, h string"), ["id"], "h").first()
    assert (r.method, r.selector) == ("generic_selector", ".detail") and r.quality["main_paragraph_count"] == 2
    bare = P.extract(frame(spark, [(1, f"<p>{line}</p><p>{line}</p><div class=nav>x</div>")], "id long, h string"), ["id"], "h").first()
    assert bare.method == "readability" and bare.quality["class"] == "thin_content"


def test_quality_classes(spark):
    para = "This is a whole sentence of more than forty letters, and it ends here."
    cases = {
        "list_page": ("\n".join(f"- item {i} of the list" for i in range(9)), "Index", "u"), "detail_content": ("\n".join([para] * 5), "Some page", "u"), "thin_content": (para, "Some page", "u"), "navigation_only": ("\n".join(["首页", "打印", "关闭"] * 5), "x", "u"),
        "template_polluted": (f"首页\n打印\n关闭\n{para}", "x", "u"), "extraction_failed": ("loading", "x", "u"),
    }
    rows = frame(spark, [(k, *v) for k, v in cases.items()], "want string, m string, t string, u string")
    assert [(r.want, r.got) for r in rows.select("want", P.quality(F.col("m"), F.col("t"), F.col("u"), F.lit(False))["class"].alias("got")).collect() if r.want != r.got] == []
    far = frame(spark, [("word without end " * 20,)], "m string").select(P.quality(F.col("m"), F.lit("Quite another title"), F.lit("/info/12.html"), F.lit(True))["class"]).first()[0]
    assert far == "detail_content"  # a long line counts, whatever its title


def test_page_classes(spark):
    para = "This is a whole sentence of more than forty letters, and it ends here."
    cases = {
        "list_page": ("x", "通知公告", "u"), "content_missing": ("loading", "A title that is long enough", "u"), "navigation_only": ("首页\n打印\n关闭", "x", "u"), "template_polluted": (f"{para}\n首页\n打印\nCopyright 2020\n友情链接", "x", "u"),
        "thin_content": (f"{para}", "x", "u"), "detail_content": ("\n".join([para] * 5), "x", "u"), "mixed_or_uncertain": (f"{para}\n" + "\n".join(["a few words more of it"] * 10), "x", "u"),
    }
    rows = frame(spark, [(k, *v) for k, v in cases.items()], "want string, m string, t string, u string")
    assert [(r.want, r.got) for r in rows.select("want", M.page_class(F.col("m"), F.col("t"), F.col("u"))["class"].alias("got")).collect() if r.want != r.got] == []


def test_crawl_state_retries_and_ends(spark, tmp_path):
    from sluice.streaming import ingest as I

    rows = [("a", "failed", 1), ("a", "failed", 2), ("a", "failed", 3), ("b", "failed", 1), ("b", "success", 2), ("b", "failed", 3), ("c", "duplicate", 1)]
    for n in (1, 2, 3):
        frame(spark, [r[:2] for r in rows if r[2] == n], "url string, outcome string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = I.run_once(I.crawl_state(spark.readStream.schema("url string, outcome string").parquet(str(tmp_path / "in"))), "update", f"file://{tmp_path}/s")
    seen = {}
    for r in out.collect():
        seen.setdefault(r.url, set()).add((r.status, r.retries))
    assert seen["a"] == {("pending", 1), ("pending", 2), ("failed", 3)} and ("success", 1) in seen["b"] and ("failed", 2) not in seen["b"] and seen["c"] == {("duplicate", 0)}


def test_dated_facts(spark):
    rows = [(1, "In 2025 we met; apply before 3-15 14:30, held on 2026-02-30 or 2026-04-01")]
    got = [(r.date.isoformat(), r.time, r.role) for r in P.dated_facts(frame(spark, rows, "id long, t string"), "id", "t").orderBy("at").collect()]
    assert got[0] == ("2025-03-15", "14:30", "deadline") and got[-1][0] == "2026-04-01" and len(got) == 2


def test_past_deadline(spark):
    rows = [(1, "deadline 2024-01-02"), (2, "published 2024-01-02"), (3, "until 2030-01-01"), (4, None)]
    got = {r.id: r.past_deadline for r in E.past_deadline(frame(spark, rows, "id long, t string"), "t", "2025-01-01").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_merge_adjacent_respects_both_limits(spark):
    rows = [("c", 0, 30), ("c", 33, 60), ("c", 62, 120), ("c", 140, 150)]
    got = sorted(tuple(r) for r in E.merge_adjacent(frame(spark, rows, "c string, start long, end long"), "c", 5, 100).collect())
    assert got == [("c", 0, 60, 2), ("c", 62, 120, 1), ("c", 140, 150, 1)]


def test_diverse_sample_spreads(spark):
    rows = [(i, "s", "a" if i < 90 else "b") for i in range(100)]
    got = S.diverse(frame(spark, rows, "id long, s string, f string"), "s", "id", ["f"], 6).collect()
    assert sorted(r.f for r in got) == ["a", "a", "a", "b", "b", "b"]


def test_supersession_drops_undated(spark):
    rows = [("a", "k", "2024-01-01"), ("b", "k", "2024-05-01"), ("c", "k", None), ("d", "m", None)]
    df = frame(spark, rows, "id string, k string, d string").withColumn("d", F.col("d").cast("date"))
    assert {r.id: r.superseded_by for r in D.superseded(df, "k", "d", "id").collect()} == {"a": "b", "b": None, "c": "b", "d": None}


def test_temporal_status_keeps_nulls(spark):
    rows = [(None, None), ("2030-01-01", None), (None, "2020-01-01"), ("2020-01-01", None)]
    df = frame(spark, rows, "e string, x string").select(F.col("e").cast("date").alias("e"), F.col("x").cast("date").alias("x"))
    assert [r[0] for r in df.select(M.temporal_status(F.col("e"), F.col("x"), "2025-01-01")).collect()] == ["unknown", "upcoming", "expired", "active"]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"a": 1}\n\n{"a": 2}\n', encoding="utf-8")
    assert sorted(r.a for r in R.jsonl(spark, str(tmp_path / "a.jsonl"), "a long").collect()) == [1, 2]
    assert R.jsonl(spark, str(tmp_path / "none.jsonl"), "a long").count() == 0
    (tmp_path / "a.csv").write_text('﻿x,y\n1,"two\nlines"\n', encoding="utf-8")
    assert R.csv(spark, str(tmp_path / "a.csv")).select("x", "y").first() == ("1", "two\nlines")
    (tmp_path / "a.md").write_text("---\ntitle: A: b\n---\nBody\n\n---\nSource: x\n", encoding="utf-8")
    row = R.markdown(spark, str(tmp_path / "a.md")).first()
    assert row.body == "Body" and row.meta == {"title": "A: b"}
    K.write_jsonl(spark.createDataFrame([(2, "b"), (1, None)], "z long, a string"), str(tmp_path / "out"), ["z"])
    assert spark.read.text(str(tmp_path / "out")).collect()[0][0] in ('{"a":null,"z":1}', '{"a":"b","z":2}')
    base = f"file://{tmp_path}/base"
    K.publish(spark, spark.range(3), base, "v1")
    with pytest.raises(Exception):
        K.publish(spark, spark.range(5).withColumn("b", F.raise_error(F.lit("no"))), base, "v2")
    assert K.served(spark.newSession(), base).count() == 3


def test_attachments(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="w"><w:p><w:t>Hello</w:t></w:p><w:p><w:t>there</w:t></w:p></w:d>')
    (tmp_path / "x.docx").write_bytes(buf.getvalue())
    (tmp_path / "y.docx").write_bytes(b"no zip")
    (tmp_path / "z.docx").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "p.pptx").write_bytes(K.office_file("pptx", [["one & <two>"], ["three"]])[:-40])
    (tmp_path / "q.pdf").write_bytes(K.office_file("pdf", [["a (b) c"], ["d\\e"]]))
    (tmp_path / "r.odt").write_bytes(b"other")
    got = {r.path[-6:]: (r.magic_ok, r.text, r.reason) for r in R.attachments(spark, str(tmp_path)).collect()}
    assert got == {"x.docx": (True, "Hello\nthere", None), "y.docx": (False, None, "WRONG_KIND"), "z.docx": (True, None, "BROKEN"), "p.pptx": (True, None, "BROKEN"), "/q.pdf": (True, "a (b) c\nd\\e", None), "/r.odt": (False, None, "NO_READER")}
    assert R.xlsx_rows(K.office_file("xlsx", [["a", ""], [], ["<b>", "c"]])) == [(1, ["a", ""]), (2, []), (3, ["<b>", "c"])] and R.xlsx_rows(b"PK\x03\x04") == []


def test_bundle_and_replay(spark):
    files, listed = frame(spark, [("a", "1"), ("b", "2")], "path string, sha256 string"), frame(spark, [("a", "1"), ("b", "9"), ("c", "3")], "path string, sha256 string")
    assert {tuple(r) for r in R.verify_bundle(files, listed).collect()} == {("b", "CHANGED"), ("c", "MISSING")}
    rows = frame(spark, [("u", 1, True), ("u", 2, False), ("v", 1, False), ("v", 2, False)], "url string, seq long, ok boolean")
    assert {(r.url, r.seq) for r in R.replay(rows, "url", "seq", "ok").collect()} == {("u", 1), ("v", 2)}


def test_header_search(spark):
    rows = [(1, ["title", None]), (2, ["id", "name"]), (3, ["1", "x"]), (4, [None, ""]), (5, ["2"])]
    got = [r.row for r in R.header_rows(frame(spark, rows, "n long, cells array<string>"), "n", "cells", "id").orderBy("n").collect()]
    assert got == [{"id": "1", "name": "x"}, {"id": "2", "name": None}]


@pytest.mark.parametrize("parts", [1, 13])
def test_partitions_dont_matter(spark, parts):
    from sluice.operators import search as Q

    docs = frame(spark, [(i, f"alpha beta {'gamma ' * (i % 4)} w{i}") for i in range(40)], "id long, text string").repartition(parts)
    q = frame(spark, [(1, "alpha gamma"), (2, "w7")], "q long, text string")
    got = [tuple(r) for r in Q.ranked(Q.bm25(q, "q", T.word_tokens(F.col("text")), docs, "id", T.word_tokens(F.col("text"))), "score", 5).orderBy("query_id", "rank").select("query_id", "rank", "id").collect()]
    assert got[:2] == [(1, 1, 3), (1, 2, 7)] and got[-1] == (2, 1, 7)


def test_required_points_arent_alike(spark):
    rows = [(1, "the fee is ten euros", 5.0), (1, "the fee is ten euro", 4.0), (1, "apply at the main office", 3.0)]
    got = sorted(tuple(r) for r in E.required_points(frame(spark, rows, "q long, s string, score double"), "q", "s", "score").collect())
    assert got == [(1, 1, "the fee is ten euros"), (1, 2, "apply at the main office")]


def test_chinese_lexicons(spark):
    from sluice.functions import lexicons as L

    rows = [("奖学金申请截止时间是什么时候", "研究生奖学金管理办法\n截止 2026年3月15日，费用 20 元，电话 62781234", "研究生奖学金管理办法")]
    r = frame(spark, rows, "q string, t string, title string").select(E.attributes(F.col("q"), E.patterns(L.ASKED)).alias("a"), E.attribute_values(F.col("t"), L.VALUES).alias("v"), M.content_kind(F.col("title"), F.col("t")).alias("k"), M.audiences(F.col("title"), F.col("t")).alias("w"), T.content_grams(F.col("q"), L.QUESTION_STOPS).alias("g")).first()
    assert r.a == ["DEADLINE"] and r.k == "policy" and r.w == ["研究生"] and "什么" not in r.g
    assert r.v["DEADLINE"] == ["2026年3月15日"] and r.v["PRICE"] == ["20 元"] and "62781234" in r.v["CONTACT"]


@pytest.mark.parametrize("parts", [1, 7])
def test_leaders_equal_the_join(spark, parts, monkeypatch):
    """The search that keeps leaders only gives what joining all postings gives, by either order; and so does what it falls back to."""
    from sluice.operators import search as Q

    docs = frame(spark, [(i, " ".join(f"t{(i * j) % 23}" for j in range(1, 4 + i % 9))) for i in range(200)] + [(900, ""), (901, None)], "id long, text string").repartition(parts)
    q = frame(spark, [(1, "t1 t2 t3 t3"), (2, "t5"), (3, "unknown"), (4, "t0 t7 t11 t13")], "q long, text string")
    tokens = F.coalesce(T.word_tokens(F.col("text")), F.array().cast("array<string>"))
    whole = Q.bm25(q, "q", tokens, docs, "id", tokens)
    for _ in range(2):
        some = Q.bm25_top(q, "q", tokens, docs, "id", tokens, 6, ("score", "matched"))
        for by in ("score", "matched"):
            row = lambda d: sorted((r.query_id, r["rank"], r.id, round(r.score, 5), r.matched) for r in Q.ranked(d, by, 6).collect())
            assert row(some) == row(whole)
        monkeypatch.setattr(Q, "QUERIES_A_PASS", 2)


def test_tfidf_leaders_equal_a_plain_reading(spark, monkeypatch):
    import math
    from collections import Counter

    from sluice.operators import search as Q

    docs = {i: f"doc {i * 7 % 11} abc{i % 3} déjà" for i in range(12)} | {50: "", 51: "zz"}
    items = {1: "abc1 déjà doc", 2: "doc 7", 3: ""}
    grams = lambda t: Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1))
    cf, df = Counter(), Counter()
    for t in docs.values():
        cf.update(grams(t))
        df.update(grams(t).keys())
    kept = set(sorted(cf, key=lambda g: (-cf[g], g.encode()))[:60])

    def weigh(t):
        w = {g: (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + df[g])) + 1) for g, n in grams(t).items() if g in kept}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / norm for g, x in w.items()}

    want = []
    for q, t in items.items():
        a = weigh(t)
        scores = sorted((-round(sum(x * weigh(d).get(g, 0) for g, x in a.items()), 6), i) for i, d in docs.items())
        want += [(q, k, i, -s) for k, (s, i) in enumerate([x for x in scores if x[0] < 0][:4], 1)]
    frames = frame(spark, list(items.items()), "q long, t string"), frame(spark, list(docs.items()), "id long, t string").repartition(3)
    for _ in range(2):
        got = Q.tfidf_top(frames[0], "q", frames[1], "id", "t", 4, max_features=60).collect()
        assert sorted((r.query_id, r["rank"], r.id, r.score) for r in got) == sorted(want)
        monkeypatch.setattr(Q, "QUERIES_A_PASS", 1)


def test_dense_search_in_blocks(spark, monkeypatch):
    import numpy as np

    from sluice.operators import search as Q

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    df = frame(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(99, None)], "id long, v array<float>").repartition(3)
    want = []
    for q in range(20):
        s = np.round(x.astype(float) @ x[q].astype(float), 6)
        want += [(q, k, int(i), float(s[i])) for k, i in enumerate(np.lexsort((np.arange(60), -s))[:5], 1)]
    for most in (4096, 7):
        monkeypatch.setattr(Q, "QUERIES_A_PASS", most)
        got = Q.dense_search(df.where("id < 20"), "id", df, "id", "v", 5).collect()
        assert sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in got) == sorted((q, k, i, round(s, 6)) for q, k, i, s in want)
    assert Q.dense_search(df.limit(0), "id", df, "id", "v", 5).count() == 0


def test_callables_take_the_place_of_models(spark):
    from sluice.operators import search as Q

    pairs = frame(spark, [(1, i, "ab", "x" * i) for i in range(5)] + [(2, 9, "q", None)], "query_id long, id long, q string, t string")
    got = [tuple(r) for r in Q.rerank(pairs, "q", "t", lambda a, b: [len(y) % 3 for y in b], [F.asc("id")], 2, most=2).select("query_id", "rank", "id").orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2), (1, 2, 1), (2, 1, 9)]
    v = Q.encode(frame(spark, [("a",), (None,)], "t string"), "t", lambda xs: [[3.0 * len(x), 4.0 * len(x)] for x in xs], prefix="p: ")
    assert [[round(x, 5) for x in r.embedding] for r in v.collect()] == [[0.6, 0.8]] * 2
    out = Q.answer(frame(spark, [(1,)], "id long"), lambda q: q.withColumn("plan", F.lit("p")), lambda p: p.withColumn("hit", F.lit(7)), lambda p, h: h.select("id", F.lit("READY").alias("gate")), lambda p, h, g: h.join(g, "id"))
    assert tuple(out.first()) == (1, "p", 7, "READY")


def test_results_are_kept_for_a_while(spark):
    from sluice.operators.rounds import ResultCache

    now, made = [0.0], []
    cache = ResultCache(300, 2, lambda: now[0])
    make = lambda k: lambda: made.append(k) or spark.range(1)
    for k, t in (("a", 0), ("a", 200), ("b", 210), ("a", 290), ("a", 301), ("c", 302), ("b", 303)):
        now[0] = t
        cache.get(k, make(k))
    assert made == ["a", "b", "a", "c", "b"]


def plan_words():
    from sluice.operators.planning import Lexicon

    return Lexicon(
        {"校园卡": ("一卡通", "饭卡")}, {"校园生活": ("校园卡", "宿舍", "一卡通"), "教务": ("选课", "转系")}, ("怎么办", "补办", "同时"), ("补办", "申请", "校园卡"), ("如何", "怎么", "材料", "申请"), ((("材料",), "需要提交的材料"), (("怎么", "补办"), "的办理步骤和官方入口")),
        "的办理说明和官方入口", ("现在", "最新"), (("本科", "本科生"), ("研究生", "研究生")), "（规范术语：{}）", "、",
    )


def test_plans_of_han_queries(spark):
    from sluice.operators import planning as PL

    rows = [(1, "图书馆在哪", None), (2, "一卡通丢了怎么补办，需要什么材料", None), (3, "本科选课；同时 申请宿舍", None), (4, "图书馆在哪", "full"), (5, "  ", None)]
    got = {r.id: r for r in PL.plan_queries(frame(spark, rows, "id long, q string, f string"), "id", "q", plan_words(), "f").collect()}
    assert set(got) == {1, 2, 3, 4} and (got[1].path, got[1].subqueries, got[1].reasons) == ("FAST", ["图书馆在哪"], [])
    assert got[2].path == "FULL" and got[2].terms == ["校园卡"] and got[2].rewritten.endswith("（规范术语：校园卡）") and got[2].subqueries == ["校园卡需要提交的材料", "校园卡的办理步骤和官方入口"] and "actionable_procedure" in got[2].reasons
    assert got[3].subqueries == ["本科选课", "申请宿舍"] and got[3].topics == ["校园生活", "教务"] and got[3].audience == ["本科生"] and got[3].reasons == ["actionable_procedure", "complex_intent_marker", "cross_topic"]
    assert got[4].path == "FULL" and got[4].reasons == ["user_selected_full"] and got[4].subqueries == ["图书馆在哪"]


def test_subjects_and_nearness(spark):
    rows = [
        (1, "校园卡丢了怎么办", "校园卡管理", "校园卡遗失后请挂失", True), (2, "校园卡丢了怎么办", "校园卡管理", "校园卡" + "字" * 130 + "挂失", False), (3, "奖学金如何申请", "住宿办法", "宿舍与住宿", False), (4, "奖学金如何申请", "研究生奖学金", "奖学金办法", False),
        (5, "研究生奖学金如何申请", "研究生奖学金", "奖学金办法", True), (6, "图书馆开放时间", "图书馆", "周一至周五", True),
    ]
    df = frame(spark, rows, "i long, q string, t string, x string, want boolean").withColumn("got", E.core_relevant(F.col("q"), F.col("t"), F.col("x")))
    assert [r.i for r in df.collect() if r.got != r.want] == []


def test_metadata_of_pages_and_titles(spark):
    page = """<head><meta content='2024/3/5 08:00' NAME="PubDate"><meta property="og:title" content="Open title"><meta name=author content="x"><meta name="department" content="Office"></head><h1>H</h1>"""
    label = "<title>t &lt;</title><script>发布时间 2001-01-01</script><p>发布时间：2023年4月7日</p>"
    got = [tuple(r.m) for r in frame(spark, [(page,), (label,), ("",)], "h string").select(M.html_metadata(F.col("h")).alias("m")).collect()]
    assert got[0] == ("Open title", "2024-03-05", None, "Office") and got[1][1:] == ("2023-04-07", None, None) and got[2] == (None, None, None, None)
    row = frame(spark, [("http://a.lib.example.edu.cn/x", "教务通知：选课与宿舍", "正文提到就业", "cat")], "u string, t string, x string, c string")
    r = row.select(M.department(F.col("u"), F.col("t"), {"lib.example.edu.cn": "Library"}).alias("d"), M.department(F.lit("http://z.org"), F.col("t"), {}).alias("e"), M.authority(F.col("u"), F.lit(False), ("example.edu.cn",)).alias("a"), M.authority(F.lit("http://b.gov.cn"), F.lit(False), ("x.org",)).alias("b"), M.topics(F.col("c"), F.col("t"), F.col("x"), of_category={"cat": "毕业"}).alias("p")).first()
    assert tuple(r) == ("Library", "教务处", "official", "authoritative_external", ["教务", "校园生活", "毕业", "就业"])


def test_private_pages_of_han_texts(spark):
    from sluice.functions.privacy import private_reason

    rows = [("http://h/my/x", "t", "x", "private_url"), ("http://h/a", "我的成绩单", "x", "private_word:我的"), ("http://h/a", "t", "姓名：张三，学号：20231234", "private_value:5"), ("http://h/a", "t", "身份证号: 110101199001011234", "private_value:1"), ("http://h/a", "通知", "公开内容", None)]
    df = frame(spark, rows, "u string, t string, x string, want string").withColumn("got", private_reason(F.col("u"), F.col("t"), F.col("x")))
    assert [(r.want, r.got) for r in df.collect() if r.want != r.got] == []


def test_learned_gate(spark):
    rows = [(i, *[float((i * k) % 7) for k in range(1, 15)], float(i % 3), i % 3) for i in range(90)]
    df = frame(spark, rows, "id long, " + ", ".join(f"{f} double" for f in E.FEATURES) + ", label int")
    got = E.learned_gate(df.where("id < 60"), df.where("id >= 60"), "label", 0.5, trees=16).collect()
    assert sum(r.decision == ("INSUFFICIENT", "PARTIAL", "SUFFICIENT")[r.label] for r in got) >= 27


def test_gold_labels(spark):
    from sluice.operators import judging as J

    rows = [(["P1"], [], ["P1"], [], "NOT_SUPPORTED"), (["P1", "P2"], ["P1"], ["P2"], [], "PARTIAL"), (["P1", "P2"], ["P1", "P2"], [], [], "SUPPORTED"), *[(["P1", "P2"], ["P1"], ["P2"], [c], "NOT_SUPPORTED") for c in ("entity", "numeric", "temporal", "negation", "wrong_attribute", "ood")]]
    df = frame(spark, rows, "r array<string>, s array<string>, u array<string>, c array<string>, want string").withColumn("got", J.gold_label(F.col("r"), F.col("s"), F.col("u"), F.col("c")))
    assert [tuple(r) for r in df.collect() if r.want != r.got] == []


def test_completions_keep_their_tokens(spark):
    from sluice.operators import judging as J

    f = lambda p, c, n: frame(spark, [(p, c)], "p array<int>, c array<int>").select(J.completion_feature(F.col("p"), F.col("c"), n).alias("f")).first().f
    a = f([1, 2, 3], [7, 8], 4)
    assert (a.input_ids, a.labels, a.context_truncated, a.answer_truncated) == ([2, 3, 7, 8], [-100, -100, 7, 8], True, False)
    assert f([1, 2], [5, 6, 7], 2).input_ids == [5, 6] and f([1], [], 4) is None and f([], [4], 4).labels == [4]


def test_office_files_are_sound_packages():
    for kind in ("docx", "xlsx", "pptx"):
        body = K.office_file(kind, [["a & b"], ["the end"]])
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            assert z.testzip() is None and "[Content_Types].xml" in z.namelist()
        assert "a & b" in R.office_text(kind, body) and "THE END" in R.office_text(kind, K.changed_file(kind, body, "the end", "THE END"))
    with pytest.raises(ValueError):
        K.changed_file("pdf", b"%PDF", "a", "b")


def test_cited_sentences_by_hand(spark):
    """Headings are carried, fences and rules left out, long sentences parted at commas and packed."""
    text = "intro one。intro two；\r\n# Head A\n```\ncode。here\n```\n- item one！  item two\n---\n**Bold head**\n* starred\n\n**" + "b" * 31 + "** tail。\n####\nafter an empty heading"
    one = lambda t, **k: [(r.heading, r.text) for r in frame(spark, [(1, t)], "id long, t string").select(C.cited_sentences(F.col("t"), **k).alias("u")).first().u]
    assert one(text) == [("", "intro one。"), ("", "intro two；"), ("Head A", "item one！"), ("Head A", "item two"), ("Bold head", "starred"), ("Bold head", "**" + "b" * 31 + "** tail。"), ("", "after an empty heading")]
    parts = ["a" * 200 + "，", "b" * 129 + ",", "c" * 10 + "，", "d" * 340 + "，", "e"]
    assert one("".join(parts)) == [("", parts[0] + parts[1][:0] + parts[1]) if len(parts[0] + parts[1]) <= 330 else ("", parts[0])] + ([] if len(parts[0] + parts[1]) <= 330 else [("", parts[1] + parts[2])]) + [("", parts[3]), ("", parts[4])]
    assert one("x" * 400) == [("", "x" * 400)] and one(("y" * 99 + "， ") * 4) == [("", ("y" * 99 + "，") * 3), ("", "y" * 99 + "，")]
    assert one("") == one(None) == one("# only\n\n---") == []


def test_cited_spans_by_hand(spark):
    rows = [(1, "# Fees\nFees are 5.\nPay now.\n# Hours\nPay now.\nOpen late."), (2, None), (3, "x")]
    out = C.cited_spans(frame(spark, rows, "id long, t string"), "id", "t", F.lower, 2, 8, 30, ".", ",")
    got = [(r.id, r.span_no, r.sentence_start, r.sentence_end, r.span) for r in out.orderBy("id", "span_no").collect()]
    assert got == [
        (1, 1, 0, 0, "Fees are 5."), (1, 2, 0, 1, "Fees are 5.Pay now."), (1, 3, 1, 1, "Fees：Pay now."), (1, 4, 1, 2, "Fees：Pay now.Pay now."), (1, 5, 2, 2, "Hours：Pay now."), (1, 6, 2, 3, "Hours：Pay now.Open late."), (1, 7, 3, 3, "Hours：Open late."),
    ]
    same = C.cited_spans(frame(spark, [(1, "Same thing.\nsame THING.\nother one.")], "id long, t string"), "id", "t", F.lower, 1, 1, 99, ".", ",").collect()
    assert [(r.span_no, r.sentence_start) for r in same] == [(1, 0), (2, 2)]


def test_training_sentences_by_hand(spark):
    text = "# Title\n\n学生 申请 办理时应当在系统内提交全部规定的材料并等待审核结果。太短申请。" + "申请" + "1" * 11 + "这里的数字太多所以不能用于训练这个句子要够长。电话：申请办理时应当在系统内提交全部规定的材料并等待。没有任何信号的句子虽然足够长但是不应该出现在这里面的啊。"
    got = frame(spark, [(1, text), (2, None)], "id long, t string").select("id", C.training_sentences(F.col("t")).alias("s")).orderBy("id").collect()
    assert got[0].s == ["学生申请办理时应当在系统内提交全部规定的材料并等待审核结果。"] and got[1].s == []


def test_like_pairs_equal_brute_force(spark, monkeypatch):
    """Titles with letters changed, left out and put in; all runs meet in one pass, and in several."""
    import difflib
    import random

    rng = random.Random(5)
    words = ["the", "tion", "and", "ing", "ñez", "läch", "of", "re", "字"]
    texts = {" ".join(rng.choices(words, k=rng.randrange(2, 30))) for _ in range(60)}
    for t in sorted(texts):
        for _ in range(2):
            u = list(t)
            for _ in range(rng.randrange(1, 2 + len(u) // 12)):
                i = rng.randrange(len(u))
                u[i : i + rng.randrange(2)] = rng.choice(["", "x", "e"])
            texts.add("".join(u))
    texts = sorted(t for t in texts if t)
    rows = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "")], "id long, text string")
    want = {(i, j) for i, p in enumerate(texts) for j, q in enumerate(texts) if i != j and difflib.SequenceMatcher(None, p, q, autojunk=False).ratio() >= 0.94}
    assert want and {(r.a, r.b) for r in D.like_pairs(rows, "id", "text", 0.94).collect()} == want
    monkeypatch.setattr(D, "LETTERS_A_PASS", 6_000)
    monkeypatch.setattr(D, "RUN_TEXTS", 20)
    assert {(r.a, r.b) for r in D.like_pairs(rows, "id", "text", 0.94).collect()} == want
