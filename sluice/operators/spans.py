"""Where spans of evidence stand in whole texts, the units of support that they make, and markers of references set behind them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .batches import map_batches
from .chunking import canonical
from .rounds import keep

#: Characters of needles that one automaton holds; more of them take further passes over the texts.
HELD = 8_000_000
#: Marks that end a sentence and belong to a span that they follow, and marks beside which a span is one of whole sentences.
ENDS, BESIDE = "。！？.!?;；", "\n\r。！？.!?;；:：>*#"
PLACED = "start long, end long, occurrences long, reasons array<string>, raw string, normalized string"


def needles_of(pairs: list[tuple[int, str]]) -> ahocorasick.Automaton | None:
    """One automaton of (number, needle); numbers of equal needles share a place in it."""
    by: dict[str, list[int]] = {}
    for i, needle in pairs:
        if needle:
            by.setdefault(needle, []).append(i)
    if not by:
        return None
    automaton = ahocorasick.Automaton()
    for needle, numbers in by.items():
        automaton.add_word(needle, (len(needle), numbers))
    automaton.make_automaton()
    return automaton


def occurrences(automaton: ahocorasick.Automaton | None, text: str) -> dict[int, tuple[int, int, int]]:
    """{number: (start, end, how often)} of the needles in a text, from one walk: where each stands first, and how often without overlaps, from the left."""
    out: dict[int, list[int]] = {}
    for last, (n, numbers) in automaton.iter(text) if automaton is not None else ():
        start = last + 1 - n
        for i in numbers:
            got = out.get(i)
            if got is None:
                out[i] = [start, last + 1, 1, last + 1]
            elif start >= got[3]:
                got[2], got[3] = got[2] + 1, last + 1
    return {i: (s, e, k) for i, (s, e, k, _) in out.items()}


def widened(raw: str, start: int, end: int) -> tuple[int, set[str]]:
    """(end, reasons) of a span of a raw text: a mark that ends the sentence is taken in, and whether whole sentences stand there is told."""
    reasons = set()
    if raw[end : end + 1] and raw[end] in ENDS:
        end += 1
        reasons.add("TRAILING_BOUNDARY_EXPANDED")
    before, behind = raw[:start].rstrip()[-1:], raw[end:].lstrip()
    whole = (not before or before in BESIDE) and (not behind or raw[end - 1] in BESIDE)
    reasons.add("SENTENCE_BOUNDARY_VALIDATED" if whole else "PARTIAL_SENTENCE_BOUNDARY")
    return end, reasons


def placed(raw: str, source: list[int], did: list[str], asked: list[str], start: int, end: int, times: int) -> dict:
    """A span found in canonical text, as one of the raw text. `source` tells where each canonical character came from."""
    first, last, why = source[start], source[end - 1] + 1, {*did, *asked} or {"EXACT_TEXT"}
    last, more = widened(raw, first, last)
    span = raw[first:last]
    return {"start": first, "end": last, "occurrences": times, "reasons": sorted(why | more), "raw": span, "normalized": canonical(span)[0]}


def _blocks(needles: DataFrame) -> Iterator[list[tuple]]:
    """The needles (needle_id, needle), by blocks of `HELD` characters at most; a block at a time reaches the driver."""
    rows = keep(needles.withColumn("n", F.char_length("needle")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    k = -(-5 * total // (4 * HELD))  # by hash, so that blocks differ a little
    for b in range(k):
        part = rows if k == 1 else rows.where(F.pmod(F.xxhash64("needle_id", "needle"), F.lit(k)) == b)
        yield [(r["needle_id"], r["needle"]) for r in part.select("needle_id", "needle").toLocalIterator()]


def locate_needles(docs: DataFrame, id_col: str, text_col: str, needles: DataFrame, needle_id: str, needle: str, exact: bool = False) -> DataFrame:
    """(id, needle_id, start, end, occurrences, reasons, raw, normalized) of every text and needle that stands in it.

    Both count in canonical form (links' labels, no tags, white space folded, compatibility forms), unless `exact`; offsets are those of the raw text. A span takes in the mark that ends its sentence.
    One automaton of all needles is walked once a text, so thousands of needles take one pass, and texts don't move; needles of more than `HELD` characters together take further passes. Needles that are
    empty or null are nowhere; null texts hold none; texts are read whole.
    """
    doc, item = docs.schema[id_col].dataType.simpleString(), needles.schema[needle_id].dataType.simpleString()
    asked = needles.select(F.col(needle_id).alias("needle_id"), F.col(needle).alias("needle")).where(F.char_length("needle") > 0)
    spark, out = docs.sparkSession, None
    for block in _blocks(asked):
        forms = [(n, []) if exact else canonical(n)[::2] for _, n in block]
        shared = spark.sparkContext.broadcast(([i for i, _ in block], forms))

        def run(batches, shared=shared):
            ids, forms = shared.value
            automaton = needles_of(list(enumerate(f for f, _ in forms)))
            for b in batches:
                rows = []
                for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if raw is None:
                        continue
                    text, source, did = (raw, None, []) if exact else canonical(raw)
                    for i, (s, e, k) in sorted(occurrences(automaton, text).items()):
                        span = {"start": s, "end": e, "occurrences": k, "reasons": ["EXACT_TEXT"], "raw": raw[s:e], "normalized": raw[s:e]} if exact else placed(raw, source, did, forms[i][1], s, e, k)
                        rows.append({id_col: doc_id, needle_id: ids[i]} | span)
                    if len(rows) >= 1_000:
                        yield from pa.Table.from_pylist(rows, schema).to_batches()
                        rows = []
                if rows:
                    yield from pa.Table.from_pylist(rows, schema).to_batches()

        kinds = f"`{id_col}` {doc}, `{needle_id}` {item}, {PLACED}"
        schema = _arrow(docs, id_col, needles, needle_id)
        found = map_batches(docs.select(id_col, text_col), run, kinds)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"`{id_col}` {doc}, `{needle_id}` {item}, {PLACED}")


def _arrow(docs: DataFrame, id_col: str, needles: DataFrame, needle_id: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = lambda d, c: to_arrow_type(d.schema[c].dataType)
    return pa.schema([(id_col, kind(docs, id_col)), (needle_id, kind(needles, needle_id)), ("start", pa.int64()), ("end", pa.int64()), ("occurrences", pa.int64()), ("reasons", pa.list_(pa.string())), ("raw", pa.string()), ("normalized", pa.string())])


def _weak(text: str, least: int) -> bool:
    """Whether a span says too little: marks only, or less than `least` characters besides white space and punctuation."""
    plain = canonical(text)[0]
    if all(c.isspace() or unicodedata.category(c)[0] in "PS" for c in plain):
        return True
    return sum(not c.isspace() and not unicodedata.category(c).startswith("P") for c in plain) < least


def support_spans(spans: DataFrame, chunks: DataFrame, least: int = 6) -> DataFrame:
    """Every span of evidence with what becomes of it: where it stands in its chunk, or `excluded`, the first reason that holds.

    spans: (query, point, status, span_id, chunk_id, source_id, text). chunks: (query, chunk_id, source_id, text), what was retrieved for each query. Reasons, in this order: EVIDENCE_NOT_SUPPORTED (of the point),
    CHUNK_NOT_IN_RETRIEVAL, SOURCE_ID_MISMATCH, SPAN_INVALID (null), SPAN_TOO_WEAK (a title, marks only, or under `least` characters), SPAN_NOT_FOUND, DUPLICATE_SUPPORT (the point has the
    unit from a span with a smaller id).
    """
    held = chunks.select("query", "chunk_id", F.col("source_id").alias("of"), F.col("text").alias("chunk_text"), F.lit(True).alias("known"))
    rows = spans.join(held, ["query", "chunk_id"], "left")
    known = F.coalesce("known", F.lit(False))
    first = (
        F.when(~F.col("status").isin("SUPPORTED", "PARTIALLY_SUPPORTED"), "EVIDENCE_NOT_SUPPORTED").when(~known, "CHUNK_NOT_IN_RETRIEVAL").when(~F.col("of").eqNullSafe(F.col("source_id")), "SOURCE_ID_MISMATCH").when(F.col("text").isNull(), "SPAN_INVALID")
        .when(F.endswith("span_id", F.lit("#TITLE")), "SPAN_TOO_WEAK")
    )
    rows = rows.withColumn("excluded", first)
    told = rows.select("query", "point", "span_id", "chunk_id", "source_id", "text", "excluded", F.when(F.col("excluded").isNull(), F.col("chunk_text")).alias("chunk_text"))
    told = told.sortWithinPartitions("chunk_id")  # spans of a chunk follow each other, so that it is made canonical once
    kinds = {k: told.schema[k].dataType.simpleString() for k in ("query", "point", "chunk_id", "source_id")}
    schema = f"query {kinds['query']}, point {kinds['point']}, span_id string, chunk_id {kinds['chunk_id']}, source_id {kinds['source_id']}, text string, excluded string, place struct<start:bigint,end:bigint,occurrences:bigint,reasons:array<string>,raw:string,normalized:string>"
    place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("occurrences", pa.int64()), ("reasons", pa.list_(pa.string())), ("raw", pa.string()), ("normalized", pa.string())])

    def find(batches):
        last, form = None, None
        for b in batches:
            why, where = b.column(6).to_pylist(), []
            for i, (text, raw) in enumerate(zip(b.column(5).to_pylist(), b.column(7).to_pylist())):
                got = None
                if why[i] is None:
                    if form is None or raw != last:
                        last, form = raw, canonical(raw)
                    needle, _, asked = canonical(text)
                    at = form[0].find(needle) if needle else -1
                    if _weak(text, least):
                        why[i] = "SPAN_TOO_WEAK"
                    elif at < 0:
                        why[i] = "SPAN_NOT_FOUND"
                    else:
                        got = placed(raw, form[1], form[2], asked, at, at + len(needle), form[0].count(needle))
                where.append(got)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(why, pa.string()), pa.array(where, place)], ["query", "point", "span_id", "chunk_id", "source_id", "text", "excluded", "place"])

    rows = map_batches(told, find, schema)
    again = F.row_number().over(W.partitionBy("query", "point", "chunk_id", "place.start", "place.end", "place.normalized").orderBy("span_id")) > 1
    rows = rows.withColumn("excluded", F.when(F.col("excluded").isNull() & again, "DUPLICATE_SUPPORT").otherwise(F.col("excluded")))
    return rows.select("query", "point", "span_id", "chunk_id", "source_id", "text", "excluded", "place.*")


def support_units(spans: DataFrame) -> DataFrame:
    """The units of `support_spans`: of each query, a row for each (chunk, start, end, text) with its points, spans and wordings, in the order of points and spans."""
    unit = ["query", "chunk_id", "source_id", "start", "end", "normalized"]
    each = F.array_sort(F.collect_list(F.struct("point", "span_id", "text")))  # of one query's few points
    rows = spans.where("excluded is null").groupBy(*unit).agg(each.alias("s"), F.first("raw").alias("span_text"), F.first("reasons").alias("reasons"), F.first("occurrences").alias("occurrences"))
    of = lambda k: F.transform("s", lambda x: x[k])
    return rows.select(*unit, "span_text", "reasons", "occurrences", of("point").alias("points"), of("span_id").alias("span_ids"), of("text").alias("wordings"))


def numbered(claims: DataFrame, key: str, order: list[str], sources: str) -> DataFrame:
    """(key, source, number): a number from 1 for each source of a text, by its first use; claims come in `order`, and the sources of a claim in theirs."""
    used = claims.select(key, *order, F.posexplode(sources).alias("_i", "source"))
    first = used.groupBy(key, "source").agg(F.min(F.struct(*order, "_i")).alias("_at"))
    return first.select(key, "source", F.row_number().over(W.partitionBy(key).orderBy("_at")).alias("number"))


def marked(text: Column, edits: Column) -> Column:
    """A text with markers set in: edits are structs of (at, mark), `at` in characters. From the last to the first, so that places stay what they were; marks at one place stand in the order of their letters."""
    last = F.array_sort(edits, lambda a, b: F.when(a["at"] != b["at"], F.when(a["at"] > b["at"], -1).otherwise(1)).when(a["mark"] > b["mark"], -1).when(a["mark"] < b["mark"], 1).otherwise(0))
    put = lambda t, e: F.concat(F.substring(t, F.lit(1), e["at"].cast("int")), e["mark"], F.substring(t, e["at"].cast("int") + 1, F.char_length(t)))
    return F.aggregate(last, text, put)


def cited_texts(texts: DataFrame, key: str, text_col: str, claims: DataFrame, order: str, end: str, sources: str, name: Callable[[Column], Column], heading: str = "\n\n参考资料：\n") -> DataFrame:
    """(key, cited, references): each text with [n] behind each claim that has sources, numbers in rising order, and a list of references below.

    claims: (key, order, end, sources), `end` where the claim ends in the text. name: what a reference is called, by its source. Texts without a source stay as they are; claims without one get no marker.
    """
    numbers = numbered(claims, key, [order], sources)
    used = claims.select(key, order, F.col(end).alias("at"), F.explode(F.array_distinct(sources)).alias("source")).join(numbers, [key, "source"])
    marks = used.groupBy(key, order).agg(F.first("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_set("number")), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "").alias("mark"))
    edits = marks.groupBy(key).agg(F.collect_list(F.struct("at", "mark")).alias("edits"))  # of one text's claims
    refs = numbers.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("number", "source"))).alias("references"))
    rows = texts.select(key, F.col(text_col).alias("t")).join(edits, key, "left").join(refs, key, "left")
    below = F.array_join(F.transform("references", lambda r: F.concat(F.lit("["), r["number"].cast("string"), F.lit("] "), name(r["source"]))), "\n")
    cited = F.when(F.col("edits").isNull(), F.col("t")).otherwise(F.concat(marked(F.col("t"), F.col("edits")), F.lit(heading), below))
    none = F.filter(F.array(F.lit(None).cast(numbers.schema["source"].dataType)), lambda x: F.lit(False))
    return rows.select(key, cited.alias("cited"), F.coalesce(F.transform("references", lambda r: r["source"]), none).alias("references"))
