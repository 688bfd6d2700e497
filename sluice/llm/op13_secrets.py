"""Secret scans over an incremental ledger of blobs.

A text is a blob, named by the SHA-256 of its UTF-8 bytes, however many paths and versions hold it. The ledger is a table in the shared folder with a row for each blob of each scan: the rules,
each with its version, that looked at it, and what they found. A scan takes only the (blob, rule and version) pairs that the ledger lacks, reads each such blob once, and adds a batch;
a batch is one write, so it is there whole or not at all, and a scan that was lost is simply made again. Findings are joined back to all paths.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, cut, map_arrow, shared_dir, spread_join, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `group` of a match has to have `least` characters; matches are leftmost and don't overlap. A changed pattern asks for a new version."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    #: Texts without any of these (in lower case, where `fold`) hold no match.
    hints: tuple[str, ...] = ()
    fold: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def finder(self) -> Callable[[str, str], Iterable[tuple[int, int]]]:
        """A function of (text, lower-cased text) that yields the spans in code points."""
        search = re.compile(self.pattern, re.ASCII).finditer

        def find(text: str, low: str):
            seen = low if self.fold else text
            if self.hints and not any(h in seen for h in self.hints):
                return
            for m in search(text):
                if m.end(self.group) - m.start(self.group) >= self.least:
                    yield m.span()

        return find


def either(word: str) -> str:
    """A pattern for the word with ASCII letters of either case, and no other letters that fold to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is long enough is the same match as a run of any length that is kept when long enough.
BASE = (
    Rule("assign", 1, ASSIGN, 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key"), True),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", hints=("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
#: Kinds that the base lacks: private keys, signed tokens, tokens of code hosts and chats, bearer headers, credentials in addresses.
MORE = (
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", hints=("PRIVATE KEY-----",)),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyJ",)),
    Rule("host", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("bearer", 1, r"\b" + either("bearer") + r"\x20+([A-Za-z0-9._~+/=-]{16,})", hints=("bearer",), fold=True),
    Rule("url", 1, r"\b[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{3,64}@", hints=("://",)),
)
RULES = BASE + MORE
FOUND = "array<struct<rule: string, start: int, end: int>>"


class Ledger:
    """The scans of a folder in the shared storage: `batch=<n>` of (blob, rules, found)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self) -> DataFrame:
        """(blob, rules, found, batch); no rows before the first scan."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        schema = f"blob binary, rules array<string>, found {FOUND}, batch int"
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.folder).parquet(self.folder)

    def scan(self, rows: DataFrame, blobs: DataFrame, rules: Iterable[Rule] = RULES) -> None:
        """Add a batch with what the ledger lacks of (blob, rule and version).

        rows: (place, blob, text), any number of rows for a blob. blobs: (blob, place, often), the place of each where it is to be read, and whether so many rows share this place
        that they would be too many for a task; such places are fewer than a thousand.
        """
        rules = tuple(rules)
        wanted = F.array(*[F.lit(r.name) for r in rules])
        known = self.read().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"))  # a short name for each rule and version that there ever was
        unseen = blobs.join(known, "blob", "left").withColumn("rules", F.array_except(wanted, F.coalesce("rules", F.array().cast("array<string>"))))
        unseen = unseen.where(F.size("rules") > 0)
        unseen = cut(unseen)
        # each text goes to where its row of the ledger is made; small rows are hashed, texts aren't sorted
        todo = rows.join(unseen.where("not often").drop("often").hint("shuffle_hash"), ["place", "blob"]).select("blob", "rules", "text")
        often = unseen.where("often").drop("often")
        if often.take(1):  # of repeated rows, one text leaves each task
            again = rows.join(F.broadcast(often), ["place", "blob"]).groupBy("blob").agg(F.first("rules").alias("rules"), F.first("text").alias("text"))
            todo = todo.unionByName(again)

        def run(batches):
            finders = {r.name: r.finder() for r in rules}
            for b in by_bytes(batches, "text"):
                out = []
                for names, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    low = text.lower()
                    out.append([{"rule": n, "start": s, "end": e} for n in names for s, e in finders[n](text, low)])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))], ["blob", "rules", "found"])

        found = map_arrow(todo, run, f"blob binary, rules array<string>, found {FOUND}")
        last = self.read().agg(F.max("batch")).first()[0]
        found.write.parquet(f"{self.folder}/batch={0 if last is None else last + 1}")

    def findings(self, rules: Iterable[Rule] = RULES) -> DataFrame:
        """(blob, found): what these rules, in these versions, found in each blob that they saw and found something in."""
        now = [F.lit(r.name) for r in rules]
        told = self.read().select("blob", F.filter("found", lambda x: x["rule"].isin(*now)).alias("found")).where(F.size("found") > 0)
        return told.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))  # a row a batch, so few; a repeated row is read twice


def scan_secrets(df: DataFrame, path_cols: list[str], text_col: str, rules: tuple[Rule, ...] = RULES, folder: str | None = None) -> DataFrame:
    """`path_cols`, blob and found (rule, start, end; by start, end, then rules in their order): all rows of the input, each a version of a path, with what stands in its text.

    folder: of the ledger; a new one if None. Only blobs and rule versions that it lacks are scanned. Null texts count as empty; an empty text is a blob like others; texts are scanned
    whole, however long, one at a time. Rows of one path and repeated rows stay as many rows as they are; columns besides, whatever their names, play no part. An empty table gives no rows.
    Spans are code points, the end exclusive.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    blob = F.unhex(F.sha2(text, 256))
    rows = df.select(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(path_cols)], text.alias("text"), blob.alias("blob"))
    place = F.xxhash64(*[f"p{i}" for i in range(len(path_cols))], "blob")
    paths = cut(rows.withColumn("place", place).drop("text"))
    places = paths.groupBy("blob", "place").agg(F.count("*").alias("n"))
    counts = cut(places.groupBy("blob").agg(F.min(F.struct("n", "place")).alias("first"), F.sum("n").alias("n")))
    per = max(1_000, (counts.agg(F.sum("n")).first()[0] or 0) // 1_000)
    ledger = Ledger(spark, folder or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.scan(rows.withColumn("place", place).select("place", "blob", "text"), counts.select("blob", "first.place", (F.col("first.n") > per).alias("often")), rules)
    facts = counts.select("blob", "n").join(ledger.findings(rules), "blob")
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    sort = F.transform(F.array_sort(F.transform("found", lambda x: F.struct(x["start"], order[x["rule"]].alias("at"), x["end"], x["rule"]))), lambda x: F.struct(x["rule"], x["start"], x["end"]))
    out = spread_join(paths, facts, "blob", "n", F.col("place"))
    return out.select(*[F.col(f"p{i}").alias(c) for i, c in enumerate(path_cols)], "blob", F.coalesce(sort, F.array().cast(FOUND)).alias("found"))


def op13_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of `documents`, scanned once a blob into a new ledger, joined back to all documents: base kinds counted and digested, and all spans.

    Null texts are empty, and empty ones hold nothing; equal texts are one blob, however many rows have it; repeated rows stay; very long texts are scanned whole; an empty table gives
    no rows; columns besides play no part.
    """
    found = scan_secrets(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    base = [r.name for r in BASE]
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.split_part(x["rule"], F.lit("@"), F.lit(1)), x["start"], x["end"])), ",")
    of = lambda *names: F.filter("found", lambda x: x["rule"].isin(*names))
    counts = [F.size(of(r.name)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(of(*base)), 256).alias("base_sha256"), listed("found").alias("spans"))


def _sql() -> str:
    """Matches and what lies between them, in turn, give the offsets."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = " union all ".join(
        f"select doc_id, {i} k, '{r.kind}' kind, regexp_extract_all(t, {quote(r.pattern)}) m, regexp_extract_all(t, {quote(r.pattern)}, {r.group}) g, regexp_split_to_array(t, {quote(r.pattern)}) b, {r.least} least from docs" for i, r in enumerate(RULES)
    )
    return f"""with docs as (select doc_id, coalesce(text, '') t from documents), kinds as ({kinds}),
marks as (select doc_id, k, kind, i, m, g, least, (list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint s from kinds, unnest(range(1, len(m) + 1)) t(i)),
spans as (select doc_id, k, kind, s, s + length(m[i]) e from marks where length(g[i]) >= least),
told as (select doc_id, {", ".join(f"count(*) filter (k = {i}) n_{r.kind}" for i, r in enumerate(BASE))}, string_agg(concat_ws(':', kind, s, e), ',' order by s, k) spans,
  string_agg(concat_ws(':', kind, s, e), ',' order by s, k) filter (k < {len(BASE)}) base from spans group by doc_id)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::bigint n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from docs left join told using (doc_id)"""


SQL = _sql()
