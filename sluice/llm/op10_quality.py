"""Quality by a factorisation machine.

Inputs are hashed words, statistics of structure and metadata (the length); a low-rank factor for each input gives all pairwise interactions,
summed in linear time by (sum v x)^2 - sum (v x)^2. It is fitted, on the driver, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, held_out, map_arrow, sample_at_most, table, utf8

BUCKETS = 1 << 15
FACTORS = 6
MEMO = 150_000
LETTERS = bytes(b for b in range(256) if b >= 128 or chr(b).isalpha())
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
STATS = 16


def statistics(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """What the form of a text says, whatever its words are: sizes, repetition, letters, symbols and lines."""
    n, size = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = size - len(text.translate(None, LETTERS))
    marks = len(text.translate(None, LETTERS + DIGITS + b" \n\t\r"))
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(bytes.__eq__, words, words[1:]))
    tails = Counter(w[-1:] for w in words if not w[-1:].isalnum() and w[-1] < 128)
    odd = sum(c for w, c in tails.items() if w not in (b".", b",", b";", b":", b'"', b"'", b")", b"?"))
    return [
        np.log1p(len(words)), np.log1p(len(text)), letters / size, marks / size, (size - len(text.translate(None, UPPER))) / size, (size - len(text.translate(None, DIGITS))) / size,
        len(counts) / n, (pairs + 1) / n, same / n, max(counts.values(), default=0) / n, odd / n, text.count(b"|") / n, len(set(lines)) / max(1, len(lines)), len(lines) / n, sum(map(len, words)) / n / 10, (text.count(b"!") + text.count(b"?")) / n,
    ]


class Inputs:
    """Hashed words and statistics of texts."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[float]]:
        words = text.split()
        counts = Counter(text.lower().split())
        stats = statistics(text, words, counts)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        at = []
        for w in counts:
            i = memo.get(w)
            if i is None:
                i = memo[w] = xxhash.xxh64_intdigest(w, 10) % BUCKETS
            at.append(i)
        x = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
        return np.array(at, np.int32), x / max(1e-9, float(np.sqrt((x * x).sum()))), stats


def gather(texts: list[bytes], inputs: Inputs, scale: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs' numbers, values, where each text starts, raw statistics); statistics are inputs beyond the words' if `scale` is known."""
    got = [inputs.of(t) for t in texts]
    stats = np.array([g[2] for g in got], np.float64).reshape(-1, STATS)
    scaled = np.clip((stats - scale[0]) / scale[1], -4, 4) / 4 if scale else np.zeros_like(stats)
    own = np.arange(BUCKETS, BUCKETS + STATS, dtype=np.int32)
    at = np.concatenate([y for g in got for y in (g[0], own)])
    x = np.concatenate([y for i, g in enumerate(got) for y in (g[1], scaled[i].astype(np.float32))])
    starts = np.cumsum([0] + [len(g[0]) + STATS for g in got])[:-1]
    return at, x, starts, stats


class Machine:
    """w0 + <w, x> + pairwise interactions of rank `factors`, through a logistic link."""

    def __init__(self, inputs: int = BUCKETS + STATS, factors: int = FACTORS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = 0.0, np.zeros(inputs, np.float32), rng.normal(0, 0.02, (inputs, factors)).astype(np.float32)

    def margins(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        return self.w0 + np.add.reduceat(self.w[at] * x, starts) + 0.5 * ((sums * sums) - np.add.reduceat(vx * vx, starts, axis=0)).sum(1), sums

    def fit(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.15, decay: float = 1e-5, seed: int = 6) -> None:
        """Adagrad on the logistic loss; rows in a seeded order."""
        rng, ends = np.random.default_rng(seed), np.append(starts[1:], len(at))
        share = float(np.clip(y.mean(), 0.01, 0.99))
        self.w0, g0, gw, gv = float(np.log(share / (1 - share))), 1e-6, np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(starts))
            for s in range(0, len(order), batch):
                rows = order[s : s + batch]
                n = ends[rows] - starts[rows]
                pick = np.repeat(starts[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
                i, xi, own = at[pick], x[pick], np.repeat(np.arange(len(rows)), n)
                z, sums = self.margins(i, xi, np.cumsum(n) - n)
                e = ((1 / (1 + np.exp(-z)) - y[rows]) / len(rows)).astype(np.float32)
                d0 = float(e.sum())
                g0 += d0 * d0
                self.w0 -= rate * d0 / g0**0.5
                ex = e[own] * xi
                keys, inverse = np.unique(i, return_inverse=True)
                dw = np.bincount(inverse, ex, len(keys)).astype(np.float32) + decay * self.w[keys]
                full = ex[:, None] * (sums[own] - self.v[i] * xi[:, None])
                dv = np.stack([np.bincount(inverse, full[:, f], len(keys)) for f in range(full.shape[1])], 1).astype(np.float32) + decay * self.v[keys]
                gw[keys] += dw * dw
                gv[keys] += dv * dv
                self.w[keys] -= rate * dw / np.sqrt(gw[keys])
                self.v[keys] -= rate * 0.3 * dv / np.sqrt(gv[keys])


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, y) of a bounded sample of the labelled rows outside the held-out third. Rows of one doc_id count once, by their least label and text."""
    rows = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    rows = sample_at_most(rows.withColumnRenamed("doc_id", "label_id"), "label_id", most)
    rows = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("label_id"))  # `most` rows at most
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).select("text", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 10_000) -> tuple[Machine, tuple[np.ndarray, np.ndarray]] | None:
    """A machine and the scale of its statistics; None without labels. most bounds the labelled rows that it is fitted on."""

    def features(batches):
        inputs = Inputs()
        for b in by_bytes(batches, "text"):
            got = [inputs.of(t) for t in utf8(b.column(0))]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32())), pa.array([g[2] for g in got], pa.list_(pa.float64()))], ["y", "at", "x", "stats"])

    t = map_arrow(labelled(docs, labels, label, most), features, "y int, at array<int>, x array<float>, stats array<double>").toArrow().combine_chunks()
    if not t.num_rows:
        return None
    y = t.column("y").to_numpy().astype(np.float32)
    stats = t.column("stats").combine_chunks().flatten().to_numpy().reshape(-1, STATS)
    scale = stats.mean(0), stats.std(0) + 1e-3
    scaled = (np.clip((stats - scale[0]) / scale[1], -4, 4) / 4).astype(np.float32)
    lists, values = t.column("at").combine_chunks(), t.column("x").combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    at, x = np.empty(int(n.sum()) + STATS * len(n), np.int32), np.empty(int(n.sum()) + STATS * len(n), np.float32)
    starts = np.cumsum(n + STATS) - (n + STATS)
    own = np.repeat(starts, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at[own], x[own] = lists.flatten().to_numpy(), values.flatten().to_numpy()
    tail = (starts + n)[:, None] + np.arange(STATS)
    at[tail], x[tail] = BUCKETS + np.arange(STATS), scaled
    machine = Machine()
    machine.fit(at, x, starts, y)
    return machine, scale


def score_quality(df: DataFrame, id_col: str, text_col: str, model, carry: list[str] | None = None) -> DataFrame:
    """`carry` columns (the id, if None) and score: how likely label 1 is.

    Null texts are empty; repeated rows score alike; columns that bear inner names don't clash; without a model all score 0.5; an empty table gives no rows.
    """
    carry = [id_col] if carry is None else carry
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{text_col}`").alias("text"))
    kinds = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))

    def run(batches):
        inputs = Inputs()
        for b in by_bytes(batches, "text"):
            if model is None:
                p = np.full(b.num_rows, 0.5)
            else:
                at, x, starts, _ = gather(utf8(b.column(len(carry))), inputs, model[1])
                p = 1 / (1 + np.exp(-np.clip(model[0].margins(at, x, starts)[0].astype(np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(p)], [*[f"c{i}" for i in range(len(carry))], "score"])

    return map_arrow(rows, run, f"{kinds}, score double").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "score")


def op10_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the whole `documents` by a machine fitted on labelled rows outside the held-out third. No SQL: it is a trained model; tests measure it on held-out labels.
    Null and empty texts have a score too; repeated rows score alike.
    """
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    out = score_quality(docs, "doc_id", "text", model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
