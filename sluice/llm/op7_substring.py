"""Exact repeats of `window` words, found by fixed-block anchors.

Each document is cut into non-overlapping blocks of window // 2 words, which are indexed; every rolling window of that many
words, of every document, probes the index. A repeat of `window` words holds a whole block wherever it starts, so it has a hit
by a probe in one document and on a block of the other. Hits are then extended: each run of words about a hit is hashed in all its windows of
`window` words, these are compared by 96 bits of hash, and neighbouring repeats join to maximal ones. Of 1e13 windows, some two of a thousand
corpora would have one pair of unlike windows with equal hashes; words themselves never move.

Rows that move are packed: a slab of documents sends each bucket one binary row. What two documents of a slab share is a hit without asking, and
the slab sends two of its blocks and two of its probes on for all of them; so a passage that very many documents hold costs a bucket a few numbers a slab.
Probes are salted as well, and the index, a small part of them, is copied to each salt. Of the windows about hits, a slab sends on only
those of its least document, as the others are repeats already. What a task holds is the index of a bucket; probes stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, cut, map_arrow, parts, table, utf8, words_of

SLAB_BYTES = 6 << 20
SALTS = 2
ROWS = "part int, salt int, kind int, payload binary"
HITS, DOCS, WINDOWS, RESULTS, LOCAL = range(5)  # positions come before what they are looked up in
ROOT = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(m)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[list[bytes]]) -> np.ndarray:
    h = xxhash.xxh64_digest
    return np.frombuffer(b"".join([h(w) for words in texts for w in words]), "<u8")


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of h[i : i + n] for each i; of no meaning for the last n - 1."""
    acc, have, power, width, left = None, 0, h, 1, n
    while left:
        if left & 1:
            acc, have = (power, width) if acc is None else (acc[: len(acc) - width] * np.uint64(pow(ROOT, width, 1 << 64)) + power[have : have + len(acc) - width], have + width) if len(acc) > width else (acc[:0], n)
        left >>= 1
        if left:
            if len(power) <= width:
                return np.zeros(len(h), np.uint64)
            power, width = power[:-width] * np.uint64(pow(ROOT, width, 1 << 64)) + power[width:], 2 * width
    out = np.zeros(len(h), np.uint64)
    out[: len(acc)] = mixed(acc)
    return out


def pack(runs: list[np.ndarray], owner: np.ndarray, fields: list[np.ndarray]) -> bytes:
    """`fields` of equal length, by byte planes, and `runs` of values that hold for each stretch of equal `owner`."""
    first = np.concatenate(([0], np.nonzero(np.diff(owner))[0] + 1)) if len(owner) else np.empty(0, np.int64)
    counts = np.diff(np.concatenate((first, [len(owner)])))
    out = [np.array([len(owner), len(first)], "<u4").tobytes(), counts.astype("<u4").tobytes()]
    out += [np.ascontiguousarray(r[owner[first]]).tobytes() for r in runs]
    out += [np.ascontiguousarray(f).view(np.uint8).reshape(len(f), -1).T.tobytes() for f in fields]
    return b"".join(out)


def unpack(b: bytes, runs: int, types: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(the runs' values, repeated; the fields) of what `pack` made."""
    n, m = (int(x) for x in np.frombuffer(b, "<u4", 2))
    at = 8
    counts = np.frombuffer(b, "<u4", m, at)
    at += 4 * m
    owners = []
    for _ in range(runs):
        owners.append(np.repeat(np.frombuffer(b, "<i8", m, at), counts))
        at += 8 * m
    out = []
    for t in types:
        w = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(b, np.uint8, n * w, at).reshape(w, n).T).view(t).reshape(-1))
        at += n * w
    return owners, out


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint16 if buckets < 65536 else np.uint32)


def dealt(part: np.ndarray, count: int, kind: int, salts: list[int], runs: list[np.ndarray], owner: np.ndarray, fields: list[np.ndarray]) -> Iterator[tuple]:
    """Packed rows of each part, in the order given within it; a copy for each salt."""
    order = np.argsort(part, kind="stable")
    full, starts = np.unique(part[order], return_index=True)
    for p, s, e in zip(full.tolist(), starts, [*starts[1:], len(order)]):
        at = order[s:e]
        b = pack(runs, owner[at], [f[at] for f in fields])
        yield from ((p, salt, kind, b) for salt in salts)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    part, salt, kind, payload = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(salt, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["part", "salt", "kind", "payload"])


def batches_of(rows: Iterator[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[3])
        if size >= most:
            yield batch_of(held)
            held, size = [], 0
    if held:
        yield batch_of(held)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        part, salt, kind = (b.column(i).to_pylist() for i in range(3))
        for i in range(b.num_rows):
            yield part[i], salt[i], kind[i], b.column(3)[i].as_py()


def shuffled(df: DataFrame, salts: int = 1) -> DataFrame:
    """A partition for each part and salt, so that no two large ones share a task by chance."""
    return df.repartitionById(parts(df) * salts, F.col("part") * salts + F.col("salt")).sortWithinPartitions("part", "salt", "kind")


def flat(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, position in it) of each word."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    return doc, np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def ends_of(run: np.ndarray) -> np.ndarray:
    """Which places are the first or the last of their run of equal values."""
    if not len(run):
        return np.empty(0, bool)
    change = run[1:] != run[:-1]
    return np.concatenate(([True], change)) | np.concatenate((change, [True]))


def met_here(h: np.ndarray, doc: np.ndarray, is_block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(what two documents of the slab share, blocks to send on, probes to send on), as masks; documents ascend."""
    shared, blocks, probes = (np.zeros(len(h), bool) for _ in range(3))
    if not len(h):
        return shared, blocks, probes
    order = np.argsort(h, kind="stable")
    change = np.concatenate(([True], np.diff(h[order]) != 0))
    run = np.cumsum(change) - 1
    starts = np.nonzero(change)[0]
    d = doc[order]
    many = (d[starts] != d[np.append(starts[1:], len(d)) - 1])[run]
    shared[order] = many
    probes[order] = ~many | ends_of(run)
    at = is_block[order]
    blocks[order[at]] = ~many[at] | ends_of(run[at])
    return shared, blocks, probes


def probe_rows(batches: Iterator[pa.RecordBatch], block: int, buckets: int) -> Iterator[tuple]:
    """Blocks and probes of (uid, text) rows, and hits that need no asking."""
    salt = TaskContext.get().partitionId() if TaskContext.get() else 0
    local = _Out(buckets, LOCAL)
    for b in by_bytes(batches, "text", SLAB_BYTES):
        uid = b.column(0).to_numpy()
        words = [words_of(t) for t in utf8(b.column(1))]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        h = rolling(word_hashes(words), block)
        del words
        doc, pos = flat(lengths)
        at = np.nonzero(pos + block <= lengths[doc])[0]
        h, doc, pos = h[at], doc[at].astype(np.int32), pos[at].astype("<u4")
        part, rest = bucket_of(h, buckets), (h & np.uint64(0xFFFFFFFF)).astype("<u4")
        shared, blocks, probes = met_here(h, doc, pos % block == 0)
        yield from local.add(uid[doc[shared]], pos[shared])
        yield from dealt(part[blocks], buckets, HITS, list(range(SALTS)), [uid], doc[blocks], [rest[blocks], pos[blocks]])
        yield from dealt(part[probes], buckets, DOCS, [salt % SALTS], [uid], doc[probes], [rest[probes], pos[probes]])
        salt += 1
    yield from local.flush()


class _Out:
    """Positions of documents, packed for the part that the document belongs to; with the documents' keys, if they are given."""

    def __init__(self, docs_parts: int, kind: int, most: int = 400_000):
        self.parts, self.kind, self.most, self.held, self.n = docs_parts, kind, most, [], 0

    def add(self, uid: np.ndarray, pos: np.ndarray, *key: np.ndarray) -> Iterator[tuple]:
        self.held.append((uid, *key, pos))
        self.n += len(uid)
        if self.n >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if self.n:
            *names, pos = (np.concatenate(x) for x in zip(*self.held))
            order = np.lexsort((pos, *names[::-1]))
            names, pos = [x[order] for x in names], pos[order]
            first = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in names], axis=0)))
            yield from dealt(np.mod(names[0], self.parts).astype(np.uint32), self.parts, self.kind, [0], [x[first] for x in names], np.cumsum(first) - 1, [pos.astype("<u4")])
        self.held, self.n = [], 0


def hit_rows(rows: Iterator[tuple], docs_parts: int) -> Iterator[tuple]:
    """Positions of probes and blocks that meet one of another document; rows come by bucket and salt, blocks first."""
    out = _Out(docs_parts, HITS)
    bucket, index, blocks = None, None, []

    def build():
        rest = np.concatenate([x[0] for x in blocks]) if blocks else np.empty(0, "<u4")
        pos = np.concatenate([x[1] for x in blocks]) if blocks else np.empty(0, "<u4")
        uid = np.concatenate([x[2] for x in blocks]) if blocks else np.empty(0, "<i8")
        order = np.argsort(rest, kind="stable")
        rest, pos, uid = rest[order], pos[order], uid[order]
        keys, starts = np.unique(rest, return_index=True)
        if not len(keys):
            return None
        own = np.repeat(np.arange(len(keys)), np.diff(np.concatenate((starts, [len(rest)]))))
        least, most = np.full(len(keys), 1 << 62, np.int64), np.full(len(keys), -(1 << 63), np.int64)
        return keys, np.minimum.reduceat(uid, starts), np.maximum.reduceat(uid, starts), least, most, own, pos, uid

    def end():
        if index is not None:
            _, _, _, least, most, own, pos, uid = index
            met = (most[own] > -(1 << 63)) & ((least[own] != uid) | (most[own] != uid))
            yield from out.add(uid[met], pos[met])

    for part, salt, kind, payload in rows:
        if kind == LOCAL:
            yield part, 0, HITS, payload
            continue
        if (part, salt) != bucket:
            yield from end()
            bucket, index, blocks = (part, salt), None, []
        (uid,), (rest, pos) = unpack(payload, 1, ["<u4", "<u4"])
        if kind == HITS:
            blocks.append((rest, pos, uid))
            continue
        if index is None:
            index, blocks = build(), []
            if index is None:
                continue
        keys, lo, hi, least, most, *_ = index
        at = np.searchsorted(keys, rest)
        at[at == len(keys)] = 0
        met = np.nonzero(keys[at] == rest)[0]
        at, uid, pos = at[met], uid[met], pos[met]
        np.minimum.at(least, at, uid)
        np.maximum.at(most, at, uid)
        other = (lo[at] != uid) | (hi[at] != uid)
        yield from out.add(uid[other], pos[other])
    yield from end()
    yield from out.flush()


def ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def un_ipc(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


def doc_rows(batches: Iterator[pa.RecordBatch], docs_parts: int) -> Iterator[tuple]:
    """Whole rows, packed for the part of their uid."""
    for b in by_bytes(batches, "text", SLAB_BYTES):
        part = np.mod(b.column(0).to_numpy(), docs_parts)
        order = np.argsort(part, kind="stable")
        full, starts = np.unique(part[order], return_index=True)
        t = b.take(pa.array(order))
        for p, s, e in zip(full.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
            yield p, 0, DOCS, ipc(t.slice(s, e - s))


def finished(t: pa.Table, words: list[list[bytes]], gone: list[np.ndarray | None], with_text: bool) -> bytes:
    """Result rows: the columns of `t` with counts, the digest of the kept words and, if asked for, the text that is left."""
    n = [len(w) for w in words]
    removed = [0 if g is None else int(g.sum()) for g in gone]
    sha, left = [], []
    for text, w, g, k in zip(t.column("text").to_pylist(), words, gone, removed):
        kept = b" ".join(w if not k else [x for x, d in zip(w, g.tolist()) if not d])
        sha.append(hashlib.sha256(kept).hexdigest())
        left.append(kept.decode() if k else text)
    t = t.drop_columns(["uid", "key", "text"])
    if with_text:
        t = t.append_column("text", pa.array(left, pa.string()))
    t = t.append_column("n_words", pa.array(n, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64())).append_column("kept_sha256", pa.array(sha, pa.string()))
    return ipc(t.combine_chunks().to_batches()[0])


def by_doc_part(rows: Iterator[tuple], keyed: bool = False) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """(rows, positions of each) for packed rows that come by part, positions first. A row has those of its uid and, if positions bear it, its key."""
    part, found, held = None, [], None
    for p, _, kind, payload in rows:
        if p != part:
            part, found, held = p, [], None
        if kind == HITS:
            names, (x,) = unpack(payload, 1 + keyed, ["<u4"])
            found.append((*names, x))
            continue
        if held is None:
            held = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * (2 + keyed)
            order = np.argsort(held[0], kind="stable")
            held, found = [x[order] for x in held], []
        t = un_ipc(payload)
        uid = t.column("uid").to_numpy()
        lo, hi = np.searchsorted(held[0], uid, "left"), np.searchsorted(held[0], uid, "right")
        pos = [held[-1][a:b].astype(np.int64) for a, b in zip(lo, hi)]
        if keyed:
            pos = [x[held[1][a:b] == k] for x, a, b, k in zip(pos, lo, hi, t.column("key").to_numpy())]
        yield t, pos


def taken(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which windows, of equal (a, b) if equal, a smaller document has too."""
    order = np.lexsort((key, b, a))
    sa, sb, sk = a[order], b[order], key[order]
    first = np.concatenate(([True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])))
    out = np.empty(len(a), bool)
    out[order] = sk > sk[first][np.cumsum(first) - 1]
    return out


def window_rows(rows: Iterator[tuple], window: int, buckets: int, most: int = 600_000) -> Iterator[tuple]:
    """For `buckets` of windows and as many parts of documents: hashes of the windows about hits, but for those that are known repeats."""
    block = window // 2
    held, n, out = [], 0, _Out(buckets, HITS)

    def flush():
        nonlocal held, n
        a, b, pos, uid, key = (np.concatenate([x[i] for x in held]) for i in range(5))
        again = taken(a, b, key)
        yield from out.add(uid[again], pos[again], key[again])
        a, b, pos, uid, key = (x[~again] for x in (a, b, pos, uid, key))
        owner = np.concatenate(([0], np.cumsum((uid[1:] != uid[:-1]) | (key[1:] != key[:-1]))))
        at = np.concatenate(([0], np.nonzero(np.diff(owner))[0] + 1))
        yield from dealt(bucket_of(a, buckets), buckets, WINDOWS, [0], [uid[at], key[at]], owner, [a, b, pos])
        held, n = [], 0

    for t, found in by_doc_part(rows):
        words = [words_of(x) for x in utf8(t.column("text").combine_chunks())]
        uid = t.column("uid").to_numpy()
        some = [i for i in range(len(words)) if len(found[i]) and len(words[i]) >= window]
        if not some:
            continue
        lengths = np.array([len(words[i]) for i in some], np.int64)
        starts = np.cumsum(lengths) - lengths
        turns = np.zeros(int(lengths.sum()) + 1, np.int64)
        for k, i in enumerate(some):
            p = found[i]
            a, b = np.maximum(p - (window - block), 0), np.minimum(p, lengths[k] - window)
            ok = a <= b
            np.add.at(turns, starts[k] + a[ok], 1)
            np.add.at(turns, starts[k] + b[ok] + 1, -1)
        at = np.nonzero(np.cumsum(turns)[:-1] > 0)[0]
        if not len(at):
            continue
        h = rolling(word_hashes([words[i] for i in some]), block)
        doc, pos = flat(lengths)
        x, y = h[at], h[at + window - block]
        a, b = mixed(x * np.uint64(ROOT) + y), (mixed(x + y * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype("<u4")
        held.append((a, b, pos[at].astype("<u4"), uid[some][doc[at]], t.column("key").to_numpy()[some][doc[at]]))
        n += len(at)
        if n >= most:
            yield from flush()
    if n:
        yield from flush()
    yield from out.flush()


def repeat_rows(rows: Iterator[tuple], docs_parts: int) -> Iterator[tuple]:
    """Positions of windows that a smaller document has too; rows come by bucket."""
    out = _Out(docs_parts, HITS)
    bucket, held = None, []

    def end():
        if held:
            uid, key, a, b, pos = (np.concatenate([x[i] for x in held]) for i in range(5))
            again = taken(a, b, key)
            yield from out.add(uid[again], pos[again], key[again])

    for part, salt, kind, payload in rows:
        if kind == HITS:
            yield part, salt, kind, payload
            continue
        if part != bucket:
            yield from end()
            bucket, held = part, []
        (uid, key), (a, b, pos) = unpack(payload, 2, ["<u8", "<u4", "<u4"])
        held.append((uid, key, a, b, pos))
    yield from end()
    yield from out.flush()


def result_rows(rows: Iterator[tuple], window: int, with_text: bool) -> Iterator[tuple]:
    """Results of documents, the positions of their repeated windows first."""
    for t, found in by_doc_part(rows, keyed=True):
        words = [words_of(x) for x in utf8(t.column("text").combine_chunks())]
        gone = []
        for i, w in enumerate(words):
            turns = np.zeros(len(w) + 1, np.int64)
            p = np.unique(found[i])
            turns[p] += 1
            turns[p + window] -= 1
            gone.append(np.cumsum(turns)[:-1] > 0 if len(p) else None)
        yield 0, 0, RESULTS, finished(t, words, gone, with_text)


def drop_repeats(df: DataFrame, id_col: str, text_col: str, window: int = 50, carry: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """Each row's `carry` columns (all, if None, but the text), its text without repeated words, and n_words, n_removed and kept_sha256.

    A word goes if it lies in `window` consecutive words that also start in a row with a smaller id; windows are judged on the input. What repeats
    within one row only stays. The text of a row that loses words is its kept words, joined by one space; others stay as they are. Null texts have no words; a null id counts as smaller than
    all others, and rows of one id don't take words from each other. An empty table gives no rows.
    """
    block, n = window // 2, parts(df)
    carry = [c for c in df.columns if c != text_col] if carry is None else carry
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 62)))
    rows = df.select(F.xxhash64(key, F.col(f"`{text_col}`")).alias("uid"), key.alias("key"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    types = {c: df.schema[c].dataType.simpleString() for c in carry}

    def stage(source: DataFrame, f) -> DataFrame:
        return map_arrow(source, lambda batches: batches_of(f(batches)), ROWS)

    probes = stage(rows.select("uid", "text"), lambda b: probe_rows(b, block, n))
    hits = cut(stage(shuffled(probes, SALTS), lambda b: hit_rows(rows_of(b), n)))
    windows = stage(shuffled(stage(rows.select("uid", "key", "text"), lambda b: doc_rows(b, n)).unionByName(hits)), lambda b: window_rows(rows_of(b), window, n))
    again = cut(stage(shuffled(windows), lambda b: repeat_rows(rows_of(b), n)))
    done = stage(shuffled(stage(rows, lambda b: doc_rows(b, n)).unionByName(again)), lambda b: result_rows(rows_of(b), window, with_text))
    names = [f"c{i}" for i in range(len(carry))]
    schema = ", ".join([*[f"{c} {types[o]}" for c, o in zip(names, carry)], *(["text string"] if with_text else []), "n_words long", "n_removed long", "kept_sha256 string"])
    wide = map_arrow(done, lambda batches: (x for _, _, _, payload in rows_of(batches) for x in un_ipc(payload).to_batches()), schema)
    return wide.select(*[F.col(c).alias(o) for c, o in zip(names, carry)], *([F.col("text").alias(text_col)] if with_text else []), "n_words", "n_removed", "kept_sha256")


def op7_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`drop_repeats` of the whole `documents`, windows of 50 words. No SQL: hashing every window of every text is too slow there; tests compare it with going through all
    windows. Null and empty texts have no words, so n_removed is 0; repeated rows of one id keep what they share; a very long text is a slab by
    itself, so a task's memory holds the longest text; an empty table gives no rows; columns besides, whatever their names, play no part.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeats(docs, "doc_id", "text", 50, ["doc_id"], with_text=False)
