"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The frequent words of the corpus are compiled into one automaton that shares suffixes; each edge bears how many words precede it, so a
walk sums to the word's number, and a table holds that word's ids. The file lies in the shared folder and workers map it into memory. A word that
the automaton lacks is merged exactly. Which words it holds affects the time only, never a result.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import json
import mmap
import struct
import unicodedata
import uuid
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, cut, map_arrow, shared_dir, table, worker_cache

#: What the tokeniser takes for white space.
BLANK = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pattern of the public vocabulary's pre-tokeniser.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
#: The same with the tokeniser's white space.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{BLANK}\p{{L}}\p{{N}}]+"
MEMO = 200_000
#: Characters of whole texts whose results a worker remembers, for copies.
COPIES = 2_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary as the tokenizers library's JSON states it."""

    def __init__(self, spec: dict):
        model = spec["model"]
        steps = [*(spec["normalizer"] or {}).get("normalizers", []), *(spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        patterns = [s["pattern"].get("Regex") for s in steps if "pattern" in s]
        if [s["type"] for s in steps] != STEPS or patterns != [r"\s+", PATTERN] or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
            raise ValueError("this vocabulary normalises or cuts texts in another way than the operator does")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.rules[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.letters = byte_letters()
        self.words = regex.compile(WORDS)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # each letter is lower-cased by itself, so no sigma becomes a final one
            text = text.replace("Σ", "σ")
        return self.words.findall(text.lower())

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token: the rule of least rank first, the leftmost of its places first."""
        letters = [self.letters[b] for b in word.encode()]
        letters[-1] += self.suffix
        ids = [self.ids[x] for x in letters if x in self.ids]
        return self._short(ids) if len(ids) <= 32 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        rule, none = self.rules.get, (1 << 30, -1)
        ranks = [rule(p, none) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) is not none and best[1] >= 0:
            i = ranks.index(best)
            ids[i : i + 2] = (best[1],)
            del ranks[i]
            if i:
                ranks[i - 1] = rule((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rule((ids[i], ids[i + 1]), none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*self.rules[p], i) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.rules]
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or self.rules.get((ids[i], ids[j]), (0, -1))[1] != new:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) >= 0 and (rule := self.rules.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (rule[0], a, rule[1]))
        return [x for x in ids if x >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)


def compile_lexicon(words: Iterable[str], voc: Vocabulary) -> bytes:
    """The automaton over the UTF-8 bytes of `words`, as a file: states' first edges, whether they end words, and edges' labels, targets and outputs."""
    words = sorted({w.encode() for w in words if w})
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def fixed(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    path, last = [[False, []]], b""  # unfinished states along the last word: whether it ends here, edges (label, target)
    for w in [*words, b""]:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], fixed(node)))
        for _ in w[same:]:
            path.append([False, []])
        if w:
            path[-1][0] = True
        last = w
    root = fixed(path[0])
    below: list[int] = []  # words that each state leads to; targets precede their sources
    first, ends, labels, targets, outputs = array.array("i", [0]), bytearray(), bytearray(), array.array("i"), array.array("i")
    for end, edges in states:
        n = int(end)
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            outputs.append(n)
            n += below[target]
        below.append(n)
        ends.append(end)
        first.append(len(labels))
    at, ids = array.array("i", [0]), array.array("i")
    for w in words:
        ids.extend(voc.merge(w.decode()))
        at.append(len(ids))
    tables = [bytes(ends), bytes(labels), *(x.tobytes() for x in (first, targets, outputs, at, ids))]
    head = struct.pack("<8q", root, *map(len, tables))
    pad = lambda b: b + b"\0" * (-len(b) % 8)
    return head + b"".join(map(pad, tables))


class Lexicon:
    """A compiled lexicon, over a memory map or bytes."""

    def __init__(self, buf):
        self.buf = buf
        self.root, *sizes = struct.unpack_from("<8q", buf)
        at, views, view = 64, [], memoryview(buf)
        for i, n in enumerate(sizes):
            views.append((at, n) if i == 1 else view[at : at + n].cast("B" if not i else "i"))
            at += n + -n % 8
        self.ends, (self.labels, _), self.first, self.targets, self.outputs, self.at, self.ids = views

    def get(self, word: bytes) -> list[int] | None:
        state, number, find, base = self.root, 0, self.buf.find, self.labels
        for i in range(len(word)):
            e = find(word[i : i + 1], base + self.first[state], base + self.first[state + 1])
            if e < 0:
                return None
            number += self.outputs[e - base]
            state = self.targets[e - base]
        return self.ids[self.at[number] : self.at[number + 1]].tolist() if self.ends[state] else None


def open_lexicon(uri: str) -> Lexicon:
    """Memory-mapped where the folder is a mounted one; else read from its store."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(path, "rb") as f:
            return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    with fs.open_input_stream(path, compression=None) as f:
        return Lexicon(f.read())


class Codec:
    """Encoding and decoding of texts by whole pre-tokens, the recent ones remembered."""

    def __init__(self, voc: Vocabulary, lexicon: Lexicon | None):
        self.voc, self.lexicon, self.memo = voc, lexicon, {}

    def piece(self, word: str) -> tuple[bytes, bytes]:
        """(ids as little-endian 32-bit integers, decoded UTF-8) of a pre-token."""
        ids = self.lexicon.get(word.encode()) if self.lexicon else None
        ids = self.voc.merge(word) if ids is None else ids
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = got = struct.pack(f"<{len(ids)}I", *ids), self.voc.decode(ids).encode()
        return got

    def text(self, text: str) -> tuple[bytes, bytes]:
        parts = self.voc.specials.split(text) if self.voc.specials else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append((struct.pack("<I", self.voc.special[part]), part.encode()))
            elif part:
                memo, piece = self.memo.get, self.piece
                out += [memo(w) or piece(w) for w in self.voc.pieces(part)]
        return b"".join([x[0] for x in out]), b" ".join([x[1] for x in out if x[0]])


def frequent_words(df: DataFrame, text_col: str, most: int) -> list[str]:
    """The frequent runs of letters of all texts, lower-cased: those of the least count that leaves `most` of them at most."""
    words = df.select(F.explode(F.split(F.lower(F.col(f"`{text_col}`")), r"[^\p{L}]+")).alias("w"))
    count = cut(words.groupBy("w").count().where("count >= 4 and w <> '' and length(w) <= 40"))
    step = F.floor(F.log2("count") * 16)
    left, least = most, None
    for r in count.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # some hundreds of rows
        left -= r["n"]
        if left < 0:
            break
        least = r["step"]
    return [r["w"] for r in count.where(step >= least).select("w").collect()] if least is not None else []


def encode_decode(df: DataFrame, id_col: str, text_col: str, vocabulary: str, lexicon_words: int = 50_000, with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row's whole text and, if asked for, its ids and decoded text.

    Null texts are empty; repeated rows give equal rows; other columns, whatever their names, take no part; an empty table gives no rows. A vocabulary that
    normalises or cuts texts in another way than this operator is refused.
    """
    spec = open(vocabulary, encoding="utf-8").read()
    voc = Vocabulary(json.loads(spec))
    where = f"{shared_dir(df.sparkSession)}/lexicon-{uuid.uuid4().hex}.bin"
    fs, path = pafs.FileSystem.from_uri(where)
    with fs.open_output_stream(path, compression=None) as f:
        f.write(compile_lexicon(frequent_words(df, text_col, lexicon_words), voc))
    shipped = df.sparkSession.sparkContext.broadcast(spec)  # a vocabulary is of fixed size
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches):
        kept = worker_cache()  # a worker's next task finds the words that this one met
        if where not in kept:
            kept.clear()
            kept[where] = (Codec(Vocabulary(json.loads(shipped.value)), open_lexicon(where)), {}, [0])
        codec, known, size = kept[where]

        def once(t: str) -> tuple[bytes, bytes]:
            got = known.get(t)
            if got is None:
                got = codec.text(t)
                if len(t) <= COPIES // 100:
                    if size[0] > COPIES:
                        known.clear()
                        size[0] = 0
                    known[t] = got
                    size[0] += len(t)
            return got

        for b in by_bytes(batches, "text"):
            got = [once(t or "") for t in b.column(1).to_pylist()]
            sha = lambda i: pa.array([hashlib.sha256(x[i]).hexdigest() for x in got])
            columns = [b.column(0), pa.array([len(x[0]) // 4 for x in got], pa.int64()), sha(0), sha(1)]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array([list(struct.unpack(f"<{len(x[0]) // 4}i", x[0])) for x in got], pa.list_(pa.int32())), pa.array([x[1].decode() for x in got])]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")), run, schema)


def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`encode_decode` of the whole `documents` with the public vocabulary of 49,000 words. No SQL: merging is a loop; tests compare it with the tokenizers library.
    Null texts are empty, and give no ids; repeated rows give equal rows; very long texts are encoded
    whole, one at a time; an empty table gives no rows; columns besides, whatever their names, play no part.
    """
    import public_tokenizers

    out = encode_decode(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumnRenamed("id", "doc_id")
