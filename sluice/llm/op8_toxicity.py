"""Toxicity by a learned lexicon, fuzzy matching and context windows.

Terms are words, or stems that many words share, which labelled toxic rows have and others lack. The Levenshtein automata of all terms, intersected with
their trie, are determinised as words ask for it, so misspelt terms are found at the price of a walk. Each hit is judged within its window of words: by the other hits
near by, and by whether it stands in quotation. A logistic model weighs the sums; its prior trusts hits, and labels move it.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, cut, held_out, map_arrow, table, worker_cache
from .op10_quality import labelled

WORD = re.compile(r"[^\W\d_]+")
QUOTED = re.compile(r'"[^"\n]{1,400}"|“[^”\n]{1,400}”|«[^»\n]{1,400}»|„[^“”\n]{1,400}[“”]|‘[^’\n]{1,400}’')
SHORTEST, LONGEST = 4, 8
WINDOW = 8
MEMO = 150_000
#: Partitions of the sample that is learned from, which is bounded.
TASKS = 48
FEATURES = ("open", "quoted", "fuzzy", "fuzzy_quoted", "window", "share")
#: What the model believes before it sees labels, in the order of FEATURES; the last is the constant.
PRIOR = np.array([4.0, 0.6, 1.4, 0.2, 1.0, 1.0, -2.0])


def edits(length: int) -> int:
    """Edits that a term of this length may bear."""
    return 0 if length < 5 else 1 if length < 9 else 2


class _State(dict):
    """A state of the determinised automaton; transitions are made when a word first asks for them."""

    __slots__ = ("lexicon", "places", "stem", "dead", "accepts")

    def __missing__(self, c: str) -> "_State":
        got = self[c] = self.lexicon.step(self, c)
        return got


class FuzzyLexicon:
    """Levenshtein automata of all terms at once: the places in the trie of terms that a word's letters so far may stand at, with their edits.

    A term is a word, or a stem (ending in *), which holds for any word that goes on from it. Each has its own allowance of edits.
    """

    MOST_STATES = 20_000

    def __init__(self, terms: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.allow, self.word, self.stem = [0], [None], [None]  # of each node: most edits of a term below; the term that ends here
        for t in sorted(terms):
            body, node = t.rstrip("*"), 0
            for c in body:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    for x, v in ((self.allow, 0), (self.word, None), (self.stem, None)):
                        x.append(v)
                node = self.children[node][c]
            (self.stem if t.endswith("*") else self.word)[node] = t
        self.terms = terms
        self._spread(0)
        self.reset()

    def _spread(self, root: int) -> None:
        order, todo = [], [root]
        while todo:
            order.append(node := todo.pop())
            todo += self.children[node].values()
        for node in reversed(order):
            own = [edits(len(t.rstrip("*"))) for t in (self.word[node], self.stem[node]) if t]
            self.allow[node] = max([*own, *(self.allow[c] for c in self.children[node].values())], default=0)

    def reset(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self._state({0: 0}, None)

    def _state(self, places: dict[int, int], stem: tuple[int, str] | None) -> _State:
        todo = list(places.items())
        while todo:  # the word may lack letters of a term
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.allow[child] and e + 1 < places.get(child, 99):
                    places[child] = e + 1
                    todo.append((child, e + 1))
        for node, e in places.items():
            t = self.stem[node]
            if t and e <= edits(len(t) - 1) and (stem is None or (e, t) < stem):
                stem = (e, t)
        key = (tuple(sorted(places.items())), stem)
        if key not in self.states:
            s = self.states[key] = _State()
            s.lexicon, s.places, s.stem, s.dead = self, key[0], stem, not places
            ends = [(e, self.word[node]) for node, e in places.items() if self.word[node] and e <= edits(len(self.word[node]))]
            s.accepts = min([*ends, *([stem] if stem else [])], default=None)
        return self.states[key]

    def step(self, state: _State, c: str) -> _State:
        places: dict[int, int] = {}
        for node, e in state.places:
            for x, child in self.children[node].items():
                d = e + (x != c)
                if d <= self.allow[child] and d < places.get(child, 99):
                    places[child] = d
            if e + 1 <= self.allow[node] and e + 1 < places.get(node, 99):  # a letter too many
                places[node] = e + 1
        return self._state(places, state.stem)

    def meet(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term that holds for the word; None if there is none."""
        if len(self.states) > self.MOST_STATES:
            self.reset()
        state = self.start
        for c in word:
            state = state[c]
            if state.dead:
                return state.stem
        return state.accepts


class Judge:
    """Features of texts under a lexicon of terms and their worth; words' matches are remembered, a bounded number of them."""

    def __init__(self, terms: dict[str, float]):
        self.lexicon, self.memo = FuzzyLexicon(terms), {}

    def match(self, word: str) -> tuple[int, str] | None:
        try:
            return self.memo[word]
        except KeyError:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[word] = self.lexicon.meet(word)
            return got

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = WORD.findall(low)
        hit = {w: d for w in set(words) if (d := self.match(w)) is not None}
        if not hit:
            return [0.0] * len(FEATURES)
        inside = np.zeros(len(low) + 1, bool)
        for m in QUOTED.finditer(low):
            inside[m.start() : m.end()] = True
        at, quoted, exact, worth = [], [], [], []
        for i, m in enumerate(WORD.finditer(low)):
            d = hit.get(m.group())
            if d is not None:
                at.append(i)
                exact.append(d[0] == 0)
                quoted.append(inside[m.start()])
                worth.append(self.lexicon.terms[d[1]])
        at, quoted, exact, worth = np.array(at), np.array(quoted), np.array(exact), np.array(worth)
        log = lambda mask: float(np.log1p(worth[mask].sum()))
        weighed = worth * np.where(exact, 1.0, 0.4) * np.where(quoted, 0.3, 1.0)
        sums = np.concatenate(([0], np.cumsum(weighed)))
        near = (sums[np.searchsorted(at, at + WINDOW, "right")] - sums[np.searchsorted(at, at - WINDOW)]).max()
        return [log(exact & ~quoted), log(exact & quoted), log(~exact & ~quoted), log(~exact & quoted), float(np.log1p(near)), float(min(1.0, 20 * weighed.sum() / len(words)))]


def judge_of(terms: dict[str, float]) -> Judge:
    """The worker's judge for these terms, with what it remembers from earlier tasks."""
    kept, key = worker_cache(), ("judge", tuple(sorted(terms.items())))
    if key not in kept:
        kept.clear()
        kept[key] = Judge(terms)
    return kept[key]


def learn_terms(rows: DataFrame, least: int = 4, part: float = 0.02, purity: float = 0.6) -> dict[str, float]:
    """Words and stems that the distinct (text, y) rows show to be toxic, with their worth from 0 to 1.

    A term stands in toxic rows more often than in others, and in `part` of the distinct toxic texts, `least` at least, with as many different neighbours. So what copies
    of a few texts repeat is no term. All that qualify are terms, however long; the rows are a bounded sample, and a term asks for a share of them, so there are few.
    """

    def count(batches):
        seen: dict[str, list[int]] = {}
        for b in by_bytes(batches, "text"):
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                times: Counter = Counter()
                for w, n in Counter(WORD.findall((t or "").lower())).items():
                    for term in (w, *(w[:k] + "*" for k in range(SHORTEST, min(LONGEST, len(w)) + 1))):
                        times[term] += min(n, 2)  # a row that repeats a word says no more
                for term, n in times.items():
                    got = seen.setdefault(term, [0, 0, 0])
                    got[1 if y else 0] += n
                    got[2] += 1 if y else 0
        if seen:
            yield pa.RecordBatch.from_pydict({"term": list(seen), **{k: pa.array([v[i] for v in seen.values()], pa.int64()) for i, k in enumerate(("clean", "toxic", "rows"))}})

    need = max(least, int(part * rows.where("y > 0").count()))
    sums = map_arrow(rows, count, "term string, clean long, toxic long, rows long").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "rows")])
    pure = sums.where((F.col("rows") >= need) & (F.col("toxic") >= purity * (F.col("toxic") + F.col("clean") + 4)) & (F.length("term") >= SHORTEST))
    found = {r["term"]: (r["toxic"], r["clean"], r["rows"]) for r in pure.orderBy(F.desc("toxic"), "term").collect()}
    support = {t: n for t, (n, _, _) in found.items()}

    def neighbours(batches):
        seen = set()
        for b in by_bytes(batches, "text"):
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = WORD.findall((t or "").lower()) if y else []
                for before, w in zip(["", *words], words):
                    seen.update((x, before) for x in (w, *(w[:k] + "*" for k in range(SHORTEST, min(LONGEST, len(w)) + 1))) if x in support)
        if seen:
            yield pa.RecordBatch.from_pydict({"term": [x[0] for x in seen], "before": [x[1] for x in seen]})

    met = map_arrow(rows, neighbours, "term string, before string").groupBy("term").agg(F.countDistinct("before").alias("n"))
    enough = {r["term"] for r in met.collect() if r["n"] >= need and (r["n"] >= 0.2 * found[r["term"]][2] or r["n"] >= 4 * need)}
    return {t: 2 * found[t][0] / sum(found[t][:2]) - 1 for t in choose({t: n for t, n in support.items() if t in enough})}


def choose(support: dict[str, int]) -> list[str]:
    """The shortest stems from which words branch, and the words that no stem holds."""
    kept: list[str] = []
    stems = sorted((t for t in support if t.endswith("*")), key=lambda t: (len(t), t))
    longest: Counter = Counter()  # of each stem, the support of the best extension
    for t, n in support.items():
        body = t.rstrip("*")
        for k in range(SHORTEST, len(body) + (not t.endswith("*"))):
            longest[body[:k] + "*"] = max(longest[body[:k] + "*"], n)
    for s in stems:
        if not any(s.startswith(k[:-1]) for k in kept) and longest[s] < 0.8 * support[s]:
            kept.append(s)
    return kept + [t for t in support if not t.endswith("*") and not any(t.startswith(k[:-1]) for k in kept)]


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 2.0, rounds: int = 60) -> np.ndarray:
    """Logistic weights by Newton's method, drawn to the prior; hits never speak against toxicity."""
    w, x = PRIOR.copy(), np.column_stack((x, np.ones(len(x))))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pull * (w - PRIOR)
        h = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    w[:-1] = np.maximum(w[:-1], 0)
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 20_000) -> tuple[dict[str, float], np.ndarray]:
    """(terms, weights), learned from `most` labelled rows at most; no terms and the prior without labels."""
    rows = cut(labelled(docs, labels, label, most))  # read thrice
    terms = learn_terms(cut(rows.distinct().repartition(TASKS)))

    def features(batches):
        judge = judge_of(terms)
        for b in by_bytes(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([judge.features(t or "") for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    t = map_arrow(rows.repartition(TASKS), features, "x array<double>, y int").toArrow().combine_chunks()
    if not t.num_rows:
        return terms, PRIOR
    x = t.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return terms, fit_weights(x, t.column("y").to_numpy().astype(float))


def score_toxicity(df: DataFrame, id_col: str, text_col: str, model, carry: list[str] | None = None) -> DataFrame:
    """`carry` columns (the id, if None) and score: how likely label 1 is. 

    Null and empty texts have no hits and score as any text without; repeated rows score alike; columns that bear inner names don't clash; an empty table gives no rows.
    """
    carry = [id_col] if carry is None else carry
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{text_col}`").alias("text"))
    kinds = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    terms, w = model

    def run(batches):
        judge = judge_of(terms)
        for b in by_bytes(batches, "text"):
            x = np.array([[*judge.features(t or ""), 1.0] for t in b.column(len(carry)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))], [*[f"c{i}" for i in range(len(carry))], "score"])

    return map_arrow(rows, run, f"{kinds}, score double").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "score")


def op8_levenshtein_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of the whole `documents` by a lexicon and weights learned from labelled rows outside the held-out third. No SQL: automata are walked letter by letter; tests hold
    them against edit distances, and the scores against held-out labels. Null and empty texts have no hits; repeated rows score alike; very long texts are read whole, one at a time.
    """
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, "doc_id", "text", fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
