"""Toxicity by Levenshtein automata intersected with a lexicon trie, and scores of the hits' context windows.

The lexicon (words and word beginnings) and the scores are learned from labelled rows. The trie of the lexicon and the
Levenshtein automaton of a term are walked together: a state is the set of (trie node, edits so far), and the product is
built lazily and remembered, so that a word that no term is near leaves it after a few characters. Each hit is scored with the
words round it: quotation marks, words of reporting, the density of other hits. Sums of these go into a logistic model.

Labels, lang, source and doc_id never enter a score. Nulls: a null text scores as an empty one; a null doc_id stays null.
Labels with null or other values are left out. Without labelled rows of both kinds, as in empty tables, every score is a half and predicted 0.
Texts are read whole, however long. Repeated rows are scored each; in the choice of terms a text with its label counts once. Of a
doc_id with several labels 1 counts. Of terms equally near, the one with fewer edits and then the more frequent one is hit. A score at the
threshold is predicted 1. Columns named score or predicted are replaced.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Remembering, hashed_share, map_batches, map_stream, per_worker, texts_of

#: Labelled documents of either label that the fit reads (expected number), the most terms, and the edits for terms of at least LONG characters.
FIT_DOCS, MOST_TERMS, EDITS, LONG = 6000, 512, 1, 5
#: A term's least share of toxic among the documents with it, and its least number and share of toxic documents.
PRECISION, LEAST_DOCS, LEAST_SHARE = 0.9, 3, 0.01
STEM_LENGTHS = range(3, 9)
#: Words on either side of a hit that make its context.
WINDOW = 4
THRESHOLD = 0.7
#: Steps of the product automaton that a worker remembers, each with at most one state, some 500 bytes; the state that no term is near.
MOST_STEPS, DEAD = 50_000, -1
WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
QUOTES = "\"“”„«»‘`"
#: Words that report someone's speech, or speak about a word.
REPORTING = frozenset("said says say called calls quote quoted quotes wrote writes word words term means sagte sagt nannte schrieb wort a-dit dit disait appelé écrit mot dijo dice llamó escribió palabra".split())
FEATURES = 8


@dataclass
class Lexicon:
    """Terms with a flag whether any ending may follow (a stem), as a trie, and the lazily built product automaton."""

    terms: list[tuple[str, bool]]
    edits: int = EDITS
    nodes: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, tuple[int, bool]] = field(default_factory=dict)

    def __post_init__(self):
        for number, (term, stem) in enumerate(self.terms):
            node = 0
            for c in term:
                if c not in self.nodes[node]:
                    self.nodes[node][c] = len(self.nodes)
                    self.nodes.append({})
                node = self.nodes[node][c]
            self.ends[node] = (number, stem)
        self.depth = [0] * len(self.nodes)
        for node, children in enumerate(self.nodes):
            for child in children.values():
                self.depth[child] = self.depth[node] + 1
        self.forget()

    def forget(self) -> None:
        """Only the start remains. States are numbers: places in `states`, `steps` (the next state by character) and `accepts`."""
        self.index: dict[tuple, int] = {(): DEAD}
        self.states: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[list[tuple[int, int, bool, int]]] = []
        self.remembered = 0
        self.number(self.close({(0, 0)}))

    def number(self, state: tuple) -> int:
        if state not in self.index:
            self.index[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            ends = [(e, *self.ends[node], self.depth[node]) for node, e in state if node in self.ends]
            self.accepts.append([x for x in ends if x[0] == 0 or x[3] >= LONG])
        return self.index[state]

    def close(self, state: set[tuple[int, int]]) -> tuple:
        """With deletions of a term's characters; of a node only its least edits."""
        todo = list(state)
        while todo:
            node, e = todo.pop()
            if e < self.edits:
                for child in self.nodes[node].values():
                    if (child, e + 1) not in state:
                        state.add((child, e + 1))
                        todo.append((child, e + 1))
        least: dict[int, int] = {}
        for node, e in state:
            least[node] = min(e, least.get(node, e))
        return tuple(sorted(least.items()))

    def step(self, state: int, c: str) -> int:
        after = set()
        for node, e in self.states[state]:
            if c in self.nodes[node]:
                after.add((self.nodes[node][c], e))
            if e < self.edits:
                after.add((node, e + 1))
                after.update((child, e + 1) for child in self.nodes[node].values())
        closed = self.close(after)
        if self.remembered >= MOST_STEPS:
            self.forget()
            return self.number(closed)
        self.remembered += 1
        self.steps[state][c] = following = self.number(closed)
        return following

    def find(self, word: str) -> tuple[int, int] | None:
        """The best (term, edits) for a lower-case word. Short terms only match without edits; a stem's edits lie within as many characters as it has."""
        best, state, n = None, 0, len(word)
        for at, c in enumerate(word, 1):
            following = self.steps[state].get(c)
            state = self.step(state, c) if following is None else following
            if state == DEAD:
                break
            for e, number, stem, depth in self.accepts[state]:
                if (at == n or stem and at == depth) and (best is None or (e, number) < best):
                    best = (e, number)
        return best and (best[1], best[0])


class Scorer:
    """Features of a text's hits, and their logistic score."""

    def __init__(self, terms: list[tuple[str, bool]], weights: list[float] | None = None):
        self.lexicon = Lexicon(terms)
        self.found = Remembering(self.lexicon.find)
        self.weights = np.array(weights or [0.0] * FEATURES)

    def features(self, text: str) -> np.ndarray:
        lower = text.lower()
        words = WORDS.findall(lower)
        look = self.found.__getitem__
        hits = [(k, x) for k, x in enumerate(map(look, words)) if x is not None]
        out = np.zeros(FEATURES)
        out[0] = 1
        if not hits:
            return out
        spans = [m.span() for m in WORDS.finditer(lower)]
        near = {k for k, _ in hits}
        for k, (_, edits) in hits:
            lo, hi = max(0, k - WINDOW), min(len(words), k + WINDOW + 1)
            before, after = lower[spans[lo][0] : spans[k][0]], lower[spans[k][1] : spans[hi - 1][1] + 1]
            quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES) or any(w in REPORTING for w in words[lo:hi])
            out[1 if edits == 0 else 2] += 1
            out[3 if edits == 0 else 4] += quoted
            out[5] += len(near.intersection(range(lo, hi))) > 1
        out[6] = len({x for _, (x, e) in hits if e == 0})
        out[7] = out[1] / len(words)
        out[1:7] = np.log1p(out[1:7])
        return out

    def score(self, text: str) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.features(text) @ self.weights))))))


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Newton steps for a penalised logistic model; n: how often each row occurs."""
    w, n = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + penalty * w
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def choose_terms(counted: dict[str, tuple[int, int]], toxic: int) -> list[tuple[str, bool]]:
    """Terms from the toxic and other document counts of words (ended by a space) and word beginnings.

    A beginning is taken where it first is precise enough, then lengthened, or made a word, while nearly all of its documents stay."""
    least = max(LEAST_DOCS, LEAST_SHARE * toxic)
    good = {k: n for k, (n, other) in counted.items() if n >= least and n / (n + other) >= PRECISION}
    children: dict[str, list[str]] = {}
    for k in good:
        children.setdefault(k.rstrip(" ") if k.endswith(" ") else k[:-1], []).append(k)
    roots = [k for k in good if (k[:-1] not in good) or len(k) <= STEM_LENGTHS[0]]
    terms = {}
    for k in roots:
        n = good[k]
        while not k.endswith(" ") and (further := [c for c in children.get(k, []) if good[c] >= 0.95 * n and c != k]):
            k = max(further, key=lambda c: (c.endswith(" "), good[c], c))
        terms[k] = max(n, terms.get(k, 0))
    ranked = sorted(terms, key=lambda k: (-terms[k], k))[:MOST_TERMS]
    return [(k.rstrip(" "), not k.endswith(" ")) for k in ranked]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, fit_docs: int = FIT_DOCS) -> tuple[list[tuple[str, bool]], list[float]]:
    """Terms and weights from a bounded sample of the labelled rows of docs for which `learn` holds."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").where(learn).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return [], [0.0] * FEATURES
    chosen = None
    for y, n in sorted(sizes.items()):
        part = hashed_share(marked.where(F.col("y") == y), "doc_id", fit_docs / n)
        chosen = part if chosen is None else chosen.union(part)
    # At most about 2 * fit_docs ids and marks: a broadcast of bounded size.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y").where("text is not null")

    def tally(batches):
        counted, total = (Counter(), Counter()), [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in WORDS.findall(text.lower()) if len(w) >= 3}
                total[y] += 1
                counted[y].update({w[:k] for w in words for k in STEM_LENGTHS if len(w) >= k} | {w + " " for w in words})
        keys = list(counted[0].keys() | counted[1].keys())
        yield pa.RecordBatch.from_pydict({"term": [*keys, ""], "bad": pa.array([*(counted[1][k] for k in keys), total[1]], pa.int64()), "other": pa.array([*(counted[0][k] for k in keys), total[0]], pa.int64())})

    toxic_docs = fit_docs * 1.0 if sizes[1] > fit_docs else sizes[1]
    least = max(LEAST_DOCS, 0.8 * LEAST_SHARE * toxic_docs)
    rows = map_stream(sample.distinct(), tally, "term string, bad long, other long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("other").alias("other")).where(F.expr(f"term = '' or (bad >= {least} and bad >= {PRECISION} * (bad + other))")).orderBy(F.desc("bad"), "term").limit(64 * MOST_TERMS).collect()
    counted = {r["term"]: (r["bad"], r["other"]) for r in rows if r["term"]}
    toxic = next((r["bad"] for r in rows if not r["term"]), 0)
    terms = choose_terms(counted, toxic)

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = per_worker(("toxicity", tuple(terms), None), lambda: Scorer(terms))
        return pa.RecordBatch.from_pydict({"x": pa.array([scorer.features(t).tolist() for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), "y": batch.column(1)})

    found = map_batches(sample, describe, "x array<double>, y int").groupBy("x", "y").count().collect()
    x, y, n = np.array([r["x"] for r in found]), np.array([r["y"] for r in found], float), np.array([r["count"] for r in found])
    return terms, fit_logistic(x, y, n).tolist()


def toxicity(docs: DataFrame, terms: list[tuple[str, bool]], weights: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """docs (with a column text) with score and predicted; columns of these names are replaced."""
    plain = docs.drop("score", "predicted")
    shared, key = docs.sparkSession.sparkContext.broadcast((terms, weights)), ("toxicity", tuple(terms), tuple(weights))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = per_worker(key, lambda: Scorer(*shared.value))
        scores = [scorer.score(x) for x in texts_of(batch)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", score double"
    return map_batches(plain, run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
