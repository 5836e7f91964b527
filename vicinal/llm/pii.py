"""Personal data by base patterns and a skip-chain conditional random field.

The base patterns find what is certain. The field labels the other candidates, number runs (spaced and bracketed digits are one) and tokens with a
digit or an `@`, as one of the kinds or as other. Node potentials come from the candidate's form, chain potentials join candidates at
most GAP characters apart, and skip potentials join the occurrences of equal and of similar keys (letters and digits without marks): keys
that are one edit apart, or numbers that end alike. Loopy message passing spreads what the base patterns are certain of over the
document, so that a number or address has one label throughout, however it is written. Spans that the field is sure of are added; base
spans always stay. Only candidates that skip or chain edges connect with a base span are asked; what nothing certain supports stays other.

The field's weights are learned by pseudo-likelihood from a bounded, hashed sample of documents with the base spans as distant labels.
Base spans are masked there: a repeat without its telling marks has the span's kind if an equal or a similar span supports it, and is
other if nothing does. So the neighbours must explain it. Candidates beside such spans are left out; the others are other.

Nulls: a null text is empty and has no spans; a null doc_id stays null. Empty tables give empty results and zero weights. Every row is
its own document, so repeated rows have repeated results. Very long texts are read whole: edges grow in proportion to candidates. Of
overlapping spans that are redacted the one that starts first and is longest names the kind. Columns named base or spans are replaced.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_share, map_batches, per_worker, texts_of
from .components import local_labels

KINDS = ("email", "ip", "card", "phone")
#: Documents sampled to learn weights (expected number), rounds of messages, and the belief a further span needs.
FIT_DOCS, ROUNDS, DAMPING, SURE = 16_000, 8, 0.3, 0.95
LABELS = 5  # other, then KINDS
#: Characters between candidates of a chain; letters and digits of keys that have skip edges, and of those whose edits are looked up.
GAP, KEY, EDITED = 60, 6, (8, 40)
#: Last digits that make two numbers similar.
ENDING = 9

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
CANDIDATE = re.compile(r"(?<![\w@])[+(]*[0-9](?:[\x20().-]{0,2}[0-9])*(?![\w@])|[^\s\"'<>=,;]*[0-9@][^\s\"'<>=,;]*")


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            out.append((start, domain.end()))
            done = domain.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    numbers = [int(c) for c in reversed(digits)]
    return (sum(numbers[0::2]) + sum(sum(divmod(2 * x, 10)) for x in numbers[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m.groups())] if "." in text else []
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15] if "+" in text else []
    return out


def node_features(token: str) -> list[float]:
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    return [
        1.0, float("@" in token), float("@" in token and "." in token.rpartition("@")[2]), float(token.count(".") == 3 and digits >= 4 and letters == 0),
        float(13 <= digits <= 19 and letters == 0), float(7 <= digits <= 12 and letters == 0), float(token.startswith("+")), float("(" in token or ")" in token),
        float("-" in token and digits >= 6), float(letters > 0 and digits > 0), float(digits <= 3), float(letters > digits),
    ]


NODE = len(node_features("0"))
#: Of a candidate, and of its label given its neighbours': node features, labels before and after, whether an equal and a similar candidate has a label.
WIDTH = NODE + 4 * LABELS
BEFORE, AFTER, EQUAL, SIMILAR = (NODE + k * LABELS for k in range(4))


def key_of(token: str) -> str:
    return re.sub(r"[\W_]", "", token).lower()


def candidates(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Candidates, without the marks that end them, and the kind (1 to 4) of the base span each overlaps, or 0."""
    found = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".:!?":
            b -= 1
        if b > a:
            found.append((a, b))
    kinds, ordered, k = np.zeros(len(found), np.int64), sorted(spans, key=lambda s: s[1]), 0
    for at, (a, b) in enumerate(found):
        while k < len(ordered) and ordered[k][2] <= a:
            k += 1
        for kind, start, end in ordered[k : k + 4]:
            if start < b and a < end:
                kinds[at] = kind + 1
                break
    return found, kinds


def chain_edges(found: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    return [(k, k + 1, 0) for k in range(len(found) - 1) if found[k + 1][0] - found[k][1] <= GAP]


def similar_marks(key: str) -> tuple[list[str], list[str]]:
    """What a key is found under by keys that are similar to it, and what it looks for: one character put in, left out or other, or the same last digits."""
    left, asked = [], []
    if EDITED[0] <= len(key) <= EDITED[1]:
        shorter = [key[:i] + key[i + 1 :] for i in range(len(key))]
        other = [f"{key[:i]}?{key[i + 1:]}" for i in range(len(key))]
        left += [f"={key}", *(f"-{x}" for x in shorter), *other]
        asked += [f"-{key}", *(f"={x}" for x in shorter), *other]
    if key.isdigit() and len(key) >= ENDING:
        left.append(f"*{key[-ENDING:]}")
        asked.append(f"*{key[-ENDING:]}")
    return left, asked


def skip_edges(text: str, found: list[tuple[int, int]], kinds: np.ndarray) -> list[tuple[int, int, int]]:
    """(i, j, 1) for each candidate and its key's first one, if there is any the first in a base span, and (i, j, 2) for such first ones of similar keys. A
    key is looked up some three times for each character, so the number of edges is linear, and no candidate is more than three edges from a base span that supports it."""
    keys = [key_of(text[a:b]) for a, b in found]
    first: dict[str, int] = {}
    for k in (*np.flatnonzero(kinds > 0).tolist(), *np.flatnonzero(kinds == 0).tolist()):
        if len(keys[k]) >= KEY:
            first.setdefault(keys[k], k)
    out = [(first[key], k, 1) for k, key in enumerate(keys) if key in first and first[key] != k]
    marked: dict[str, int] = {}
    for key, k in first.items():  # those of base spans come first
        left, asked = similar_marks(key)
        out += [(j, k, 2) for j in sorted({marked[m] for m in asked if m in marked})]
        for m in left:
            marked.setdefault(m, k)
    return out


def training_rows(text: str) -> list[tuple[list[float], int]]:
    spans = base_spans(text)
    found, kinds = candidates(text, spans)
    chains, skips = chain_edges(found), skip_edges(text, found, kinds)
    rows, around = [], np.zeros((len(found), WIDTH))
    for i, j, kind in [*chains, *skips]:
        around[i, (AFTER, EQUAL, SIMILAR)[kind] + kinds[j]] = 1.0
        around[j, (BEFORE, EQUAL, SIMILAR)[kind] + kinds[i]] = 1.0
    for k, (a, b) in enumerate(found):
        if kinds[k]:
            for form in {text[a:b], key_of(text[a:b])}:
                x = [*node_features(form), *around[k, NODE:EQUAL].tolist(), *[0.0] * (2 * LABELS)]
                rows.append((x, 0))
                for block in (EQUAL, SIMILAR):
                    y = list(x)
                    y[block + kinds[k]] = 1.0
                    rows.append((y, int(kinds[k])))
        elif not (around[k, EQUAL + 1 : SIMILAR].any() or around[k, SIMILAR + 1 :].any()):
            rows.append(([*node_features(text[a:b]), *around[k, NODE:].tolist()], 0))
    return rows


def fit_field(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 1e-5, rounds: int = 1500) -> np.ndarray:
    """Weights [label, feature] of a multinomial logistic pseudo-likelihood, by accelerated gradient steps. Labels weigh alike."""
    w = np.zeros((LABELS, WIDTH))
    if not len(x):
        return w
    share = np.bincount(y, n, LABELS)
    n, target, before = n / share[y] / np.count_nonzero(share), np.eye(LABELS)[y], w
    rate = 1.0 / (0.5 * float((n * (x * x).sum(axis=1)).sum()) + penalty)
    for k in range(rounds):
        ahead = w + k / (k + 3) * (w - before)
        s = x @ ahead.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        before, w = w, ahead - rate * (((p - target) * n[:, None]).T @ x + penalty * ahead)
    return w


class Field:
    """Potentials from learned weights."""

    def __init__(self, weights: np.ndarray):
        self.node = weights[:, :NODE].T
        before, after, equal, similar = (weights[:, k : k + LABELS] for k in (BEFORE, AFTER, EQUAL, SIMILAR))
        chain = 0.5 * (before.T + after)
        #: [label of the first, label of the second] of chain edges, and of skip edges of equal and of similar keys.
        self.pair = [chain, 0.5 * (equal + equal.T), 0.5 * (similar + similar.T)]

    def beliefs(self, features: np.ndarray, kinds: np.ndarray, edges: list[tuple[int, int, int]]) -> np.ndarray:
        """Label probabilities of each node, after messages over all edges. Memory is in proportion to nodes and edges; potentials are shared."""
        own = features @ self.node
        own[kinds > 0] = -1e9  # certain, whatever the messages
        own[np.flatnonzero(kinds), kinds[kinds > 0]] = 0.0
        if not edges:
            return softmax(own)
        i, j, kind = np.array(edges).T
        source, target = np.concatenate([i, j]), np.concatenate([j, i])
        back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
        moves = [(np.flatnonzero(kind == k) + side * len(i), np.exp(np.clip(m.T if side else m, -8, 8))) for k, m in enumerate(self.pair) for side in (0, 1)]
        messages = np.zeros((len(source), LABELS))
        for _ in range(ROUNDS):
            total = own.copy()
            np.add.at(total, target, messages)
            out = softmax(total[source] - messages[back])
            for rows, m in moves:
                out[rows] = np.log(out[rows] @ m + 1e-12)
            messages = DAMPING * messages + (1 - DAMPING) * (out - out.max(axis=1, keepdims=True))
        total = own.copy()
        np.add.at(total, target, messages)
        return softmax(total)

    def spans(self, text: str, base: list[tuple[int, int, int]] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans and all spans, by kind and start."""
        base = base_spans(text) if base is None else base
        if not base:
            return [], []
        found, kinds = candidates(text, base)
        edges = [*chain_edges(found), *skip_edges(text, found, kinds)]
        if (kinds > 0).all() or not edges:
            return base, base
        ends = np.array(edges)
        part = local_labels(len(found), ends[:, 0], ends[:, 1])
        some = np.isin(part, np.intersect1d(part[kinds > 0], part[kinds == 0]))
        if not some.any():
            return base, base
        place = np.cumsum(some) - 1
        own = np.flatnonzero(some)
        belief = self.beliefs(np.array([node_features(text[found[k][0] : found[k][1]]) for k in own.tolist()]), kinds[own], [(int(place[i]), int(place[j]), e) for i, j, e in edges if some[i]])
        more = [(int(k) - 1, *found[at]) for at, k, p in zip(own.tolist(), belief.argmax(axis=1), belief.max(axis=1), strict=True) if kinds[at] == 0 and k > 0 and p >= SURE]
        return base, sorted(base + more)


def softmax(s: np.ndarray) -> np.ndarray:
    p = np.exp(s - s.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def digest_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> np.ndarray:
    """The field's weights from a bounded, hashed sample of docs (columns doc_id, text)."""
    total = docs.count()
    sample = hashed_share(docs.select("doc_id", "text"), ["doc_id", "text"], fit_docs / max(total, 1)).where(F.col("text").rlike("[0-9@]"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [row for text in texts_of(batch) for row in training_rows(text)]
        return pa.RecordBatch.from_pydict({"x": pa.array([x for x, _ in found], pa.list_(pa.float64())), "y": pa.array([y for _, y in found], pa.int32())}) if found else None

    counted = map_batches(sample.select("text"), rows, "x array<double>, y int").groupBy("x", "y").count().orderBy("x", "y").collect()  # features are marks, so few rows differ
    return fit_field(np.array([r["x"] for r in counted]), np.array([r["y"] for r in counted], int), np.array([r["count"] for r in counted], float))


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs (with a column text) with base and spans, arrays of (kind, start, end); columns of these names are replaced."""
    plain = docs.drop("base", "spans")
    shared, key = docs.sparkSession.sparkContext.broadcast(weights), ("pii", hashlib.sha256(weights.tobytes()).hexdigest())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        field = per_worker(key, lambda: Field(shared.value))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        found = [field.spans(x) for x in texts_of(batch)]
        columns = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in row[which]] for row in found], kind) for which in (0, 1)]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "base", "spans"])

    span = "array<struct<kind: string, start: long, end: long>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + f", base {span}, spans {span}"
    return map_batches(plain, run, schema)


def redact(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; overlapping spans become one. A null text stays null."""
    shared, key, at = docs.sparkSession.sparkContext.broadcast(weights), ("pii", hashlib.sha256(weights.tobytes()).hexdigest()), docs.columns.index("text")

    def clean(field: Field, text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for kind, a, b in sorted(field.spans(text)[1], key=lambda s: (s[1], -s[2], s[0])):
            if a >= done:
                out += [text[done:a], f"[{KINDS[kind].upper()}]"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        field = per_worker(key, lambda: Field(shared.value))
        texts = pa.array([clean(field, x) for x in batch.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return map_batches(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def digests(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans, from what find returns."""
    joined = "array_join(transform({0}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    found = find(docs.select(F.col("doc_id").cast("long"), "text"), weights)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined.format("base")).cast("binary"), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))
