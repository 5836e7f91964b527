"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ORDER bytes with frozen statistics from training; all counts are kept. A context predicts
the bytes that followed it and escapes to the context that is one byte shorter for the others, with the probability D / (T + D), where T bytes of
D kinds followed; below the empty context all bytes are equal. Bytes that the longer context predicts are excluded from the shorter one, so the
probabilities of the 256 bytes add up to one and a text's code length is exact. A context that was never seen costs nothing: the longest one that was seen is used.

An escape and the exclusion after it depend on the context only, so they are one number for each context. A text's code length is then a sum of
table entries: one where the string of context and byte was seen in some language, else the context's number and what is found one byte shorter.

Training reads a bounded, hashed sample of the labelled rows (FIT_BYTES of text for each language, less where there are very many languages,
so that the tables stay within about MODEL_BYTES). All languages are learned; ties of length go to the first by name. Nulls: a null text, or
one without letters, is `und` with score 0; rows with a null lang or text are not learned from; a null doc_id stays null. Without rows
to learn from, all is `und`. An empty table gives an empty result. Repeated rows are scored each; in training they count as often as they are there.
Very long texts are scored whole, a slice at a time. Columns named lang_pred or score are replaced.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_share, map_batches, map_stream, per_worker, texts_of

#: Bytes of the longest context; bytes of text sampled of each language (expected number); bytes of all tables.
ORDER, FIT_BYTES, MODEL_BYTES = 4, 1_600_000, 256 << 20
#: Languages whose tables share rows.
TOGETHER = 16
#: Bytes scored at once.
SLICE = 1 << 18
#: What stands before a text.
BEFORE = b"\n" * ORDER
LETTER = regex.compile(r"\p{L}")
Counts = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


def strings(data: np.ndarray, order: int) -> np.ndarray:
    """The string of order + 1 bytes that ends at each byte after the first ORDER, as a number."""
    n = len(data) - ORDER
    out = np.zeros(max(n, 0), np.int64)
    for k in range(order, -1, -1):
        out = out << 8 | data[ORDER - k : ORDER - k + n]
    return out


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counted strings added up, in order."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def counted(docs: DataFrame, learn: Column, fit_bytes: int = FIT_BYTES) -> tuple[list[str], Counts]:
    """Languages, and for each (language, order) its strings of order + 1 bytes and their counts."""
    known = docs.where("lang is not null and text is not null").where(learn).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], {}
    own = min(fit_bytes, MODEL_BYTES // (40 * len(languages)))
    numbers = known.sparkSession.createDataFrame([(name, k, min(1.0, own / max(1, sizes[name]))) for k, name in enumerate(languages)], "lang string, language int, share double")
    sample = hashed_share(known.join(F.broadcast(numbers), "lang"), ["doc_id", "text"], F.col("share"))

    def count(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode()
                for k in range(0, len(data), SLICE):
                    part = np.frombuffer((BEFORE + data)[k : k + SLICE + ORDER], np.uint8).astype(np.int64)
                    for order in range(ORDER + 1):
                        rows = held.setdefault((language, order), [])
                        rows.append(np.unique(strings(part, order), return_counts=True))
                        if len(rows) > 64:
                            rows[:] = [added(rows)]
        for (language, order), parts in held.items():
            keys, n = added(parts)
            yield pa.RecordBatch.from_pydict({"language": pa.array(np.full(len(keys), language, np.int32)), "o": pa.array(np.full(len(keys), order, np.int32)), "k": keys, "n": n})

    total = map_stream(sample.select("language", "text"), count, "language int, o int, k long, n long").groupBy("language", "o", "k").agg(F.sum("n").alias("n"))
    parts: dict[tuple[int, int], list] = {}
    for batch in total.toArrow().to_batches():
        language, order, k, n = (np.asarray(batch.column(j)) for j in range(4))
        for at in {*zip(language.tolist(), order.tolist(), strict=True)}:
            mine = (language == at[0]) & (order == at[1])
            parts.setdefault(at, []).append((k[mine], n[mine]))
    return languages, {at: added(rows) for at, rows in parts.items()}


def places(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are in sorted_keys, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Rows:
    """Finds the rows of distinct keys by hashing into four or more slots for each, with linear probing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 4 - 1).bit_length()) if len(keys) else 4
        self.keys, self.shift, self.mask = np.append(keys, -1), np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, len(keys), np.int32)  # the last row, with the key -1, stands for none
        left, at = np.arange(len(keys)), self.hashed(keys)
        while len(left):
            free = self.slots[at] == len(keys)
            self.slots[at[free]] = left[free]
            there = self.slots[at] == left
            left, at = left[~there], (at[~there] + 1) & self.mask

    def hashed(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's row, and whether it has one."""
        at = self.hashed(keys)
        rows = self.slots[at]
        held = self.keys[rows]
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            rows[open_] = self.slots[at[open_]]
            held = self.keys[rows[open_]]
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        return rows, rows < len(self.keys) - 1


class Tables:
    """Code lengths in bits of a few languages: for each order the strings seen in any of them, with [string, language] lengths of their last byte, and the contexts
    seen in any, with the [context, language] length of leaving them (0 where the context wasn't seen)."""

    def __init__(self, counts: Counts, languages: range):
        self.size = len(languages)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.keys, self.lengths, self.contexts, self.leave = [], [], [], []
        for order in range(ORDER + 1):
            own = [counts.get((k, order), none) for k in languages]
            keys = np.unique(np.concatenate([k for k, _ in own]))
            contexts = np.unique(keys >> 8)
            if order:
                at, _ = places(self.keys[-1], keys & ((1 << 8 * order) - 1))
                shorter = self.lengths[-1][at]
            else:
                shorter = np.full((len(keys), self.size), 8.0)
            context = np.searchsorted(contexts, keys >> 8)
            leave, lengths = np.zeros((len(contexts), self.size)), np.zeros((len(keys), self.size))
            for k, (mine, n) in enumerate(own):
                at, where = np.searchsorted(keys, mine), np.searchsorted(contexts, mine >> 8)
                total, kinds = np.bincount(where, n, len(contexts)), np.bincount(where, minlength=len(contexts))
                # What the shorter context gives to the bytes that are excluded.
                gone = np.bincount(where, np.exp2(-shorter[at, k]), len(contexts))
                seen, whole = kinds > 0, kinds == 256
                escape = np.where(whole, 0.0, kinds / np.maximum(total + kinds, 1))
                with np.errstate(divide="ignore"):
                    leave[:, k] = np.where(seen & ~whole, np.log2(np.maximum(1 - gone, 1e-300)) - np.log2(np.where(escape > 0, escape, 1.0)), 0.0)
                lengths[:, k] = leave[context, k] + shorter[:, k]
                lengths[at, k] = -np.log2((1 - escape[where]) * n / total[where])
            self.keys.append(keys)
            self.contexts.append(contexts)
            self.lengths.append(lengths)
            self.leave.append(leave)
        self.lengths, self.leave = ([x.astype(np.float32) for x in xs] for xs in (self.lengths, self.leave))
        self.rows, self.context_rows = [Rows(k) for k in self.keys], [Rows(k) for k in self.contexts]

    def each(self, data: np.ndarray) -> np.ndarray:
        """[byte, language] code lengths of the bytes after the first ORDER."""
        keys = strings(data, ORDER)
        out, open_rows = np.zeros((len(keys), self.size), np.float32), np.arange(len(keys))
        for order in range(ORDER, -1, -1):
            own = keys[open_rows] & ((1 << 8 * (order + 1)) - 1)
            at, there = self.rows[order].find(own)
            out[open_rows[there]] += self.lengths[order][at[there]]
            open_rows, own = open_rows[~there], own[~there]
            if not len(open_rows):
                return out
            at, there = self.context_rows[order].find(own >> 8)
            out[open_rows[there]] += self.leave[order][at[there]]
        out[open_rows] += 8.0
        return out


class Trees:
    """The tables of all languages."""

    def __init__(self, languages: list[str], counts: Counts):
        self.languages = languages
        self.tables = [Tables(counts, range(k, min(len(languages), k + TOGETHER))) for k in range(0, len(languages), TOGETHER)]
        digest = hashlib.sha256(repr(languages).encode())
        for t in self.tables:
            for x in (*t.keys, *t.lengths):
                digest.update(x.tobytes())
        self.digest = digest.hexdigest()

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits, one row for each text and one column for each language."""
        out = np.zeros((len(texts), len(self.languages)))
        together, size = [], 0
        for k, text in enumerate(texts):
            if len(text) > SLICE:
                whole = BEFORE + text
                for j in range(0, len(text), SLICE):
                    out[k] += self.sums([whole[j : j + SLICE + ORDER]])[0]
                continue
            if size + len(text) > SLICE:
                out[together] = self.sums([BEFORE + texts[j] for j in together])
                together, size = [], 0
            together.append(k)
            size += len(text) + ORDER
        if together:
            out[together] = self.sums([BEFORE + texts[j] for j in together])
        return out

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths of texts after their first ORDER bytes."""
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
        ends = np.cumsum([len(x) for x in texts])
        each = np.concatenate([t.each(data) for t in self.tables], axis=1)
        return np.stack([each[end - len(x) : end - ORDER].sum(axis=0, dtype=np.float64) for x, end in zip(texts, ends.tolist(), strict=True)])


def fit(docs: DataFrame, learn: Column, fit_bytes: int = FIT_BYTES) -> Trees | None:
    languages, counts = counted(docs, learn, fit_bytes)
    return Trees(languages, counts) if languages else None


def identify(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """docs (with a column text) with lang_pred and score, the share of the best language among all by code length."""
    plain = docs.drop("lang_pred", "score")
    shared, key = docs.sparkSession.sparkContext.broadcast(trees), ("language", trees and trees.digest)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = per_worker(key, lambda: shared.value)
        texts = texts_of(batch)
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = [k for k, x in enumerate(texts) if model is not None and LETTER.search(x)]
        if some:
            bits = model.lengths([texts[k].encode() for k in some])
            shares = np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0))
            for k, best, share in zip(some, bits.argmin(axis=1), 1 / shares.sum(axis=1), strict=True):
                names[k], scores[k] = model.languages[best], float(share)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(names), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", lang_pred string, score double"
    return map_batches(plain, run, schema)
