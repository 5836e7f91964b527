"""Cost-balanced packing of documents into sequences of fixed capacity.

A document's attention cost is estimated as linear plus quadratic in its length. Tasks pack their own documents in
groups of bounded size (GROUP_TOKENS, a documented parameter), so that nothing is shuffled and memory stays bounded. In
a group, documents longer than a sequence first fill sequences of their own; then the rest are assigned in descending
order, each to the sequence of lowest cost that has room. What finds no room is cut to fill what is left, so that only a
group's last sequences may be short, and these are cut to powers of two, which need no padding.

Sequence ids are the task's number times 2**33 plus a counter: unique, and equal when a task is run again on the same split.
Nulls: a null text is empty and has only the closing id; a null doc_id stays null. Repeated rows are packed each. An empty table has no
pieces. Very long texts fill sequences of their own. Of documents of one length the first comes first, of sequences of one cost the one
opened first. Only doc_id and text are read, so other columns cannot clash.
"""
from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Remembering, map_stream, per_worker, texts_of

CAPACITY, END_ID = 4096, 2
#: Ids that a task packs together: 1024 sequences.
GROUP_TOKENS = 1024 * CAPACITY
#: Bytes of the ids of runs of text that a worker remembers.
RUN_CACHE = 64 << 20
#: Cost of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Ids of a text by a tokenizer that drops white space, from a cache of the ids of its unbroken runs."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.runs = Remembering(self.encode, size=RUN_CACHE)
        #: White space to Python's split() that is none to the tokenizer.
        self.odd = regex.compile("[\x1c-\x1f]")
        #: The file's own split into pieces; its model's alphabet has a character for every byte.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.model = self.tokenizer.model

    def piece(self, piece: str) -> bytes:
        # Letters of ASCII stand for their own bytes.
        shown = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin1").translate(self.alphabet)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of an unbroken run. Runs of Latin letters, which normalising only puts in lower case, go to the model piece by piece; a piece is a run itself."""
        if (text.isascii() or max(text) < "\u0250" and "\u0130" not in text) and "<|" not in text:
            low = text.lower()
            if low.isalpha():
                return self.piece(low) if low == text else self.runs[low]
            if low[:-1].isalpha():  # then the last character is a piece of its own
                return self.runs[low[:-1]] + self.runs[low[-1]]
            pieces = self.split(low)
            return self.piece(text) if pieces == [text] else b"".join(map(self.runs.__getitem__, pieces))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        if self.odd.search(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.runs.__getitem__, text.split()))


def cost(tokens: int) -> float:
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one group; every id lies in exactly one piece."""
    pieces, rest, used = [], [], []
    for doc, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            pieces.append((doc, k * capacity, capacity, len(used), 0))
            used.append(capacity)
        if n % capacity:
            rest.append((n % capacity, doc, full * capacity))
    open_count = -(-sum(n for n, *_ in rest) // capacity)
    first = len(used)
    used += [0] * open_count
    cheapest = [(0.0, first + k) for k in range(open_count)]  # by cost
    parked: list[tuple[int, float, int]] = []  # by room, most first: sequences with too little room for a document so far
    left = []
    for n, doc, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        while parked and -parked[0][0] >= n:  # documents only get shorter
            _, c, s = heapq.heappop(parked)
            heapq.heappush(cheapest, (c, s))
        while cheapest and used[cheapest[0][1]] + n > capacity:
            c, s = heapq.heappop(cheapest)
            heapq.heappush(parked, (used[s] - capacity, c, s))
        if not cheapest:
            left.append((n, doc, start))
            continue
        c, s = heapq.heappop(cheapest)
        pieces.append((doc, start, n, s, used[s]))
        used[s] += n
        if used[s] < capacity:
            heapq.heappush(cheapest, (c + cost(n), s))
    holes = sorted((s for s in range(first, len(used)) if used[s] < capacity), key=lambda s: (used[s], s))
    for n, doc, start in left:  # cut to fill the sequences that have room; in total there is room for all
        while n:
            s = holes[-1]
            take = min(n, capacity - used[s])
            pieces.append((doc, start, take, s, used[s]))
            used[s] += take
            start, n = start + take, n - take
            if used[s] == capacity:
                holes.pop()
    return powers(pieces, used, capacity)


def powers(pieces: list[tuple[int, int, int, int, int]], used: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Move the contents of short sequences together, then cut the last one into sequences whose lengths are powers of two."""
    short = {s for s, n in enumerate(used) if n < capacity and n & (n - 1)}
    if not short:
        return pieces
    line = [p for p in sorted(pieces, key=lambda p: (p[3], p[4])) if p[3] in short]
    done = [p for p in pieces if p[3] not in short]
    total, fresh, sizes = sum(p[2] for p in line), len(used), []
    while total:
        size = capacity if total >= capacity else 1 << (total.bit_length() - 1)
        sizes.append(size)
        total -= size
    k = offset = 0
    for doc, start, n, _, _ in line:
        while n:
            take = min(n, sizes[k] - offset)
            done.append((doc, start, take, fresh + k, offset))
            start, n, offset = start + take, n - take, offset + take
            if offset == sizes[k]:
                k, offset = k + 1, 0
    return done


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """The pieces of all rows of docs (columns doc_id, text); with_ids adds the ids themselves."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    closing = np.asarray([end_id], "<u4").tobytes()
    schema = SCHEMA + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_worker(("packing", path), lambda: WordIds(path))
        base, group, size = TaskContext.get().partitionId() << 33, [], 0

        def packed() -> pa.RecordBatch:
            nonlocal base
            rows, ids, numbers = [], [], {}
            for doc, start, n, s, offset in sorted(assign([len(x) // 4 for _, x in group], capacity), key=lambda p: (p[3], p[4])):
                own = group[doc][1]
                part = own[4 * start : 4 * (start + n)]
                rows.append((group[doc][0], start, n, zlib.crc32(part), len(own) // 4, base + numbers.setdefault(s, len(numbers)), offset))
                if with_ids:
                    ids.append(part)
            base += len(numbers)
            columns = dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), (pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), strict=True))
            return pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                group.append((doc_id, words.ids(text) + closing))
                size += len(group[-1][1]) // 4
                if size >= group_tokens:
                    yield packed()
                    group, size = [], 0
        if group:
            yield packed()

    return map_stream(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
