"""Byte-level BPE encoding and decoding by a monoid tree reduction.

An element of the monoid is a text with its cuts (where the pattern's matches begin) and their ids. Halves of a text are
encoded on their own and then joined. A join re-encodes a window round the seam that grows until what is outside
provably stays as it is:

* Matches of the pattern. The pattern looks at most two characters past a match's start and one past its end, and
  never back. So a match of the left half that ends three characters or more before the seam stays, and once
  the new matching meets a match start of the right half, it goes on as in the right half.
* Ids inside one match longer than a leaf. A sequence of ids is the encoding of its bytes if and only if each
  neighbouring pair is the encoding of the pair's bytes. So the window is final once the pairs at its two edges are.

Decoding is a concatenation up the same kind of tree. Nulls: a null text is empty and has no ids; a null doc_id stays
null. Texts are whole rows, however long: a task holds one batch of them. Empty tables give empty results; repeated rows have a result
each; there are no ties. Only doc_id and text (or ids) are read, so other columns cannot clash.
"""
from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembering, map_batches, per_worker, texts_of

#: Characters of a leaf of the tree over a text; bytes of a leaf of the tree inside one match.
LEAF_CHARS, LEAF_BYTES = 2048, 1024
#: Bytes of the ids of matches that a worker remembers.
MATCH_CACHE = 64 << 20
#: Characters before the seam within which a match of the left half may still change.
REACH = 3
#: A text, the matches of the pattern in it, and the ids of each match.
Element = tuple[str, list[str], list[bytes]]


class Codec:
    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.bytes_of[v] = k
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        self.pieces = Remembering(lambda x: np.asarray(self.match_ids(x.encode()), "<u4").tobytes(), size=MATCH_CACHE)

    # Inside one match.

    def stable(self, a: int, b: int) -> bool:
        return self.core.encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_ids(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        width = 1
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.core.encode_single_piece(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self.stable(left[i - 1], window[0])) and (j == len(right) or self.stable(window[-1], right[j])):
                return left[:i] + window + right[j:]
            width *= 2

    def match_ids(self, piece: bytes) -> list[int]:
        """The ids of the bytes of one match."""
        if len(piece) <= self.leaf_bytes:
            return self.core.encode_single_piece(piece)
        half = len(piece) // 2
        return self.join_ids(self.match_ids(piece[:half]), self.match_ids(piece[half:]))

    # Over matches.

    def leaf(self, text: str) -> Element:
        matches = self.pattern.findall(text)
        return text, matches, list(map(self.pieces.__getitem__, matches))

    def seam_ids(self, match: str, left: list[bytes], right: list[bytes]) -> bytes:
        """The ids of a match over the seam, from those of its part on either side."""
        if len(match) <= self.leaf_bytes or len(left) != 1 or len(right) != 1:
            return self.pieces[match]
        return np.asarray(self.join_ids(*(np.frombuffer(x[0], "<u4").tolist() for x in (left, right))), "<u4").tobytes()

    def join(self, left: Element, right: Element) -> Element:
        """Elements are (text, its matches, their ids); those of the joined text differ only round the seam, in a window that is matched and encoded anew
        until a match begins where one of the right half does."""
        (a, x, x_ids), (b, y, y_ids) = left, right
        text, seam = a + b, len(a)
        start, keep = seam, len(x)
        while keep and start > seam - REACH:  # the last match kept ends at start
            keep -= 1
            start -= len(x[keep])
        fresh, ids, at, skip, reached = [], [], start, 0, seam
        held, place = keep, start  # the left half's match that begins at place
        while at < len(text):
            while skip < len(y) and reached < at:
                reached += len(y[skip])
                skip += 1
            if at >= seam and reached == at:
                break
            match = self.pattern.match(text, at)
            end = match.end()
            while held < len(x) and place < at:
                place += len(x[held])
                held += 1
            whole = at < seam < end and place == at and held == len(x) - 1 and end == seam + len(y[0])
            fresh.append(match[0])
            ids.append(self.seam_ids(match[0], x_ids[held:], y_ids[:1]) if whole else self.pieces[match[0]])
            at = end
        else:
            skip = len(y)
        return text, x[:keep] + fresh + y[skip:], x_ids[:keep] + ids + y_ids[skip:]

    def reduce(self, text: str) -> Element:
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.reduce(text[:half]), self.reduce(text[half:]))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.reduce(text)[2])

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) <= 4 * self.leaf_chars:
            return b"".join(map(self.bytes_of.__getitem__, numbers.tolist()))
        half = len(numbers) // 2 * 4
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids, the ids as little-endian unsigned 32-bit integers, for every row of docs (columns doc_id, text)."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = per_worker(("bpe", path), lambda: Codec(path))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "ids": pa.array([codec.encode(x) for x in texts_of(batch)], pa.binary())})

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes of every row of encoded (columns doc_id, ids)."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = per_worker(("bpe", path), lambda: Codec(path))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "decoded": pa.array([codec.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())})

    return map_batches(encoded.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and decoded bytes in one pass, for digests and audits."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = per_worker(("bpe", path), lambda: Codec(path))
        ids = [codec.encode(x) for x in texts_of(batch)]
        back = [codec.decode(x) for x in ids]
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]), "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back]),
        })

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
