"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-token lengths that every worker receives by broadcast. Tier two is a
bounded cache in each worker, which encodes what it misses. Pre-tokens never enter a shuffle: the operator is one map
over the documents. The table only saves time; the counts do not depend on what is in it.

Nulls: a null text counts as empty (0 bytes, 0 tokens); a null doc_id is kept as null. Empty tables give an empty
result. Rows are never merged, so repeated rows give repeated results. Texts are counted whole, however long; runs longer than an
entry are encoded each time. Ties of frequency only decide what is in the table. Only doc_id and text are read, so other columns cannot clash.
"""
from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Remembering, hashed_share, map_batches, map_stream, per_worker, texts_of

#: Documents sampled for the frequent table (expected number), and the most entries of the table.
SAMPLE_DOCS, TABLE_ENTRIES = 2000, 32_768
LONGEST_ENTRY = 48


class Counting:
    """Counts the tokens of a text as the library does."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.tokenizer = Tokenizer.from_file(path)
        special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        # A byte-level split only turns a piece's bytes into characters, so the model can be asked at once.
        bare = self.tokenizer.normalizer is None and "ByteLevel(add_prefix_space=False" in str(self.tokenizer.pre_tokenizer)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        model = self.tokenizer.model
        asked = (lambda x: len(model.tokenize(x.encode().decode("latin1").translate(alphabet)))) if bare else (lambda x: len(self.tokenizer.encode(x, add_special_tokens=False).ids))
        self.lengths = Remembering(asked, frequent)

    def count(self, text: str) -> int:
        look = self.lengths.__getitem__
        if self.special is None or not self.special.search(text):
            return sum(map(look, self.pieces(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(look, self.pieces(part))) for part in parts)


def pack_table(lengths: dict[str, int]) -> tuple[bytes, bytes]:
    """Entries as two byte strings: the pre-tokens, each ended by a byte that UTF-8 lacks, and their lengths."""
    return b"\xff".join(k.encode() for k in lengths), np.fromiter(lengths.values(), np.uint8, len(lengths)).tobytes()


def unpack_table(packed: tuple[bytes, bytes]) -> dict[str, int]:
    keys, lengths = packed
    return dict(zip((k.decode() for k in keys.split(b"\xff")), lengths, strict=True)) if lengths else {}


def frequent_lengths(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """The most frequent pre-tokens of a bounded sample of the documents, with their lengths in tokens."""
    rows = docs.count()
    if not rows:
        return {}

    def tally(batches):
        pieces, seen = regex.compile(public_tokenizers.PATTERN).findall, Counter()
        for batch in batches:
            for text in texts_of(batch):
                seen.update(x for x in pieces(text) if len(x) <= LONGEST_ENTRY)
            if len(seen) > 4 * entries:
                seen = Counter(dict(seen.most_common(entries)))
        top = [(k, n) for k, n in seen.most_common(entries) if n > 1]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([k for k, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    sample = hashed_share(docs.select("doc_id", "text"), ["doc_id", "text"], sample_docs / rows)
    total: Counter = Counter()
    for row in map_stream(sample.select("text"), tally, "piece string, n long").toLocalIterator():
        total[row["piece"]] += row["n"]
        if len(total) > 8 * entries:
            total = Counter(dict(total.most_common(entries)))
    counting = Counting(path, {})
    return {k: n for k, _ in total.most_common(entries) if (n := counting.lengths.compute(k)) < 256}


def token_counts(docs: DataFrame, path: str | None = None, max_tokens: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (columns doc_id, text)."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    packed = pack_table(frequent_lengths(docs, path))
    shared, key = spark.sparkContext.broadcast(packed), ("token_counts", path, hashlib.sha256(packed[0]).hexdigest())

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counting = per_worker(key, lambda: Counting(path, unpack_table(shared.value)))
        texts = texts_of(batch)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()), "n_tokens": pa.array([counting.count(x) for x in texts], pa.int64())})

    counted = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)
