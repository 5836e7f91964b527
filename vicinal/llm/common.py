"""What the training-data operators share: tables, sampling, lineage cuts, Arrow batches, bounded caches of workers."""
from __future__ import annotations

import gc
import sys
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that are worked on at once. Spark's own batches (at most 10,000 rows and 64 MB unless the session says otherwise) are sliced.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`; nothing is copied."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Run fn on Arrow batches of at most `rows` rows. fn may return None for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            if (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def map_stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """As map_batches, for functions that keep state over one task's batches."""
    return df.mapInArrow(lambda batches: fn(slices(batches, rows)), schema)


def groups_of(batches: Iterator[pa.RecordBatch], by: int, rows: int = 65_536) -> Iterator[pa.Table]:
    """Whole groups of equal values of the first `by` columns, several together, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            whole = pa.Table.from_batches(held).combine_chunks()
            last = np.ones(whole.num_rows, bool)
            for k in range(by):
                values = whole.column(k).to_numpy()
                last &= values == values[-1]
            keep = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if keep:
                yield whole.slice(0, keep)
            held = whole.slice(keep).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def shared_folder(spark: SparkSession) -> str:
    """The folder for what jobs hand on: the one that the session names; a temporary one only where driver and executors are one machine."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and go on from there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def hashed_share(df: DataFrame, key: str | list[str], share: float | Column, seed: int = 7) -> DataFrame:
    """The rows whose key's 64-bit hash falls in the given share (0 to 1, a number or a column); the same rows at every partitioning."""
    keys = [key] if isinstance(key, str) else key
    if not isinstance(share, Column):
        if share >= 1:
            return df
        bound = F.lit(max(-(1 << 63), int(share * (1 << 64)) - (1 << 63)))
    else:
        # A product in double precision; a share of 1 or more takes everything.
        bound = F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((share * F.lit(float(1 << 64)) - F.lit(float(1 << 63))).cast("long"))
    return df.where(F.xxhash64(*keys, F.lit(seed)) < bound)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts, with null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


_NOTHING = object()


class Remembering(dict):
    """A dict that computes what it lacks and holds at most about `size` bytes besides `base`.

    It has two generations: when the younger one holds half the bytes, it becomes the older one, and what was older is
    dropped unless it is asked for again. Keys longer than `longest` are never kept."""

    #: Bytes of an entry in a dict besides its key and value.
    ENTRY = 110

    def __init__(self, compute: Callable, base: dict | None = None, size: int = 24 << 20, longest: int = 48):
        super().__init__()
        self.compute, self.base, self.half, self.longest = compute, base or {}, size // 2, longest
        self.older: dict = {}
        self.held = 0

    def __missing__(self, key):
        value = self.base.get(key, _NOTHING)
        if value is _NOTHING:
            value = self.older.get(key, _NOTHING)
            if value is _NOTHING:
                value = self.compute(key)
        if len(key) <= self.longest:
            if self.held >= self.half:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self.held += sys.getsizeof(key) + sys.getsizeof(value) + self.ENTRY
            self[key] = value
        return value


_per_worker: dict = {}


def per_worker(key, make: Callable):
    """The worker's one object: workers are reused between tasks and steps, and a step's object replaces the former step's."""
    if key not in _per_worker:
        _per_worker.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _per_worker[key] = make()
    return _per_worker[key]
