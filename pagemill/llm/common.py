"""What the training-data operators share: session limits, table access, scratch tables, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagemill.session import settled

#: Arrow batches end at this many rows or bytes, so that a task's memory follows the batch and
#: its longest text, never the partition.
BATCH_ROWS = 2_000
BATCH_BYTES = 4 << 20


def limit_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    limit_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(rows: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one batch to columns of the result."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(batch), schema=kind)
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task keeps little

    return rows.mapInArrow(run, schema)


_in_use: dict = {}


def held(key: object, make: Callable[[], object]):
    """What ``make`` gives, kept in the worker process until something else is asked for.

    Workers are reused by other tasks, also of other operators: each holds one model at a time.
    """
    if key not in _in_use:
        _in_use.clear()
        _in_use[key] = make()
    return _in_use[key]


def word_hashes(words: list) -> np.ndarray:
    """A 64-bit hash of each word; the same on every machine."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words; of the whole text if it has fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    count = len(words) - size + 1
    mixed = words[:count].copy()
    for k in range(1, size):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed += words[k : k + count]
    return scramble(mixed)


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a finaliser of multiplications and shifts)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Ragged:
    """Columns of rows of different sizes, one after another."""

    def __init__(self, sizes: list[int], **columns: np.ndarray):
        self.columns = columns
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def taken(self, which: np.ndarray) -> Ragged:
        """The rows of these numbers."""
        at = spread(self.starts[which], self.sizes[which])
        return Ragged(self.sizes[which], **{k: v[at] for k, v in self.columns.items()})

    def extend(self, sizes: np.ndarray, **columns: np.ndarray) -> None:
        end = len(next(iter(self.columns.values())))
        self.starts = np.concatenate([self.starts, end + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.columns = {k: np.concatenate([v, columns[k].astype(v.dtype)]) for k, v in self.columns.items()}


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of rows of these starts and sizes, row after row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


__all__ = ["limit_batches", "table", "map_batches", "word_hashes", "shingle_hashes", "scramble", "settled", "held", "Ragged", "spread"]
