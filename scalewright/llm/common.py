"""Helpers shared by the text operators: batch bounds, shared storage, vectorised hashing."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch at most; with texts of 100 kB this stays near 50 MB.
BATCH_ROWS = 512
#: Bytes of text that are hashed together; the work arrays take about 50 times as much and should fit in a core's cache.
BLOCK_BYTES = 1 << 18

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names, which driver and executors share.

    Only a local master may do without: there a temporary folder serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


class Scratch:
    """Tables of one operator in the shared folder.

    ``put`` writes a table and reads it again, so its lineage ends there; ``close`` deletes
    what was put. Tables that the result reads are written by ``keep`` and stay.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self._n = spark, shared_dir(spark), 0

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        return self._write(df, f"{self.path}/work/{self._n:02d}_{name}")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        return self._write(df, f"{self.path}/{self._n:02d}_{name}")

    def close(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/work")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    return Scratch(df.sparkSession).keep(df, name)


#: Bytes of a table that is broadcast at most; larger ones are shuffled.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, size: Column | int = 16) -> DataFrame:
    """``df``, a written table, marked for broadcasting if its rows sum to at most BROADCAST_BYTES.

    ``size`` is what a row takes, as a number or by row. Rows cost 32 bytes besides.
    """
    n = df.agg(F.sum(F.lit(32) + size)).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def bare(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns named by place, and their names, so that none clashes with an operator's own."""
    return df.toDF(*(f"_in{k}" for k in range(len(df.columns)))), df.columns


def column_at(names: list[str], name: str) -> str:
    """The name by place of the column that ``name`` means, as Spark resolves it: by case if one fits, else without."""
    fits = [k for k, c in enumerate(names) if c == name] or [k for k, c in enumerate(names) if c.lower() == name.lower()]
    if len(fits) != 1:
        raise ValueError(f"{len(fits)} columns are named {name}")
    return f"_in{fits[0]}"


def part_keys(n: int) -> np.ndarray:
    """Integers that Spark's hash partitioning into n deals to the partitions 0 to n - 1, one each."""
    found = np.full(n, -1, np.int64)
    start = 0
    while (found < 0).any():
        x = np.arange(start, start + 16 * n, dtype=np.uint32)
        at = (_murmur(x).astype(np.int64) % n).astype(np.int64)
        there, first = np.unique(at, return_index=True)
        new = found[there] < 0
        found[there[new]] = x[first[new]]
        start += 16 * n
    return found.astype(np.int32)


def _murmur(x: np.ndarray) -> np.ndarray:
    """Murmur3 of 32-bit integers with seed 42, as signed numbers."""
    turn = lambda v, k: (v << np.uint32(k)) | (v >> np.uint32(32 - k))
    h = np.uint32(42) ^ (turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
    h = turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def trimmed(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``function`` for mapInArrow, after which the worker gives freed memory back.

    A worker serves tasks of many stages, and what each once needed at most would add up.
    """

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values of a seed."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _GOLDEN)


_STEP = 0x9FB21C651E98DF25
_powers = {step: np.ones(1, np.uint64) for step in (_STEP, pow(_STEP, -1, 1 << 64))}


def powers(n: int, step: int = _STEP) -> np.ndarray:
    """The first n powers of an odd number, modulo 2^64."""
    known = _powers[step]
    if n > len(known):
        known = np.full(max(n, 2 * len(known)), step & (2**64 - 1), np.uint64)
        known[0] = 1
        known = np.cumprod(known)
        if n <= 16 * BLOCK_BYTES:
            _powers[step] = known
    return known[:n]


def hash_words(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes, and where each starts.

    ``lower`` folds A-Z only. A word's hash is a polynomial of its bytes; running sums over
    all bytes give it for each word at the cost of one subtraction.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Bytes wrap around, so one comparison tests a range.
    space = (data == 0x20) | (data - np.uint8(0x09) < 5)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.append(0, edge)
    if len(edge) % 2:
        edge = np.append(edge, len(data))
    starts, ends = edge[::2], edge[1::2]
    value = data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)) if lower else data
    sums = np.multiply(powers(len(data)), value + np.uint8(1), dtype=np.uint64)
    np.cumsum(sums, out=sums)
    value = sums[ends - 1]
    value[starts > 0] -= sums[starts[starts > 0] - 1]
    value *= powers(len(data), pow(_STEP, -1, 1 << 64))[starts]
    return mix(value + (ends - starts).astype(np.uint64)), starts


def blocks(sizes: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items of about ``limit`` together; a larger item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column with a newline behind each row, and the offsets of its rows; nulls count as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    column = pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8), offsets
