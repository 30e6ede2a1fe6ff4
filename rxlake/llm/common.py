"""Helpers the operators share: the shared folder, stored tables, byte blocks, rolling hashes."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BLOCK = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it is not installed but lies in the same place."""
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, path]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where the session runs on this machine alone."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def released(run):
    """The batch function, after which its worker gives freed memory back to the machine: workers are kept between
    stages, and what one stage needed at its peak would stay with them."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not this C library
            pass

    return wrapped


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Written as a table into the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/documents.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets; a null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if column.offset:
        column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes together; a longer row stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            inverse = pow(BASE, -1, 1 << 64)
            up, down = np.full(size, BASE, np.uint64), np.full(size, inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up, self.down


POWERS = Powers()


class RangeHash:
    """Hashes of any byte ranges of one block from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = POWERS.get(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * up[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(value + (end - start).astype(np.uint64) * ODD)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-byte window; k is a power of two."""
    value, width = BYTE_VALUE[data], 1
    while width < k:
        value = value[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + value[width:]
        width *= 2
    return mixed(value)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths: the run of each element, and its place in the run."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tokens_of(data: np.ndarray, offsets: np.ndarray, part_of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of word bytes (a 256-entry truth table says which those are)."""
    inside = part_of_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1][offsets[1:-1] < len(data)]
    first[cuts] = inside[cuts]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0] - 1
    last[cuts] = inside[cuts]
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def passed(batch: pa.RecordBatch, drop: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch without some columns and with new ones at its end."""
    names = [n for n in batch.schema.names if n not in drop and n not in new]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new.values()], [*names, *new])
