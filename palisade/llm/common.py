"""Shared pieces of the training-data operators: Arrow batches as byte arrays, words, hashes, shared-folder tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.plans.checkpoints import checkpointed
from palisade.plans.shipping import ship

#: Bytes of text that one Arrow batch, and one slice of it inside a task, may hold (a longer text is a slice of its own).
BATCH_BYTES = 8 << 20
SLICE_BYTES = 1 << 20

#: Bytes that separate words: the space and 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: Bytes of words made of digits, letters and every character above ASCII (after lower-casing A-Z).
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def bounded_batches(spark: SparkSession) -> None:
    """Let no Arrow batch hold much more than BATCH_BYTES, whatever the length of the texts, and let workers find the package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hasher:
    """Hashes of byte ranges from one prefix sum: sum of table[byte] * prime^i, mod 2^64, shifted back to i = 0."""

    def __init__(self, seed: int = 1):
        self.table = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.size = 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size, 1 << 16)
            self.power = np.ones(self.size, np.uint64)
            self.power[1:] = np.uint64(_PRIME)
            np.cumprod(self.power, out=self.power)
            self.back = np.ones(self.size, np.uint64)
            self.back[1:] = np.uint64(_INVERSE)
            np.cumprod(self.back, out=self.back)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=sums[1:])
        return sums

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.back[starts])


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column: first row, end row, bytes, and offsets into them. Nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset:]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end
    pa.default_memory_pool().release_unused()


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that are inside a word; rows never share a word."""
    is_in = inside[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts, ends = is_in.copy(), is_in.copy()
    starts[1:] &= ~is_in[:-1]
    starts[edges] = is_in[edges]
    ends[:-1] &= ~is_in[1:]
    ends[edges - 1] = is_in[edges - 1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(offsets, first, side="right") - 1


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in a sorted list of row numbers; one more entry ends the last."""
    return np.searchsorted(rows, np.arange(n + 1))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for own columns that no column of the frame has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_text(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, int]:
    """The `keep` columns and the text, once, and the place of the text."""
    if text in keep:
        return docs.select(*keep), keep.index(text)
    return docs.select(*keep, F.col(text).alias(fresh(docs, "text")[0])), len(keep)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table below spark.checkpoint.dir, read back: narrower reads than of a checkpoint, and no lineage."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        return checkpointed(df)
    path = f"{folder.rstrip('/')}/palisade-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = [
    "ALNUM", "BATCH_BYTES", "BLANK", "Hasher", "LOWER", "bounded_batches", "checkpointed", "fresh", "mix", "row_bounds",
    "signed", "table", "text_remainder", "text_slices", "with_text", "words", "written",
]
