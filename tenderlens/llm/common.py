"""Arrow and numpy helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20  # text handled at once inside a task; a longer text is a chunk of its own
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Shared:
    """An object of this package, sent to every worker once and by value.

    A broadcast is pickled by reference, which needs the package on the worker; the bytes of a
    pickle by value do not.  A worker unpickles them once and keeps the object beside them.
    """

    def __init__(self, spark: SparkSession, held: Any):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(held))

    @property
    def value(self) -> Any:
        if not hasattr(self._sent, "_held"):
            self._sent._held = pickle.loads(self._sent.value)
        return self._sent._held

    def destroy(self) -> None:
        """Frees the copies in memory and on disk; nothing may use the object afterwards."""
        self._sent.destroy()


def fold(id_column: str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % parts, F.lit(0))


def fold_of(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); a null text is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` text bytes at most; never splits a text."""
    for batch in batches:
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class SpanHash:
    """64-bit hashes of many spans of one byte array, from one running sum."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        codes = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64)
        powers = np.full(len(data) + 1, _BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.back = np.full(len(data) + 1, _INVERSE, np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * powers[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def runs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(member.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def split_runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True cut at text borders: (starts, ends, text number)."""
    starts, ends = runs(member)
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(member))])
    cut = inner[member[inner] & member[inner - 1]] if len(inner) else inner
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def byte_class(*groups: tuple[int, int] | int) -> np.ndarray:
    """Lookup table over byte values: True inside the given values and ranges."""
    found = np.zeros(256, bool)
    for g in groups:
        low, high = g if isinstance(g, tuple) else (g, g)
        found[low:high + 1] = True
    return found


SPACE = byte_class(0x20, (0x09, 0x0D))  # white space of the word rule [^\x20\x09-\x0D]+
LETTER = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per row from its flat values."""
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
