"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves every pre-token that is a
vocabulary entry as a whole.  Tier two: the others are merged with a heap of adjacent pairs
over a linked list of their bytes, lowest rank first, which is O(n log n) for a pre-token of
any length.  The vocabulary has a fixed size, so it is broadcast.
"""

from __future__ import annotations

import base64
import gc
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tenderlens.llm.common import Shared, chunks, lists

MEMO_BYTES = 192 << 20  # memory for the words that a Python worker remembers, about
_ENTRY = 240  # bytes that a remembered word takes besides its ids and letters


class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots, one check of the stored key.

    Keys share about n/3 buckets.  From the fullest bucket on, each gets the first
    displacement that puts its keys on free slots; buckets of one key name their slot.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = max(len(keys), 1)
        self.n_buckets = n // 3 + 1
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        hashes = [xxhash.xxh3_128_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets[h % self.n_buckets].append(i)
        shift = [0] * self.n_buckets
        slots: list[int | None] = [None] * n
        order = sorted(range(self.n_buckets), key=lambda b: -len(buckets[b]))
        free = iter(())
        for at, b in enumerate(order):
            members = buckets[b]
            if len(members) <= 1:
                free = (s for s in range(n) if slots[s] is None)
                for one in order[at:]:
                    if buckets[one]:
                        slot = next(free)
                        slots[slot] = buckets[one][0]
                        shift[one] = -slot - 1
                break
            d = 0
            while True:
                places = [self._place(hashes[i], d) for i in members]
                if len(set(places)) == len(places) and all(slots[p] is None for p in places):
                    break
                d += 1
            shift[b] = d
            for i, p in zip(members, places, strict=True):
                slots[p] = i
        self.shift = shift
        self.keys = [keys[i] if i is not None else b"" for i in slots]
        self.values = [values[i] if i is not None else -1 for i in slots]

    def _place(self, h: int, d: int) -> int:
        x = ((h >> 64) ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 31)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        return (x >> 29) % self.n

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[h % self.n_buckets]
        slot = -d - 1 if d < 0 else self._place(h, d)
        return self.values[slot] if self.keys[slot] == key else -1


class Vocabulary:
    """Ranks of a byte-level vocabulary; id = rank."""

    def __init__(self, lines: list[tuple[bytes, int]], pattern: str):
        self.pattern = pattern
        self.whole = PerfectHash([k for k, _ in lines], [r for _, r in lines])
        top = max((r for _, r in lines), default=-1) + 1
        text = [b""] * top
        for k, r in lines:
            text[r] = k
        self.text, self.encoder = text, None
        # Every way to put an entry together from two: a pair that is not here never merges.
        ranks = dict(lines)
        joins = [(ranks[k[:i]] << 32 | ranks[k[i:]], r) for k, r in lines for i in range(1, len(k))
                 if k[:i] in ranks and k[i:] in ranks]
        self.joins = np.array(joins, np.int64).reshape(-1, 2)
        self.pairs = dict(joins)
        self.bytes = [self.whole.get(bytes([b])) for b in range(256)]
        if min(self.bytes) < 0:
            raise ValueError("a byte-level vocabulary holds all 256 bytes")
        self.lengths = np.array([len(t) for t in text], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1] if top else np.zeros(0, np.int64)
        self.data = np.frombuffer(b"".join(text), np.uint8)

    @classmethod
    def load(cls, spark: SparkSession, path: str, pattern: str) -> Vocabulary:
        """From a rank file (base64 token, rank) on the driver's own disk."""
        with open(path, "rb") as f:
            return cls([(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)], pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is not a vocabulary entry."""
        rank_of, n = self.pairs.get, len(piece)
        of_byte = self.bytes
        ids = [of_byte[b] for b in piece]  # id of the part that begins here; -1: merged away
        # Rank of a pair, then where its left part begins; lowest first.
        heap = [r << 32 | i for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank_of(a << 32 | b)) is not None]  # noqa: B905
        if not heap:
            return ids
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            left = ids[i]
            if left < 0:
                continue
            j = after[i]
            if j >= n or rank_of(left << 32 | ids[j]) != r:
                continue  # one of the two parts has changed since
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (up := rank_of(r << 32 | ids[k])) is not None:
                    heappush(heap, up << 32 | i)
            h = before[i]
            if h >= 0 and (up := rank_of(ids[h] << 32 | r)) is not None:
                heappush(heap, up << 32 | h)
        return [x for x in ids if x >= 0]

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        found = self.whole.get(raw)
        return [found] if found >= 0 else self.merge(raw)

    def __getstate__(self):
        return self.__dict__ | {"pairs": None, "encoder": None}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.pairs = dict(self.joins.tolist())

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows, byte offsets of the rows) for rows of ``sizes`` ids."""
        width = self.lengths[ids]
        stops = np.cumsum(width)
        total = int(stops[-1]) if len(stops) else 0
        place = np.arange(total, dtype=np.int64) + np.repeat(self.starts[ids] - (stops - width), width)
        rows = np.concatenate([[0], np.cumsum(sizes)])
        return self.data[place], np.concatenate([[0], stops])[rows]


class Encoder:
    """Encodes texts; remembers the words between single spaces as packed ids.

    A cut before a space that touches a non-space is also a border between pre-tokens (a
    space is only ever the first character of one, or part of a run of white space), so a word
    can be looked up without splitting it by the pattern again.  What is remembered is bounded
    in bytes: when the younger half is full it becomes the older one, so frequent words stay.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.piece = vocabulary.encode_piece
        self.split = regex.compile(vocabulary.pattern).findall
        self.words: dict[str, bytes] = {}  # by the word after its space
        self.older: dict[str, bytes] = {}
        self.room = MEMO_BYTES // 2

    def _word(self, word: str) -> bytes:
        found = self.words.get(word) or self.older.get(word)
        if not found:
            # Letters after a space are one pre-token.
            found = _packed(self.piece(" " + word)) if word.isalpha() else self._text(" " + word)
        if len(word) <= 64:
            if self.room <= 0:
                self.older, self.words, self.room = self.words, {}, MEMO_BYTES // 2
            self.words[word] = found
            self.room -= _ENTRY + len(found)
        return found

    def _text(self, text: str) -> bytes:
        parts = []
        for piece in self.split(text):
            if piece[0] == " " and piece[1:].isalpha():
                parts.append(self.words.get(piece[1:]) or self._word(piece[1:]))
            else:
                parts.append(_packed(self.piece(piece)))
        return b"".join(parts)

    def packed(self, text: str) -> bytes:
        """Ids as 32-bit integers, one after the other."""
        if _INNER.search(text):
            return self._text(text)
        first, *rest = text.split(" ")
        parts, words, new = [self._text(first)], self.words.get, self._word
        parts += [words(word) or new(word) for word in rest]
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


_INNER = re.compile(r"\s \s|\s \Z")  # a space inside a longer run of white space, or at the end of the last one


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, text: str, ids: str):
    encoder = vocabulary.encoder = vocabulary.encoder or Encoder(vocabulary)
    for batch in chunks(batches, text):
        gc.disable()  # nothing here makes cycles, and the remembered words are many
        try:
            found = [encoder.packed(value or "") for value in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        finally:
            gc.enable()
        sizes = np.array([len(f) for f in found], np.int64) // 4
        column = lists(np.frombuffer(b"".join(found), np.int32), sizes, pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, ids])


def _decoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, ids: str, decoded: str):
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            column = batch.column(batch.schema.get_field_index(ids))
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = vocabulary.decode(flat, sizes)
            out = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [
                None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*batch.columns, out.cast(pa.binary())], [*batch.schema.names, decoded])


_IDS = T.ArrayType(T.IntegerType())


def _map(docs: DataFrame, vocabulary: Vocabulary, added: dict[str, T.DataType], *steps) -> DataFrame:
    """One pass through Python; the broadcast vocabulary, with what it remembers, serves all tasks of a worker."""
    shared = Shared(docs.sparkSession, vocabulary)
    docs = docs.drop(*added)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in added.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, *columns in steps:
            batches = step(batches, shared.value, *columns)
        return batches

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids`` array<int>: each match of the pattern encoded by itself, no special tokens.

    A null text counts as empty and has no ids.  Rows and their other columns stay; an
    earlier column of that name is replaced.
    """
    return _map(docs, vocabulary, {ids: _IDS}, (_encoded, text, ids))


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded`` binary: the bytes of the ids.  Null ids count as none."""
    return _map(docs, vocabulary, {decoded: T.BinaryType()}, (_decoded, ids, decoded))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids",
               decoded: str = "decoded") -> DataFrame:
    """Adds ``ids`` and ``decoded``, the bytes the ids stand for, in one pass through Python."""
    return _map(docs, vocabulary, {ids: _IDS, decoded: T.BinaryType()}, (_encoded, text, ids), (_decoded, ids, decoded))
