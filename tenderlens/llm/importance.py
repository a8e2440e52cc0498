"""Target-distribution importance resampling over hashed n-grams, ranked by a distributed radix sort.

Every document becomes an array of buckets: the crc32 of each word and word pair modulo the
number of buckets.  Counts of all buckets over the corpus and over the target give each bucket
a gain; a document's weight is the mean gain of its array.  Adding a Gumbel draw of the
document's id and taking the highest sums samples without replacement by importance.

The order is found by a least-significant-digit radix sort over the composite key (score
descending, id ascending).  A pass is a stable counting sort: rows lie in blocks of consecutive
positions, each block counts its digits, prefix sums over (digit, block) give every digit of
every block its first destination, and a row's rank inside its block and digit does the rest.
No range of the order is ever gathered: a task holds one digit of one block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlens.llm.common import LETTER, LOWER, chunks, lists, split_runs, utf8
from tenderlens.runtime import materialize

BUCKETS = 10_000
LONG_WORD = 64  # bytes of a word that are hashed side by side with other words; the rest goes word by word
DIGIT_BITS = 8
BLOCK = 1 << 14  # consecutive positions whose digits are counted together
_FLIP = 1 << 63


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc_states(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 register of many spans at once, each continued from its own register."""
    order = np.argsort(starts - ends, kind="stable")  # longest first
    length, first = (ends - starts)[order], starts[order]
    out = state[order]
    for j in range(min(int(length[0]) if len(length) else 0, LONG_WORD)):
        m = int(np.searchsorted(-length, -j, "left"))  # spans longer than j
        out[:m] = _CRC[(out[:m] ^ data[first[:m] + j]) & 0xFF] ^ (out[:m] >> 8)
    for i in range(int(np.searchsorted(-length, -LONG_WORD, "left"))):
        rest = data[first[i] + LONG_WORD:first[i] + length[i]].tobytes()
        out[i] = zlib.crc32(rest, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    found = np.empty_like(out)
    found[order] = out
    return found


def feature_buckets(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(words of every text, buckets of all their words and word pairs, text by text)."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, text_of = split_runs(LETTER[data], offsets)
    words = np.bincount(text_of, minlength=len(offsets) - 1)
    single = crc_states(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, ends)
    pair = np.flatnonzero(text_of[1:] == text_of[:-1])  # words that another one of their text follows
    spaced = _CRC[(single[pair] ^ 0x20) & 0xFF] ^ (single[pair] >> 8)
    double = crc_states(spaced, data, starts[pair + 1], ends[pair + 1])
    order = np.argsort(np.concatenate([text_of, text_of[pair]]), kind="stable")
    found = (np.concatenate([single, double]) ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)
    return words, found[order].astype(np.int32)


def bucket_arrays(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Adds n_words and ``buckets``, one entry per word and word pair; replaces columns of these names.

    Letters A-Z are lowered; words are runs of digits, letters a-z and bytes beyond ASCII.
    A null text has none.
    """
    docs = docs.drop("n_words", "buckets")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()),
                           T.StructField("buckets", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            words, flat = feature_buckets(batch.column(batch.schema.get_field_index(text)), buckets)
            column = lists(flat, np.maximum(2 * words - 1, 0), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.int64()), column],
                                             [*batch.schema.names, "n_words", "buckets"])

    return docs.mapInArrow(run, schema)


def bucket_counts(arrays: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, count over all rows; every task sends one row per bucket at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(flat.astype(np.int64), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "count"])

    partial = arrays.select("buckets").mapInArrow(run, "bucket int, count long")
    return partial.groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio in thousandths of target to corpus frequency per bucket, one added to every count.

    Both tables are (bucket, count); the result has a fixed size.
    """
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("count", "s"), "bucket", "left").join(
        target.withColumnRenamed("count", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    all_s, all_t = (F.sum(c).over(Window.partitionBy()).cast("double") for c in ("s", "t"))
    ratio = ((F.col("t") + 1.0) * (all_s + float(buckets))) / ((F.col("s") + 1.0) * (all_t + float(buckets)))
    rows = both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).orderBy("bucket").collect()
    return np.array([r["gain"] for r in rows], np.int64)


def weigh(arrays: DataFrame, gain: np.ndarray) -> DataFrame:
    """Adds n_features and weight, the mean gain rounded down (no features: 0); drops the arrays."""
    shared = arrays.sparkSession.sparkContext.broadcast(gain)  # one number per bucket
    kept = [f for f in arrays.schema.fields if f.name != "buckets"]
    schema = T.StructType([*kept, T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("buckets"))
            n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(shared.value[column.flatten().to_numpy(zero_copy_only=False)])])
            stops = np.cumsum(n)
            weight = (upto[stops] - upto[stops - n]) // np.maximum(n, 1)
            rest = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n), pa.array(weight)], schema.names)

    return arrays.mapInArrow(run, schema)


def gumbel(doc_id: Column, seed: int) -> Column:
    """A repeatable Gumbel draw in thousandths, from the first 32 bits of the id's digest."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    unit = (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(unit)))


def _digits(low: int, high: int) -> list[int]:
    """Shifts of the digits that can differ between two 64-bit keys, least significant first."""
    varying = ((low ^ _FLIP) ^ (high ^ _FLIP)) & ((1 << 64) - 1)
    return list(range(0, varying.bit_length(), DIGIT_BITS))


def counting_pass(rows: DataFrame, key: str, shift: int, block: int = BLOCK) -> DataFrame:
    """Rows moved to their place in a stable sort by one digit of ``key``.

    ``_at`` orders the rows, ``_block`` is a range of ``_at``; afterwards ``_at`` is 0..n-1.
    """
    flipped = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))  # signed order as unsigned order
    dealt = rows.withColumn("_digit", F.shiftrightunsigned(flipped, shift).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int"))
    counts = materialize(dealt.groupBy("_digit", "_block").agg(F.count(F.lit(1)).alias("_rows")), "radix-counts")
    lower = Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.groupBy("_digit").agg(F.sum("_rows").alias("_all")).select(  # one row per digit
        F.col("_digit").alias("_of"), F.coalesce(F.sum("_all").over(lower), F.lit(0)).alias("_first"))
    earlier = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("_earlier", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    offsets = materialize(inside.join(first, F.col("_digit") == F.col("_of")).select(
        "_digit", "_block", (F.col("_first") + F.col("_earlier")).alias("_offset")), "radix-offsets")
    place = F.row_number().over(Window.partitionBy("_digit", "_block").orderBy("_at"))
    moved = dealt.withColumn("_in", place).join(offsets, ["_digit", "_block"]).withColumn(
        "_at", F.col("_offset") + F.col("_in") - 1).withColumn("_block", F.expr(f"_at div {block}"))
    return materialize(moved.select(rows.columns), "radix-rows")


def radix_sorted(rows: DataFrame, keys: Sequence[str], name: str = "rank", block: int = BLOCK) -> DataFrame:
    """Adds the 1-based rank in ascending order of the long columns ``keys``, most significant first.

    Keys are not null.  Rows with equal keys get consecutive ranks.  Only digits in which
    the smallest and the largest key differ take a pass; the number of passes depends on the
    keys' range, never on the rows.
    """
    at = F.monotonically_increasing_id()
    rows = materialize(rows.withColumn("_at", at).withColumn("_block", F.shiftright("_at", 33)), "radix-rows")
    ends = rows.agg(*[f(k).alias(f"{n}_{i}") for i, k in enumerate(keys) for n, f in (("min", F.min), ("max", F.max))]).first()
    passes = [(k, shift) for i, k in reversed(list(enumerate(keys))) if ends[f"min_{i}"] is not None
              for shift in _digits(ends[f"min_{i}"], ends[f"max_{i}"])]
    for key, shift in passes or [(keys[-1], 0)]:  # positions become dense in any pass
        rows = counting_pass(rows, key, shift, block)
    return rows.withColumn(name, F.col("_at") + 1).drop("_at", "_block")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7,
             buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null when not drawn).

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred (rounded
    down) with the highest scores are drawn; ties go to the smaller id, a null id counts as
    the largest.  Rows that share an id are documents of their own with one draw in common.
    An empty target gives every bucket its corpus rarity alone; an empty table has no rows.
    """
    arrays = materialize(bucket_arrays(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")),
                                       buckets=buckets).drop("text"), "resample-buckets")
    wanted = bucket_arrays(target.select(F.col(target_text).alias("text")), buckets=buckets)
    gain = gains(bucket_counts(arrays, buckets), bucket_counts(wanted, buckets), buckets)
    scored = materialize(weigh(arrays, gain).withColumn(
        "score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "resample-scored")
    able = F.col("n_words") >= least_words
    out = ["doc_id", "n_features", "weight", "score"]
    keyed = scored.filter(able).select(*out, (-F.col("score")).alias("_falling"),
                                       F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_id"))
    drawn = keyed.count() * percent // 100
    ranked = radix_sorted(keyed, ["_falling", "_id"], "_rank").select(
        *out, F.when(F.col("_rank") <= drawn, F.col("_rank")).alias("rank"))
    return ranked.unionByName(scored.filter(~able).select(*out, F.lit(None).cast("long").alias("rank")))
