"""Global order without a single-task sort: exact samples, ranks and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.functions.numeric import unit_hash
from tenderlens.runtime import attach

_BUCKET_DIGITS = 4  # 65,536 hash buckets: a fixed bound on every histogram here


def _running_counts(hashed: DataFrame) -> DataFrame:
    """Rows up to and including each hash bucket (at most 65,536 rows)."""
    hist = hashed.groupBy(F.substring("_h", 1, _BUCKET_DIGITS).alias("_bucket")).count()
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    return hist.select("_bucket", "count", F.sum("count").over(upto).alias("_upto"))


def sample_exact(df: DataFrame, size: int, seed: int | str, keys: Sequence[str]) -> DataFrame:
    """Exactly ``min(size, n)`` rows, the same ones on any partitioning.

    ``keys`` must identify a row.  A histogram of hash prefixes finds the bucket
    that holds the last sampled row; rows beyond it are filtered where they are read
    and the others are ranked bucket by bucket, so no task gathers the sample.
    """
    hashed = df.withColumn("_h", unit_hash(seed, *keys))
    counts = _running_counts(hashed)
    cut = counts.filter(F.col("_upto") >= size).agg(
        F.coalesce(F.min("_bucket"), F.lit("ffff")).alias("_cut"))
    kept = attach(hashed, cut).withColumn("_bucket", F.substring("_h", 1, _BUCKET_DIGITS)).filter(
        F.col("_bucket") <= F.col("_cut"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", *keys))
    offsets = counts.select("_bucket", (F.col("_upto") - F.col("count")).alias("_before"))
    ranked = kept.withColumn("_in", inside).join(offsets, "_bucket")
    return ranked.filter(F.col("_before") + F.col("_in") <= size).select(*df.columns)


def global_rank(df: DataFrame, seed: int | str, keys: Sequence[str], name: str) -> DataFrame:
    """Position 1..n in hash order; each hash bucket is ranked by its own task."""
    hashed = df.withColumn("_h", unit_hash(seed, *keys)).withColumn(
        "_bucket", F.substring("_h", 1, _BUCKET_DIGITS))
    offsets = _running_counts(hashed).select(
        "_bucket", (F.col("_upto") - F.col("count")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", *keys))
    ranked = hashed.withColumn("_in", inside).join(offsets, "_bucket")
    return ranked.withColumn(name, F.col("_before") + F.col("_in")).drop(
        "_h", "_bucket", "_before", "_in")


def assign_folds(df: DataFrame, k: int, seed: int | str, keys: Sequence[str]) -> DataFrame:
    """Shuffled K-fold: column ``fold`` in 0..k-1, fold sizes within one."""
    ranked = global_rank(df, seed, keys, "_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def split_train_test(df: DataFrame, seed: int | str, keys: Sequence[str],
                     test_share: float = 0.2) -> DataFrame:
    """Column ``is_test``: a narrow, seeded, disjoint split by hash."""
    cut = format(int(test_share * 16**8), "08x")
    return df.withColumn("is_test", unit_hash(seed, *keys) < F.lit(cut))
