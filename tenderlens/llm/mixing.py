"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every document first gets its certain whole copies (target over source size, rounded down).
For the rest, documents of a source are ranked by random odds over inclusion odds and taken
in that order until the words still missing are reached: a sample of fixed size, counted in
words, with unequal probabilities between sources (and between documents, when odds are given).

No source is ever sorted in one task.  The rank at which the words run out is found with two
histograms of 4,096 bins per source, so the last, exact step sorts about one row in 16 million.
What is known per source is written before it is joined to the documents: Spark then sees that
it is small and leaves the documents where they are, instead of dealing them by source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.runtime import materialize

BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(doc_id: Column, text: Column, seed: int) -> Column:
    """Uniform in (0, 1), the same in every run."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, F.coalesce(text, F.lit(""))), 12)
    return (bits + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Words to take from each source: source, source_size, target.

    ``sizes`` has source, source_size: one row per source, a small table.  Sources in code
    point order, null last, take the weights in turn.  All words are shared by weight; no
    source is asked for more than ``most`` times its size and the excess goes to the others by
    weight.  That level is the first, in order of limit over weight, at which the sources
    from there on stay within their limits.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    with_limits = sizes.select(
        "source", "source_size", (F.col("source_size") * most).cast("double").alias("_limit"),
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("_weight"))
    rising = Window.orderBy(F.col("_limit") / F.col("_weight"), F.asc_nulls_last("source"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    weight_left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    level = with_limits.withColumn("_level", left / weight_left)
    fits = F.when(F.col("_level") <= F.col("_limit") / F.col("_weight"), F.col("_level"))
    common = F.max(fits).over(everything)
    return level.withColumn("_common", common).select(
        "source", "source_size",
        F.coalesce(F.least("_limit", F.col("_common") * F.col("_weight")), F.col("_limit")).alias("target"))


def _attach(rows: DataFrame, small: DataFrame) -> DataFrame:
    """Add the columns of one row per source; Spark broadcasts it when it is small."""
    other = small.withColumnRenamed("source", "_source")
    return rows.join(other, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _boundary(rows: DataFrame, bin_: Column, missing: str) -> DataFrame:
    """Per source, the bin in which the missing words are reached, and what is missing there."""
    counted = rows.groupBy("source", missing, bin_.alias("_bin")).agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    running = counted.withColumn("_upto", F.sum("_words").over(upto))
    hit = running.filter((F.col("_upto") > F.col(missing)) & (F.col("_upto") - F.col("_words") <= F.col(missing)))
    return hit.select("source", "_bin", (F.col(missing) - F.col("_upto") + F.col("_words")).alias("_missing"))


def plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: source_size, target, copies (certain) and cut, the last key that is taken once more.

    ``sized`` has source, size, draw, odds, doc_id.
    """
    quota = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    quota = quota.withColumn("copies", F.floor(share + 1e-12)).withColumn(
        "_share", F.greatest(share - F.col("copies"), F.lit(0.0))).withColumn(
        "_rest", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0)))
    quota = materialize(quota, "mix-quota")
    keyed = _attach(sized, quota.filter("_rest > 0").select("source", "_share", "_rest")).withColumn("_key", key())
    first = materialize(_boundary(keyed, F.floor(F.col("_key") * BINS), "_rest").withColumnRenamed("_bin", "_bin1"), "mix-bins")
    inner = _attach(keyed.drop("_rest"), first).filter(F.floor(F.col("_key") * BINS) == F.col("_bin1"))
    second = materialize(_boundary(inner, F.floor(F.col("_key") * (BINS * BINS)), "_missing").withColumnRenamed(
        "_bin", "_bin2"), "mix-fine-bins")
    last = _attach(inner.drop("_missing"), second).filter(F.floor(F.col("_key") * (BINS * BINS)) == F.col("_bin2"))
    upto = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    near = F.sum("size").over(upto) - F.col("size") / 2 <= F.col("_missing")
    taken = last.select("source", "_key", "_bin2", near.alias("_near"))
    # Keys below the last bin are all taken; in it, up to the last near one.
    cut = taken.groupBy("source").agg(F.coalesce(
        F.max(F.when(F.col("_near"), F.col("_key"))),
        F.max(F.col("_bin2")) / float(BINS * BINS) - 1e-18).alias("cut"))
    other = cut.withColumnRenamed("source", "_source")
    found = quota.join(other, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "source", "source_size", "target", "copies", "_share",
        F.coalesce("cut", F.lit(-1.0)).alias("cut"))
    return materialize(found, "mix-plan")


def key() -> Column:
    """Random odds over inclusion odds, as a number in (0, 1)."""
    ratio = (F.col("draw") / (1 - F.col("draw"))) * (1 - F.col("_share"))
    return ratio / (ratio + F.col("_share") * F.col("odds"))


def sized_rows(docs: DataFrame, seed: int = 42, odds: Column | None = None, size: Column | None = None,
               doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size in words, a repeatable draw and the document's odds (default 1)."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        (n_words(F.col(text)) if size is None else size).alias("size"),
        _draw(F.col(doc_id), F.col(text), seed).alias("draw"),
        (F.lit(1.0) if odds is None else odds.cast("double")).alias("odds"))


def _copies() -> Column:
    return F.when(F.col("size") > 0, F.col("copies") + (key() <= F.col("cut")).cast("long")).otherwise(0)


def allocate(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 42,
             odds: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per document.

    A null text or one without words has size 0 and is taken 0 times.  A null source is a
    source.  Equal (doc_id, text) rows draw alike and are taken alike.  Reruns agree.
    """
    sized = materialize(sized_rows(docs, seed, odds), "mix-sized")
    placed = _attach(sized, plan(sized, weights, most)).withColumn("copies", _copies().cast("int"))
    return placed.select("doc_id", "source", "size", "source_size", "target", "copies",
                         (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 42) -> DataFrame:
    """The mixed corpus: every document as many times as it is taken, with its own columns."""
    sized = materialize(sized_rows(docs, seed), "mix-sized")
    quota = plan(sized, weights, most)
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.col("source").alias("source"),
                       F.when(F.col("text").rlike(WORD), 1).otherwise(0).alias("size"),
                       _draw(F.col("doc_id"), F.col("text"), seed).alias("draw"), F.lit(1.0).alias("odds"))
    placed = _attach(rows, quota).withColumn("_copies", _copies().cast("int")).filter("_copies > 0")
    spread = placed.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    return spread.select("_row.*")
