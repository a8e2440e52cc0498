"""Exact quantiles of arbitrarily large groups.

The built-in exact percentile keeps every distinct value of a group in one
buffer, so it serves only while the largest group is known to be small.  Beyond
that a bounded sketch brackets the answer, one partial aggregation counts what
lies below the bracket and keeps the few values inside it, and running counts
over bins, then within a bin, pick the exact order statistics.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.functions.numeric import clean_double
from tenderlens.runtime import attach, materialize

_ACCURACY = 10_000
_MARGIN = 6.0 / _ACCURACY
_BINS = 4096
BUFFER_ROWS = 200_000  # largest group handed to the built-in percentile


def exact_quantiles(
    df: DataFrame,
    specs: Mapping[str, tuple[str, float]],
    by: Sequence[str] = (),
    size_as: str | None = None,
    buffer_rows: int = BUFFER_ROWS,
) -> DataFrame:
    """One row per ``by`` key with a linearly interpolated quantile per spec.

    ``specs`` maps an output name to (column, q).  Null and NaN are ignored; a
    group without values gives null.  ``size_as`` adds the row count of the group.
    """
    by, names = list(by), list(specs)
    base = df.select(*by, *[clean_double(F.col(c)).alias(f"_v{i}")
                            for i, (c, _) in enumerate(specs.values())])

    aggs: list[Column] = []
    for i, (_, q) in enumerate(specs.values()):
        bounds = [max(q - _MARGIN, 0.0), min(q + _MARGIN, 1.0)]
        aggs += [F.count(f"_v{i}").alias(f"_n{i}"),
                 F.percentile_approx(f"_v{i}", bounds, _ACCURACY).alias(f"_b{i}")]
    sketch = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"), *aggs)
    # A group no larger than the sketch is kept whole; it is small by definition.
    brackets = materialize(sketch.select(*by, "_size", *[
        c for i in range(len(names)) for c in (
            F.col(f"_n{i}"),
            F.when(F.col(f"_n{i}") > _ACCURACY, F.col(f"_b{i}")[0])
            .otherwise(F.lit(float("-inf"))).alias(f"_lo{i}"),
            F.when(F.col(f"_n{i}") > _ACCURACY, F.col(f"_b{i}")[1])
            .otherwise(F.lit(float("inf"))).alias(f"_hi{i}"))]), "brackets")

    largest = brackets.agg(F.max(F.greatest(F.lit(0), *[F.col(f"_n{i}") for i in range(len(names))]))).first()[0]
    if (largest or 0) <= buffer_rows:
        values = base.groupBy(*by).agg(*[
            F.percentile(f"_v{i}", q).alias(n) for i, (n, (_, q)) in enumerate(specs.items())],
            *([F.count(F.lit(1)).alias(size_as)] if size_as else []))
        return materialize(values, "quantiles")

    def entry(i: int) -> Column:
        """Value inside the bracket with its bin; below the bracket only bin -1 is left."""
        x, lo, hi = F.col(f"_v{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        share = F.when((hi > lo) & (hi < float("inf")), (x - lo) / (hi - lo)).otherwise(F.lit(0.0))
        inside = F.least(F.floor(share * _BINS), F.lit(_BINS - 1)).cast("int")
        return F.when(x <= hi, F.struct(
            F.lit(i).alias("m"), F.col(f"_n{i}").alias("n"),
            F.when(x >= lo, x).alias("x"), F.when(x >= lo, inside).otherwise(F.lit(-1)).alias("bin")))

    entries = F.array_compact(F.array(*[entry(i) for i in range(len(names))]))
    exploded = F.explode(entries) if len(names) > 1 else entries[0]
    counted = materialize(
        attach(base, brackets, by)
        .filter(F.size(entries) > 0)
        .select(*by, exploded.alias("e"))
        .groupBy(*by, "e.m", "e.n", "e.bin", "e.x")
        .agg(F.count(F.lit(1)).alias("count")), "bracketed")

    # Running counts over at most _BINS + 1 bins per group, then inside the one or two
    # bins that hold the wanted ranks.
    place = (F.element_at(F.array(*[F.lit(float(q)) for _, q in specs.values()]), F.col("m") + 1)
             * (F.col("n") - 1))
    low, high = F.floor("place"), F.ceil("place")

    def upto(*keys: str):
        return Window.partitionBy(*by, "m", *keys[:-1]).orderBy(keys[-1]).rowsBetween(
            Window.unboundedPreceding, 0)

    bins = counted.groupBy(*by, "m", "n", "bin").agg(F.sum("count").alias("rows")).withColumn(
        "before", F.sum("rows").over(upto("bin")) - F.col("rows")).withColumn("place", place)
    chosen = bins.filter((F.col("before") <= high) & (low < F.col("before") + F.col("rows"))).select(
        *by, "m", "bin", "before", "place")
    ranked = counted.join(materialize(chosen, "bins"), [*by, "m", "bin"]).withColumn(
        "seen", F.col("before") + F.sum("count").over(upto("bin", "x")))
    picked = ranked.groupBy(*by, "m").agg(
        F.max(F.col("x").isNull()).alias("below"),
        F.min(F.when(F.col("seen") > low, F.col("x"))).alias("a"),
        F.min(F.when(F.col("seen") > high, F.col("x"))).alias("b"),
        F.first(F.col("place") - low).alias("t"))
    value = F.when(
        F.col("below") | F.col("b").isNull(),
        F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"),
    ).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("t"))
    values = picked.select(*by, "m", value.alias("value")).groupBy(*by).agg(
        *[F.max(F.when(F.col("m") == i, F.col("value"))).alias(n) for i, n in enumerate(names)])
    if size_as:
        sizes = brackets.select(*by, F.col("_size").alias(size_as))
        values = attach(sizes, values, by)
    return materialize(values, "quantiles")
