"""Strict filters of many queries applied to one corpus in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.functions.numeric import clean_double
from tenderlens.operators.quantile import exact_quantiles
from tenderlens.runtime import materialize

HIGH_QUANTILE = 0.90  # fixed value: meaning of "high amount"
_ANY = "*"
_WORD = 63  # filters per word of a bitmap


def with_filter_id(parsed: DataFrame) -> DataFrame:
    """Queries with equal filters (and population) share one ``filter_id``."""
    if "pop" not in parsed.columns:
        parsed = parsed.withColumn("pop", F.lit("all"))
    return parsed.withColumn("filter_id", F.concat_ws(
        "|", "pop", F.coalesce("region", F.lit(_ANY)),
        F.coalesce(F.col("montant_min").cast("string"), F.lit(_ANY)),
        F.col("montant_eleve_qualitatif").cast("string")))


def _pairs(corpus: DataFrame, filters: DataFrame, region: str) -> DataFrame:
    """Rows with every filter of their region or of no region: an equi-join.

    The filters derive from stored tables, so Spark knows their size and broadcasts
    them only below its own limit.
    """
    keys = F.array_compact(F.array(F.lit(_ANY), F.col(region))) if region in corpus.columns \
        else F.array(F.lit(_ANY))
    keyed = corpus.withColumn("region_key", F.explode(keys))
    return keyed.join(filters, ["pop", "region_key"])


@dataclass
class Filtered:
    """Which filters keep which rows; the rows themselves are stored once."""

    rows: DataFrame     # row_id and the corpus columns, every corpus row once
    kept: DataFrame     # row_id, uid, set_id: rows that some filter keeps
    sets: DataFrame     # set_id, filter_id: the filters of every combination that occurs

    def documents(self) -> DataFrame:
        """Corpus columns and ``set_id`` of the kept rows, each once."""
        return self.rows.join(self.kept.select("row_id", "set_id"), "row_id").drop("row_id")

    def members(self) -> DataFrame:
        """(filter_id, uid, row_id), ids only."""
        return self.kept.join(self.sets, "set_id").select("filter_id", "uid", "row_id")

    def subset(self) -> DataFrame:
        """Corpus columns per filter; not stored, for few filters or few rows."""
        return self.members().drop("uid").join(self.rows, "row_id").drop("row_id")


def _bounds(corpus: DataFrame, parsed: DataFrame, region: str, amount: str) -> DataFrame:
    """One row per filter: its region, least amount and number."""
    wanted = F.coalesce("region", F.lit(_ANY)) if region in corpus.columns else F.lit(_ANY)
    filters = parsed.select(
        "filter_id", "pop", wanted.alias("region_key"), "montant_min",
        F.col("montant_eleve_qualitatif").alias("high")).distinct()
    high = filters.filter(F.col("high") & F.col("montant_min").isNull())
    cuts = exact_quantiles(
        _pairs(corpus.select("pop", amount, *([region] if region in corpus.columns else [])),
               high.select("pop", "region_key").distinct(), region),
        {"cut": (amount, HIGH_QUANTILE)}, ["pop", "region_key"])
    return materialize(filters.join(cuts, ["pop", "region_key"], "left").select(
        "filter_id", "pop", "region_key",
        (F.col("high") | F.col("montant_min").isNotNull()).alias("needs_min"),
        F.coalesce("montant_min", F.when(F.col("high"), F.col("cut"))).alias("min_amount"),
        (F.row_number().over(Window.orderBy("filter_id")) - 1).alias("code")), "bounds")


def filter_members(corpus: DataFrame, parsed: DataFrame, tie_break: Sequence[str],
                   region: str = "acheteur_region_nom", amount: str = "montant") -> Filtered:
    """Strict filters of many queries over one copy of the corpus.

    Region first; then the explicit minimum, else for "high amount" the exact 90th percentile
    of the region-filtered, not yet deduplicated rows; then per filter one row per contract.
    Every row gets a bitmap of the filters it passes.  Of a contract's rows with equal bitmaps
    only the first can matter; over those, a running OR in tie-break order takes away the
    filters that an earlier row has served.  Only ids and the columns filtered on are shuffled.
    """
    if "pop" not in corpus.columns:
        corpus = corpus.withColumn("pop", F.lit("all"))
    # Stored before its quantiles are taken, so that what makes the corpus runs once.
    rows = materialize(corpus.withColumn("row_id", F.monotonically_increasing_id()), "corpus-rows")
    corpus = rows.drop("row_id")
    bounds = _bounds(corpus, parsed, region, amount)
    n_words = max(-(-bounds.count() // _WORD), 1)
    of_region = materialize(bounds.groupBy("pop", F.col("region_key").alias("_region")).agg(F.collect_list(F.struct(
        F.expr(f"code div {_WORD}").alias("word"), F.expr(f"shiftleft(1L, cast(code % {_WORD} as int))").alias("bit"),
        "needs_min", "min_amount")).alias("_filters")), "region-filters")
    everywhere = of_region.filter(F.col("_region") == _ANY).select("pop", F.col("_filters").alias("_always"))
    known = ["row_id", "pop", "uid", amount, *tie_break, *([region] if region in corpus.columns else [])]
    narrow = rows.select(*dict.fromkeys(known)).join(everywhere, "pop", "left")
    if region in corpus.columns:
        narrow = narrow.join(of_region.withColumnRenamed("_region", region), ["pop", region], "left")
    else:
        narrow = narrow.withColumn("_filters", F.lit(None).cast(dict(of_region.dtypes)["_filters"]))
    none = F.array().cast(dict(of_region.dtypes)["_filters"])
    offered = F.concat(F.coalesce("_always", none), F.coalesce("_filters", none))
    value = clean_double(F.col(amount))
    passed = narrow.withColumn("_passed", F.filter(offered, lambda f: ~f["needs_min"] | F.coalesce(
        value >= f["min_amount"], F.lit(False)))).filter(F.size("_passed") > 0)

    def word(i: int) -> Column:
        return F.aggregate("_passed", F.lit(0).cast("long"), lambda bits, f: F.when(
            f["word"] == i, bits.bitwiseOR(f["bit"])).otherwise(bits))

    words = [f"_w{i}" for i in range(n_words)]
    marked = passed.select("row_id", "pop", "uid", *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tie_break)],
                           *[word(i).alias(w) for i, w in enumerate(words)])
    order = [*[f"_t{i}" for i in range(len(tie_break))], "row_id"]
    alike = Window.partitionBy("pop", "uid", *words).orderBy(*order)
    firsts = marked.withColumn("_rn", F.row_number().over(alike)).filter("_rn = 1")
    earlier = Window.partitionBy("pop", "uid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or(w).over(earlier), F.lit(0).cast("long")))).alias(w)
            for w in words]
    kept = materialize(firsts.select("row_id", "uid", *left).filter(" or ".join(f"{w} <> 0" for w in words)).select(
        "row_id", "uid", F.concat_ws(",", *words).alias("set_id")), "filter-members")
    held = kept.select("set_id").distinct().withColumn("_words", F.split("set_id", ",").cast("array<bigint>"))
    codes = held.select("set_id", "_words", F.explode(F.sequence(F.lit(0), F.lit(n_words * _WORD - 1))).alias("code"))
    inside = F.expr(f"shiftright(element_at(_words, cast(code div {_WORD} as int) + 1), cast(code % {_WORD} as int)) & 1L = 1L")
    sets = materialize(codes.filter(inside).join(bounds.select("code", "filter_id"), "code").select(
        "set_id", "filter_id"), "filter-sets")
    return Filtered(rows, kept, sets)


def apply_strict_filters(corpus: DataFrame, parsed: DataFrame, tie_break: Sequence[str],
                         region: str = "acheteur_region_nom", amount: str = "montant") -> DataFrame:
    """Filtered, deduplicated corpus rows with ``filter_id``: one row per filter and contract.

    ``corpus`` may carry ``pop`` to keep several populations apart.
    """
    return filter_members(corpus, parsed, tie_break, region, amount).subset()
