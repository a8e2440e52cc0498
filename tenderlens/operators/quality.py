"""Quality audit: one aggregate over the table, one over the few category values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.functions.text import plain_key
from tenderlens.operators.cleaning import AMOUNT_MAX, DATE_MAX, DATE_MIN, out_of_range
from tenderlens.runtime import attach
from tenderlens.schema import CURRENT_FLAG, DATE_COLUMNS

CATEGORY_COLUMNS = ["nature", "procedure", "type"]
_PENALTY = 0.05


def _is_missing(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] in ("double", "float"):
        return F.col(name).isNull() | F.isnan(name)
    return F.col(name).isNull()


def _amount() -> Column:
    return F.nanvl(F.col("montant").cast("double"), F.lit(None).cast("double"))


def _rate(n_missing: Column, n_total: Column) -> Column:
    return F.when(n_total > 0, n_missing / n_total).otherwise(F.lit(0.0))


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing count and (unrounded) rate of every column, in one pass."""
    wide = df.agg(F.count(F.lit(1)).alias("n_total"), *[
        F.count_if(_is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing"))
                     for i, c in enumerate(df.columns)])
    return wide.select(F.inline(rows), "n_total").select(
        "column", _rate(F.col("n_missing"), F.col("n_total")).alias("missing_rate"),
        "n_missing", "n_total")


def date_issues(df: DataFrame, low: str = DATE_MIN, high: str = DATE_MAX) -> DataFrame:
    """Out-of-range count of every date column that exists."""
    present = [c for c in DATE_COLUMNS if c in df.columns]
    wide = df.agg(*[F.count_if(out_of_range(c, low, high)).alias(c) for c in present])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n_out_of_range")) for c in present])))


def amount_issues(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(_amount() <= 0).alias("n_not_positive"),
                  F.count_if(_amount() > AMOUNT_MAX).alias("n_extreme"))


def version_issues(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col(CURRENT_FLAG).isNull()).alias("n_null_flag"))


def category_variants(df: DataFrame) -> DataFrame:
    """Distinct raw values against distinct normalised ones, per category column.

    The table is first reduced to its distinct (column, value) pairs, so texts are
    normalised once per value and no row is multiplied by a multi-distinct.
    """
    present = [c for c in CATEGORY_COLUMNS if c in df.columns]
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in present])).alias("p")).select("p.*").filter(F.col("value").isNotNull())
    values = pairs.groupBy("column", "value").agg(F.lit(1).alias("one"))
    keys = values.withColumn("key", plain_key(F.col("value"))).groupBy("column", "key").agg(
        F.count(F.lit(1)).alias("raw"))
    return keys.groupBy("column").agg(F.sum("raw").alias("n_raw"),
                                      F.count(F.lit(1)).alias("n_normalised"))


def quality_report(df: DataFrame, low: str = DATE_MIN, high: str = DATE_MAX,
                   display: bool = True) -> DataFrame:
    """One row per column: counts, issue texts and score; lowest score first.

    Each check that fires is one issue and costs 0.05.  The score uses the rate
    rounded to four digits, as published, and is itself rounded to three;
    ``display=False`` keeps both unrounded.
    """
    def shown(value: Column, digits: int) -> Column:
        return F.bround(value, digits) if display else value

    names = df.columns
    dates = [c for c in DATE_COLUMNS if c in names]
    has_amount, has_flag = "montant" in names, CURRENT_FLAG in names
    categories = [c for c in CATEGORY_COLUMNS if c in names]
    checks: list[Column] = []
    if has_amount:
        checks += [F.count_if(_amount() <= 0).alias("n_not_positive"),
                   F.count_if(_amount() > AMOUNT_MAX).alias("n_extreme")]
    checks += [F.count_if(out_of_range(c, low, high)).alias(f"d_{c}") for c in dates]
    wide = df.agg(F.count(F.lit(1)).alias("n_total"), *[
        F.count_if(_is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(names)], *checks)
    if categories:
        variants = category_variants(df)
        summary = variants.agg(*[c for n in categories for c in (
            F.max(F.when(F.col("column") == n, F.col("n_raw"))).alias(f"raw_{n}"),
            F.max(F.when(F.col("column") == n, F.col("n_normalised"))).alias(f"norm_{n}"))])
        wide = attach(wide, summary)

    def text(condition: Column, template: str, *args: Column) -> Column:
        return F.when(condition, F.format_string(template, *args))

    def issues(i: int, name: str) -> Column:
        found = []
        if name in dates:
            found.append(text(F.col(f"d_{name}") > 0,
                              f"%d dates hors plage plausible [{low}, {high}]", F.col(f"d_{name}")))
        if name == "montant":
            found.append(text(F.col("n_not_positive") > 0,
                              "%d montants négatifs ou nuls", F.col("n_not_positive")))
            found.append(text(F.col("n_extreme") > 0,
                              f"%d montants > {AMOUNT_MAX:,.0f} € (à vérifier)", F.col("n_extreme")))
        if name in categories:
            found.append(text(
                F.col(f"raw_{name}") > F.col(f"norm_{name}"),
                "%d variantes distinctes se réduisent à %d après normalisation "
                "(casse/accents) — à normaliser avant tout groupby",
                F.col(f"raw_{name}"), F.col(f"norm_{name}")))
        if name == CURRENT_FLAG and has_flag:
            found.append(text(F.col(f"m{i}") > 0,
                              "%d valeurs nulles pour un champ censé être booléen", F.col(f"m{i}")))
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")

    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing"),
                              issues(i, c).alias("issues")) for i, c in enumerate(names)])
    report = wide.select("n_total", F.inline(rows)).select(
        "column", shown(_rate(F.col("n_missing"), F.col("n_total")), 4).alias("missing_rate"),
        "n_missing", "n_total", "issues")
    score = shown(1.0 - F.col("missing_rate") - _PENALTY * F.size("issues"), 3)
    return report.withColumn("quality_score", F.greatest(F.lit(0.0), score)).withColumn(
        "issue_text", F.concat_ws("; ", "issues")).orderBy("quality_score", "column")


def missing_by_group(df: DataFrame, group: Column, target: str = "offresRecues") -> DataFrame:
    """Share of rows without the target, per group: shows selection bias."""
    return df.groupBy(group.alias("groupe")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.col(target).isNull().cast("double")).alias("missing_rate"))
