"""Non-destructive cleaning: flags and canonical categories, no row is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.functions.text import plain_key
from tenderlens.schema import DATE_COLUMNS

# Plausible ranges.
DATE_MIN = "2000-01-01"
DATE_MAX = "2027-12-31"
AMOUNT_MAX = 1_000_000_000

# Readable label per normalised category.
CANONICAL_NATURE = {
    "marche": "Marché",
    "marche subsequent": "Marché subséquent",
    "accord-cadre": "Accord-cadre",
    "accord cadre": "Accord-cadre",
    "marche de partenariat": "Marché de partenariat",
}


def out_of_range(column, low: str = DATE_MIN, high: str = DATE_MAX):
    """Outside [low, high at midnight]; a missing date is not out of range."""
    value = F.col(column)
    outside = (value < F.lit(low).cast("timestamp")) | (value > F.lit(high).cast("timestamp"))
    return F.coalesce(outside, F.lit(False))


def normalize_nature(df: DataFrame, column: str = "nature") -> DataFrame:
    """Map known variants to one label; the input stays in ``<column>_original``."""
    if column not in df.columns:
        return df
    labels = F.create_map(*[F.lit(x) for pair in CANONICAL_NATURE.items() for x in pair])
    mapped = F.coalesce(F.try_element_at(labels, plain_key(F.col(column))), F.col(column))
    return df.withColumns({f"{column}_original": F.col(column), column: mapped})


def flag_amounts(df: DataFrame, column: str = "montant") -> DataFrame:
    if column not in df.columns:
        return df
    value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    return df.withColumns({
        "montant_negatif_ou_nul": F.coalesce(value <= 0, F.lit(False)),
        "montant_extreme": F.coalesce(value > AMOUNT_MAX, F.lit(False)),
    })


def flag_dates(df: DataFrame, low: str = DATE_MIN, high: str = DATE_MAX) -> DataFrame:
    flags = {f"{c}_hors_plage": out_of_range(c, low, high) for c in DATE_COLUMNS if c in df.columns}
    return df.withColumns(flags) if flags else df


def clean(df: DataFrame, low: str = DATE_MIN, high: str = DATE_MAX) -> DataFrame:
    """Categories, then amount flags, then date flags; row count unchanged."""
    return df.transform(normalize_nature).transform(flag_amounts).transform(
        lambda d: flag_dates(d, low, high))
