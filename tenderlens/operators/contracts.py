"""From the (contract x holder) grain to one row per contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup_contracts(df: DataFrame, tie_break: Sequence[str], by: Sequence[str] = (),
                    uid: str = "uid") -> DataFrame:
    """First row per contract in ``tie_break`` order (which must order rows fully).

    Each map task keeps one row per contract before the shuffle (window group
    limit), so a contract repeated very often does not reach one task whole.
    """
    if uid not in df.columns:
        return df
    first = Window.partitionBy(*by, uid).orderBy(*tie_break)
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def group_by_contract(df: DataFrame, tie_break: Sequence[str], uid: str = "uid",
                      holder: str = "titulaire_id") -> DataFrame:
    """First row of every contract plus its number of distinct holders."""
    if uid not in df.columns:
        raise ValueError(f"column {uid!r} is needed to group by contract")
    holders = df.filter(F.col(uid).isNotNull()).groupBy(uid).agg(
        F.count_distinct(holder).alias("nb_titulaires"))
    return dedup_contracts(df, tie_break, uid=uid).join(holders, uid, "left")
