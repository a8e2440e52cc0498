"""Peer-group deviation and the anomaly feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.functions.numeric import clean_double, signed_log
from tenderlens.operators.contracts import dedup_contracts
from tenderlens.operators.quantile import exact_quantiles
from tenderlens.runtime import attach, materialize

MIN_GROUP_SIZE = 30  # fixed value: smaller groups have no reliable median

FEATURES = ["montant", "dureeMois", "montant_ratio_mediane_cpv", "duree_ratio_mediane_cpv"]


def add_division(df: DataFrame, code: str = "codeCPV") -> DataFrame:
    """First two characters of the classification code; null stays null."""
    return df.withColumn("cpv_division", F.substring(F.col(code).cast("string"), 1, 2))


def peer_deviation(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Amount and duration relative to the median of the same division.

    The medians are a small stored table, so adding them back does not shuffle
    the contracts unless that table outgrows Spark's own broadcast limit.
    """
    by = list(by)
    df = add_division(df)
    stats = exact_quantiles(
        df.filter(F.col("cpv_division").isNotNull()),
        {"_montant_med": ("montant", 0.5), "_duree_med": ("dureeMois", 0.5)},
        by=[*by, "cpv_division"], size_as="cpv_groupe_taille")
    joined = attach(df, stats, [*by, "cpv_division"])

    def ratio(value: str, median: str):
        return F.when(F.col(median) > 0, clean_double(F.col(value)) / F.col(median))

    return joined.withColumns({
        "montant_ratio_mediane_cpv": ratio("montant", "_montant_med"),
        "duree_ratio_mediane_cpv": ratio("dureeMois", "_duree_med"),
        "cpv_groupe_fiable": F.coalesce(
            F.col("cpv_groupe_taille") >= MIN_GROUP_SIZE, F.lit(False)),
    }).drop("_montant_med", "_duree_med")


def feature_matrix(df: DataFrame, tie_break: Sequence[str], log_scale: bool = False,
                   by: Sequence[str] = ()) -> DataFrame:
    """One row per contract with the four imputed features.

    Ratios are taken on raw values; the optional signed log then applies to the
    amount and its ratio, and gaps get the median of the (transformed) column.
    """
    contracts = materialize(dedup_contracts(df, tie_break, by), "contracts")
    out = peer_deviation(contracts, by).withColumns(
        {c: clean_double(F.col(c)) for c in FEATURES})
    if log_scale:
        logged = ("montant", "montant_ratio_mediane_cpv")
        out = out.withColumns({c: signed_log(F.col(c)) for c in logged})
    medians = exact_quantiles(out, {f"_med_{c}": (c, 0.5) for c in FEATURES}, by)
    filled = attach(out, medians, by).withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_med_{c}")) for c in FEATURES})
    return filled.drop(*[f"_med_{c}" for c in FEATURES])


def scale_features(df: DataFrame, columns: Sequence[str] = tuple(FEATURES),
                   by: Sequence[str] = ()) -> DataFrame:
    """Adds ``<column>_z``: (x - mean) / population deviation; deviation 0 counts as 1."""
    stats = df.groupBy(*by).agg(*[s for c in columns for s in (
        F.avg(c).alias(f"_mean_{c}"), F.stddev_pop(c).alias(f"_std_{c}"))])
    if by:
        stats = materialize(stats, "scale")
    scaled = {f"{c}_z": (F.col(c) - F.col(f"_mean_{c}")) / F.when(
        F.col(f"_std_{c}") > 0, F.col(f"_std_{c}")).otherwise(F.lit(1.0)) for c in columns}
    return attach(df, stats, by).withColumns(scaled).drop(
        *[f"_{s}_{c}" for c in columns for s in ("mean", "std")])
