"""Anomaly detection end to end, agreement of the two methods, and its stability."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.operators.iforest import isolation_forest
from tenderlens.operators.lof import lof
from tenderlens.operators.peers import FEATURES, feature_matrix, scale_features
from tenderlens.operators.ranks import sample_exact
from tenderlens.runtime import materialize

_Z = [f"{c}_z" for c in FEATURES]


def scaled_features(df: DataFrame, tie_break: Sequence[str], log_scale: bool = False,
                    by: Sequence[str] = ()) -> DataFrame:
    """Imputed and standardised features, computed once for both methods."""
    return materialize(scale_features(feature_matrix(df, tie_break, log_scale, by), by=by), "scaled")


def detect_isolation_forest(df: DataFrame, tie_break: Sequence[str], contamination: float = 0.05,
                            log_scale: bool = False, n_trees: int = 100) -> DataFrame:
    scaled = scaled_features(df, tie_break, log_scale)
    return isolation_forest(scaled, _Z, contamination=contamination, n_trees=n_trees).drop(*_Z)


def detect_lof(df: DataFrame, tie_break: Sequence[str], contamination: float = 0.05,
               n_neighbors: int = 20, log_scale: bool = False) -> DataFrame:
    scaled = scaled_features(df, tie_break, log_scale)
    return lof(scaled, _Z, contamination=contamination, n_neighbors=n_neighbors).drop(*_Z)


def both_methods(df: DataFrame, tie_break: Sequence[str], contamination: float = 0.05,
                 log_scale: bool = False, by: Sequence[str] = (), n_neighbors: int = 20,
                 n_trees: int = 100) -> DataFrame:
    """One row per contract with both flags, joined on the contract, not by position."""
    by = list(by)
    scaled = scaled_features(df, tie_break, log_scale, by).select(*by, "uid", *_Z)
    forest = isolation_forest(scaled, _Z, by, contamination, n_trees=n_trees).select(
        *by, "uid", "anomaly_score_iforest", "is_anomaly_iforest")
    factor = lof(scaled, _Z, by, contamination, n_neighbors).select(
        *by, "uid", "anomaly_score_lof", "is_anomaly_lof")
    return forest.join(factor, [*by, "uid"])


def agreement(flags: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per method and the share of flagged contracts both methods flag."""
    a, b = F.col("is_anomaly_iforest"), F.col("is_anomaly_lof")
    either = F.count_if(a | b)
    return flags.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_contracts"),
        F.count_if(a).alias("n_anomalies_iforest"), F.count_if(b).alias("n_anomalies_lof"),
        F.count_if(a & b).alias("n_accord"),
        F.when(either > 0, F.bround(F.count_if(a & b) / either, 3)).otherwise(0.0)
        .alias("taux_accord"))


def compare_methods(df: DataFrame, tie_break: Sequence[str], contamination: float = 0.05,
                    log_scale: bool = False, by: Sequence[str] = (), n_neighbors: int = 20,
                    n_trees: int = 100) -> DataFrame:
    """Agreement row; ``n_total`` counts input rows, ``n_contracts`` contracts."""
    by = list(by)
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"))
    result = agreement(both_methods(df, tie_break, contamination, log_scale, by, n_neighbors, n_trees), by)
    if by:
        return rows.join(result, by)
    return result.select(rows.scalar().alias("n_total"), "*")


def stability_draws(df: DataFrame, row_keys: Sequence[str], tie_break: Sequence[str],
                    sample_size: int = 20_000, seeds: Sequence[int] = (0, 1, 2, 3, 4),
                    contamination: float = 0.05, log_scale: bool = False,
                    n_trees: int = 100) -> DataFrame:
    """Agreement row per seed; all draws go through one job, keyed by ``seed``."""
    draws = [sample_exact(df, sample_size, s, row_keys).withColumn("seed", F.lit(int(s)))
             for s in seeds]
    sampled = materialize(reduce(DataFrame.unionByName, draws), "draws")
    return compare_methods(sampled, tie_break, contamination, log_scale, ["seed"], n_trees=n_trees)


def stability_summary(draws: DataFrame, sample_size: int = 20_000) -> DataFrame:
    """Mean and sample deviation of the agreement over the draws, with the details."""
    deviation = F.coalesce(F.stddev_samp("taux_accord"), F.lit(0.0))
    return draws.agg(
        F.count(F.lit(1)).alias("n_repeats"), F.lit(sample_size).alias("sample_size"),
        F.bround(F.avg("taux_accord"), 4).alias("taux_accord_moyen"),
        F.bround(F.nanvl(deviation, F.lit(0.0)), 4).alias("taux_accord_ecart_type"),
        F.sort_array(F.collect_list(F.struct(*sorted(draws.columns, key=lambda c: c != "seed"))))
        .alias("detail_par_tirage"))


def top_anomalies(scored: DataFrame, n: int = 10, score: str = "anomaly_score_iforest") -> DataFrame:
    """The n most abnormal contracts, lowest score first."""
    return scored.orderBy(score, "uid").limit(n).select(
        "uid", "montant", "dureeMois", "montant_ratio_mediane_cpv", score)
