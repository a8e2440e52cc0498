"""Weighted reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60  # fixed value: damping constant
SCORE_DIGITS = 12


def reciprocal_rank_fusion(rankings: Sequence[DataFrame], k: int = RRF_K,
                           weights: Sequence[float] | None = None,
                           by: Sequence[str] = ("query_id",), top_k: int | None = None,
                           uid: str = "uid") -> DataFrame:
    """Sum of weight / (k + rank) over the rankings; absence adds nothing.

    Rankings carry ``by`` columns, the id and ``rank`` (from 1).  The result has
    ``rrf_score`` and its own ``rank``; no rankings rows give an empty result.
    """
    weights = [1.0] * len(rankings) if weights is None else list(weights)
    if len(weights) != len(rankings):
        raise ValueError(f"{len(weights)} weight(s) given for {len(rankings)} ranking(s)")
    parts = [r.select(*by, uid, (F.lit(float(w)) / (k + F.col("rank"))).alias("_part"))
             for r, w in zip(rankings, weights, strict=True)]
    return _rank(reduce(DataFrame.unionByName, parts), F.sum("_part"), by, top_k, uid)


def fuse_configs(rankings: Mapping[str, DataFrame], configs: Mapping[str, Mapping[str, float]],
                 k: int = RRF_K, by: Sequence[str] = ("query_id",),
                 top_k: int | None = None) -> DataFrame:
    """Fuse the same rankings under several weightings at once (column ``configuration``).

    Ranks are aligned once per (query, uid); each configuration is then arithmetic.
    """
    names = list(rankings)
    long = reduce(DataFrame.unionByName, [
        r.select(*by, "uid", F.lit(n).alias("_method"), "rank") for n, r in rankings.items()])
    aligned = long.groupBy(*by, "uid").agg(*[
        F.sum(F.when(F.col("_method") == n, 1.0 / (k + F.col("rank")))).alias(f"_r_{n}") for n in names])
    scored = aligned.select(*by, "uid", F.inline(F.array(*[
        F.struct(F.lit(c).alias("configuration"),
                 reduce(Column.__add__, [F.coalesce(F.col(f"_r_{n}") * float(w.get(n, 1.0)), F.lit(0.0))
                                         for n in names]).alias("_part"))
        for c, w in configs.items()])))
    return _rank(scored, F.sum("_part"), [*by, "configuration"], top_k, "uid")


def _rank(parts: DataFrame, total: Column, by: Sequence[str], top_k: int | None, uid: str) -> DataFrame:
    fused = parts.groupBy(*by, uid).agg(F.round(total, SCORE_DIGITS).alias("rrf_score"))
    order = Window.partitionBy(*by).orderBy(F.desc("rrf_score"), uid)
    ranked = fused.withColumn("rank", F.row_number().over(order))
    return ranked if top_k is None else ranked.filter(F.col("rank") <= top_k)
