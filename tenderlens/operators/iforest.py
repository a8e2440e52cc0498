"""Isolation Forest: trees grown in parallel on small samples, scored in Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.operators.quantile import exact_quantiles
from tenderlens.runtime import attach, materialize

SEED = 42
_NODES = "tree int, node int, feature int, threshold double, left int, right int, path double"


def average_path(n):
    """Expected depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    deep = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, deep))


def _grow(points: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Random splits down to the height limit; a leaf points at itself."""
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    nodes: list[list] = []
    stack = [(np.arange(len(points)), 0, -1, 0)]
    while stack:
        rows, depth, parent, side = stack.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = me
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append([me, 0, np.inf, me, me, depth + float(average_path(len(rows)))])
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = points[rows, feature] <= cut
        nodes.append([me, feature, cut, me, me, 0.0])
        stack.append((rows[~goes_left], depth + 1, me, 1))
        stack.append((rows[goes_left], depth + 1, me, 0))
    return [tuple(n) for n in nodes]


def fit_trees(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), uid: str = "uid",
              n_trees: int = 100, sample_size: int = 256, seed: int = SEED) -> DataFrame:
    """Node table (at most n_trees x (2 x sample_size - 1) rows per ``by`` key).

    A hash threshold keeps a random pool of about 2 x n_trees x sample_size rows,
    whatever the table size; every tree then ranks about twice its sample of that
    pool and takes exactly ``sample_size`` rows (all rows of a smaller table).
    """
    by, pool_size = list(by), n_trees * sample_size
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        counts = materialize(counts, "counts")

    def unit(*keys) -> Column:
        return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(2**53)) / F.lit(float(2**53))

    pool = attach(df.select(*by, uid, *columns), counts, by).filter(
        unit(F.col(uid)) * F.col("_n") < 2.0 * pool_size)
    pool_rows = F.least(F.col("_n").cast("double"), F.lit(2.0 * pool_size))
    drawn = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))).withColumn(
        "_u", unit(F.col(uid), F.col("tree"))).filter(F.col("_u") * pool_rows < 2.0 * sample_size)
    order = Window.partitionBy(*by, "tree").orderBy("_u", uid)
    sample = drawn.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= sample_size)

    names = list(columns)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        points = pdf.sort_values("_rn")[names].to_numpy("float64")
        out = pd.DataFrame(_grow(points, rng), columns=[
            "node", "feature", "threshold", "left", "right", "path"])
        out.insert(0, "tree", tree)
        for name in by:
            out[name] = pdf[name].iloc[0]
        out["psi"] = len(points)
        return out

    key_ddl = "".join(f", {name} {dict(df.dtypes)[name]}" for name in by)
    return sample.select(*by, "tree", "_rn", *names).groupBy(*by, "tree").applyInPandas(
        grow, _NODES + key_ddl + ", psi int")


def score(df: DataFrame, trees: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
          name: str = "anomaly_score_iforest") -> DataFrame:
    """Adds the score (more negative = more abnormal); a narrow Arrow stage.

    Only the node table travels to the tasks; its size is fixed by the forest's
    parameters, not by the data.
    """
    by = list(by)
    if len(by) > 1:
        raise ValueError("one key column: combine several into a struct or a string first")
    nodes = trees.toPandas()
    forests = {}
    for key, group in nodes.groupby(by[0]) if by else [(None, nodes)]:
        order = sorted(group["tree"].unique())
        width = int(group["node"].max()) + 1
        packed = {c: np.zeros((len(order), width), dtype=t) for c, t in (
            ("feature", "int64"), ("threshold", "float64"), ("left", "int64"),
            ("right", "int64"), ("path", "float64"))}
        for position, tree in enumerate(order):
            part = group[group["tree"] == tree]
            for c, values in packed.items():
                values[position, part["node"].to_numpy()] = part[c].to_numpy()
        packed["psi"] = int(group["psi"].max())
        forests[key] = packed
    shared = df.sparkSession.sparkContext.broadcast(forests)

    def batch_scores(points: np.ndarray, forest: dict) -> np.ndarray:
        total = np.zeros(len(points))
        rows = np.arange(len(points))
        depth = int(np.ceil(np.log2(max(forest["psi"], 2))))
        for feature, cut, left, right, path in zip(
                forest["feature"], forest["threshold"], forest["left"],
                forest["right"], forest["path"], strict=True):
            at = np.zeros(len(points), dtype="int64")
            for _ in range(depth):
                go_left = points[rows, feature[at]] <= cut[at]
                at = np.where(go_left, left[at], right[at])
            total += path[at]
        mean = total / len(forest["feature"])
        norm = float(average_path(forest["psi"]))
        return -np.power(2.0, -mean / (norm if norm > 0 else 1.0))

    @F.pandas_udf("double")
    def scores(keys: pd.Series, values: pd.DataFrame) -> pd.Series:
        points = values.to_numpy("float64")
        out = np.full(len(points), np.nan)
        for key, forest in shared.value.items():
            chosen = np.ones(len(points), bool) if key is None else (keys == key).to_numpy()
            if chosen.any():
                out[chosen] = batch_scores(points[chosen], forest)
        return pd.Series(out)

    key = F.col(by[0]) if by else F.lit(0)
    return df.withColumn(name, scores(key, F.struct(*columns)))


def flag_lowest(df: DataFrame, score_column: str, flag: str, contamination: float,
                by: Sequence[str] = ()) -> DataFrame:
    """True below the exact ``contamination`` percentile of the score."""
    cut = exact_quantiles(df, {"_cut": (score_column, contamination)}, by)
    return attach(df, cut, by).withColumn(flag, F.col(score_column) < F.col("_cut")).drop("_cut")


def isolation_forest(scaled: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                     contamination: float = 0.05, uid: str = "uid", n_trees: int = 100,
                     sample_size: int = 256, seed: int = SEED) -> DataFrame:
    """Adds ``anomaly_score_iforest`` and ``is_anomaly_iforest``."""
    trees = fit_trees(scaled, columns, by, uid, n_trees, sample_size, seed)
    scored = materialize(score(scaled, trees, columns, by), "iforest")
    return flag_lowest(scored, "anomaly_score_iforest", "is_anomaly_iforest", contamination, by)
