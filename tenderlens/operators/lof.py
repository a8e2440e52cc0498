"""Local Outlier Factor on top of the exact neighbour join."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tenderlens.operators.iforest import flag_lowest
from tenderlens.operators.knn import CELL_POINTS, collapse_points, gathered, knn_cells, neighbour_values, places
from tenderlens.runtime import materialize


def lof_scores(points: DataFrame, near: DataFrame, columns: Sequence[str],
               by: Sequence[str] = ()) -> DataFrame:
    """Score of every distinct point from its neighbours, packed by ``knn_cells``.

    A point without an id, or without neighbours, has no score and counts in no other's.
    """
    by, names, keys = list(by), list(columns), ["region", "cell", "part"]
    coordinates, types = [f"x_{c}" for c in names], dict(points.dtypes)
    density_ddl = f"region int, cell long, part int, pid array<{types['pid']}>, lrd array<double>"
    score_ddl = "".join(f"{c} {types[c]}, " for c in by) + "".join(f"{c} double, " for c in names) + \
        "anomaly_score_lof double"
    density_type, score_type = (to_arrow_schema(StructType.fromDDL(x)) for x in (density_ddl, score_ddl))

    def lists(table: pa.Table, *columns_: str) -> list[np.ndarray]:
        return [table.column(c)[0].values.to_numpy(zero_copy_only=False) for c in columns_]

    def mean(values: np.ndarray, used: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Per point, over the neighbours whose value is known; NaN without any."""
        row, known = np.repeat(np.arange(len(n)), n), ~np.isnan(values)
        weight = np.bincount(row[known], used[known], len(n))
        total = np.bincount(row[known], (used * values)[known], len(n))
        return np.divide(total, weight, out=np.full(len(n), np.nan), where=weight > 0)

    def densities(cell: pa.Table, found: pa.Table) -> pa.Table:
        n, used, *xs = lists(cell, "n", "used", *coordinates)
        size = cell.column("n_ids")[0].as_py()
        kd, *others = gathered(found, size, 1 + len(names))[places(cell.column("at")[0].as_py(), size)].T
        d = distance(xs, others, np.repeat(np.arange(len(n)), n))
        lrd = 1.0 / (mean(np.maximum(kd, d), used, n) + 1e-10)
        return pa.Table.from_arrays([*(cell.column(c) for c in (*keys, "pid")), pa.array([lrd], pa.list_(pa.float64()))],
                                    names=density_type.names).cast(density_type)

    def distance(xs: list[np.ndarray], others: list[np.ndarray], row: np.ndarray) -> np.ndarray:
        total = np.zeros(len(row))
        for x, y in zip(xs, others, strict=True):
            total += (x[row] - y) ** 2
        return np.sqrt(total)

    def scores(cell: pa.Table, found: pa.Table) -> pa.Table:
        n, used = lists(cell, "n", "used")
        size = cell.column("n_ids")[0].as_py()
        at = places(cell.column("at")[0].as_py(), size)
        mine = pc.equal(found.column("start"), -1)
        lrd = _own(found.filter(mine), len(n))
        score = -mean(gathered(found.filter(pc.invert(mine)), size)[at, 0], used, n) / lrd
        known = pa.array(np.flatnonzero(~np.isnan(score) & cell.column("pid")[0].values.is_valid().to_numpy(
            zero_copy_only=False)))
        return pa.Table.from_arrays([
            *(pa.repeat(cell.column(c)[0], len(known)) for c in by), *(cell.column(f"x_{c}")[0].values.take(known) for c in names),
            pa.array(score).take(known)], names=score_type.names).cast(score_type)

    reach = neighbour_values(near, near, ["kd", *coordinates])
    sized = near.withColumn("n_ids", F.size("ids"))
    density = materialize(sized.select(*keys, "pid", "n", "at", "used", "n_ids", *coordinates).groupBy(*keys).cogroup(
        reach.groupBy(*keys)).applyInArrow(densities, density_ddl), "lrd")
    around = neighbour_values(near, density, ["lrd"]).unionByName(density.select(
        *keys, F.lit(-1).alias("start"), F.col("lrd").alias("found")))
    return sized.select(*by, *keys, "pid", *coordinates, "n", "at", "used", "n_ids").groupBy(*keys).cogroup(
        around.groupBy(*keys)).applyInArrow(scores, score_ddl)


def _own(found: pa.Table, size: int) -> np.ndarray:
    return found.column("found")[0].values.to_numpy(zero_copy_only=False) if len(found) else np.full(size, np.nan)


def lof(scaled: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
        contamination: float = 0.05, n_neighbors: int = 20, uid: str = "uid",
        cell_points: int = CELL_POINTS) -> DataFrame:
    """Adds ``anomaly_score_lof`` and ``is_anomaly_lof``."""
    points = materialize(collapse_points(scaled, columns, by, uid), "points")
    scores = lof_scores(points, knn_cells(points, columns, n_neighbors, by, cell_points), columns, by)
    scored = materialize(scaled.join(scores, [*by, *columns], "left"), "lof_rows")
    return flag_lowest(scored, "anomaly_score_lof", "is_anomaly_lof", contamination, by)
