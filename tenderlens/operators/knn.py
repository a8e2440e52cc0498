"""Exact k-nearest-neighbour self join without comparing all pairs.

1. Equal points collapse into one weighted point, so copies cannot pile up.
2. A k-d split learned from a bounded sample gives regions of similar size.  A region that
   holds too many points for one group is split again from a sample of its own, on the
   executors, and so are its parts, until every cell fits.
3. Inside its own cell every point finds k neighbours: an upper bound radius.
4. The point then asks only those other cells whose box its ball touches.  Boxes form a tree:
   the regions' are sent to all tasks, those of a region's cells stay in a table, and requests
   to a split region travel to it first.  The candidates of all cells go back to the point's own
   cell, packed by request, and merge there into the exact k nearest.
5. Neighbours stay packed by cell.  What is known of a point later (``neighbour_values``) travels
   once to each cell that has it as a neighbour, not once per neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tenderlens.runtime import materialize

CELL_POINTS = 1024      # points a cell should hold
REGIONS = 32_768        # first level: bounds the box table sent to the tasks (a few MB)
OVERFULL = 4            # a cell of more than so many times CELL_POINTS is split again
FAN = 1024              # parts that a cell is split into at most
SAMPLE_ROWS = 262_144   # bounds the sample that shapes the first level
CELL_SAMPLE = 32_768    # bounds, in the mean, the sample that shapes one further split
REQUEST_ROWS = 8192     # requests answered by one group
LEAF = 64               # close points whose neighbours are looked for together


def collapse_points(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                    uid: str = "uid") -> DataFrame:
    """Distinct points with ``pid`` (lowest uid) and ``w`` (number of copies)."""
    return df.na.drop(subset=list(columns)).groupBy(*by, *columns).agg(
        F.min(uid).alias("pid"), F.count(F.lit(1)).alias("w"))


def _split(sample: np.ndarray, cells: int, first_cell: int) -> list[tuple]:
    """Median cuts along the widest side until ``cells`` leaves exist.

    Rows are (feature, threshold, left, right); a leaf has feature -1 and its cell
    number in ``left``.
    """
    nodes: list[list] = []
    stack = [(sample, cells, -1, 0)]
    next_cell = first_cell
    while stack:
        points, want, parent, side = stack.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = me
        spread = np.ptp(points, axis=0) if len(points) > 1 else np.zeros(sample.shape[1])
        if want <= 1 or not spread.max() > 0:
            nodes.append([-1, 0.0, next_cell, next_cell])
            next_cell += 1
            continue
        spread = np.subtract(*np.quantile(points, [0.9, 0.1], axis=0)) if len(points) > 64 else spread
        feature = int(spread.argmax())
        values = np.unique(points[:, feature])
        if len(values) < 2:
            feature = int(np.ptp(points, axis=0).argmax())
            values = np.unique(points[:, feature])
        middle = np.median(points[:, feature])
        at = min(max(int(np.searchsorted(values, middle)), 1), len(values) - 1)
        cut = float((values[at - 1] + values[at]) / 2.0)
        if not values[at - 1] <= cut < values[at]:
            cut = float(values[at - 1])
        nodes.append([feature, cut, me, me])
        low = points[:, feature] <= cut
        stack.append((points[~low], want - want // 2, me, 1))
        stack.append((points[low], want // 2, me, 0))
    return [tuple(n) for n in nodes]


def _assign(points: np.ndarray, tree: np.ndarray) -> np.ndarray:
    at = np.zeros(len(points), dtype="int64")
    rows = np.arange(len(points))
    feature, cut = tree[:, 0].astype("int64"), tree[:, 1]
    children = tree[:, 2:].astype("int64")
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return children[at, 0]
        live = rows[inner]
        node = at[live]
        right = points[live, feature[node]] > cut[node]
        at[live] = children[node, right.astype("int64")]


def _refine(placed: DataFrame, names: list[str], cell_points: int) -> DataFrame:
    """``placed`` with every (region, cell) of more than OVERFULL * cell_points points split.

    A cell's parts are numbered in base FAN + 1 behind its own number, so numbers of all levels
    differ within a region.  Points of one cell are dealt to their parts by many tasks; only the
    sample that shapes a split meets in one.
    """
    keys, slots = ["region", "cell"], 1 << 31
    schema, columns = placed.schema, placed.columns
    before = None
    while True:
        full = materialize(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(
            F.col("n") > OVERFULL * cell_points).withColumn(
            "salts", F.ceil(F.col("n") / REQUEST_ROWS).cast("int")), "full_cells")
        held = tuple(full.agg(F.count(F.lit(1)), F.sum("n")).first())
        if not held[0] or held == before:  # all fit, or what is left holds points that no cut tells apart
            return placed
        before = held
        inner = placed.join(full, keys)
        drawn = F.pmod(F.xxhash64("pid", "cell"), F.lit(slots)) < F.ceil(
            F.least(F.lit(1.0), CELL_SAMPLE / F.col("n")) * slots)

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            parts = min(FAN, -(-int(pdf["n"].iloc[0]) // cell_points))
            tree = np.array(_split(pdf[names].to_numpy("float64"), parts, 0), dtype="float64")
            return pd.DataFrame({"region": pdf["region"].iloc[:1], "cell": pdf["cell"].iloc[:1], "tree": [tree.tobytes()]})

        trees = materialize(inner.filter(drawn).select(*keys, "n", *names).groupBy(*keys).applyInPandas(
            fit, "region int, cell long, tree binary"), "cell_trees")

        def deal(pdf: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            if tree.empty or pdf.empty:
                return pdf[columns]
            part = _assign(pdf[names].to_numpy("float64"), np.frombuffer(tree["tree"].iloc[0]).reshape(-1, 4))
            return pdf[columns].assign(cell=pdf["cell"] * (FAN + 1) + part + 1)

        salted = [*keys, "salt"]
        split = inner.withColumn("salt", F.pmod(F.xxhash64("pid"), F.col("salts")).cast("int")).drop("n", "salts")
        split = split.groupBy(*salted).cogroup(trees.join(full, keys).select(
            *keys, "tree", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).groupBy(
            *salted)).applyInPandas(deal, schema)
        placed = materialize(placed.join(full, keys, "left_anti").select(*columns).unionByName(split), "cells")


def _touched(xs: np.ndarray, radius: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point row, box row) of every box that a point's ball touches."""
    rows, boxes = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
    # Boxes that a run of similar balls could touch, then per point among those.
    order = np.argsort(radius, kind="stable")
    for part in np.array_split(order, max(1, len(order) // 128)):
        if not len(part):
            continue
        reach = radius[part].max() * (1 + 1e-12)
        near_low, near_high = xs[part].min(axis=0) - reach, xs[part].max(axis=0) + reach
        maybe = np.flatnonzero((low <= near_high).all(axis=1) & (high >= near_low).all(axis=1))
        gap = np.maximum(low[maybe][None] - xs[part][:, None], 0.0)
        gap = np.maximum(gap, xs[part][:, None] - high[maybe][None])
        i, c = np.nonzero(np.sqrt((gap**2).sum(axis=2)) <= radius[part][:, None] * (1 + 1e-12))
        rows.append(part[i])
        boxes.append(maybe[c])
    return np.concatenate(rows), np.concatenate(boxes)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for dim in range(a.shape[1]):
        total += (a[:, dim, None] - b[None, :, dim]) ** 2
    return np.sqrt(total)


def _leaves(xs: np.ndarray, size: int) -> list[np.ndarray]:
    """The rows in groups of at most ``size`` close ones, by cuts at the middle of the widest side."""
    out, stack = [], [np.arange(len(xs))]
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        widest = int(np.ptp(xs[rows], axis=0).argmax())
        order = np.argpartition(xs[rows, widest], len(rows) // 2)
        stack += [rows[order[len(rows) // 2:]], rows[order[:len(rows) // 2]]]
    return out


def _within(points: np.ndarray, xs: np.ndarray, reach: float) -> np.ndarray:
    """The points no further than ``reach`` from the box of ``xs`` on any side."""
    low, high = xs.min(axis=0), xs.max(axis=0)
    return np.flatnonzero((np.maximum(low - points, points - high) <= reach * (1 + 1e-12)).all(axis=1))


def _nearest(points: np.ndarray, queries: np.ndarray, weights: np.ndarray, ranks: np.ndarray, k: int,
             radius: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Nearest other points of the points at ``queries`` until their weights add up to ``k``.

    Returns flat (position in ``queries``, point row, distance, weight), by position, and per
    query the radius within which its k nearest lie (infinite when these points do not suffice).
    A point is its own neighbour in all its copies but one; equal distances go by ``ranks``.
    ``radius`` is a known bound on that radius.
    """
    out = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0), np.zeros(0, "int64"))]
    reach = np.full(len(queries), np.inf)
    for rows in _leaves(points[queries], LEAF):
        own = queries[rows]
        xs = points[own]
        if radius is not None:
            bound = radius[rows].max()
        elif len(rows) > k:  # each other point weighs at least 1
            bound = np.partition(_distances(xs, xs), k, axis=1)[:, k].max()
        else:
            bound = np.inf
        near_by = _within(points, xs, bound)
        distance = _distances(xs, points[near_by])
        n = distance.shape[1]
        # Each other point weighs at least 1, so the k + 1 smallest suffice; points that
        # tie with the last of them are candidates too, and the rank decides.
        width = min(k + 1, n)
        last = np.partition(distance, width - 1, axis=1)[:, width - 1:width]
        width = int((distance <= last).sum(axis=1).max())
        near = np.argpartition(distance, width - 1, axis=1)[:, :width] if width < n else \
            np.broadcast_to(np.arange(n), distance.shape)
        gap = np.take_along_axis(distance, near, axis=1)
        order = np.lexsort((ranks[near_by][near], gap), axis=-1)
        near, gap = near_by[np.take_along_axis(near, order, axis=1)], np.take_along_axis(gap, order, axis=1)
        weight = weights[near].astype("int64") - (near == own[:, None])
        total = np.cumsum(weight, axis=1)
        used = (weight > 0) & (total - weight < k)
        full = total[:, -1] >= k
        reach[rows] = np.where(full, np.where(used, gap, 0.0).max(axis=1), np.inf)
        r, c = np.nonzero(used)
        out.append((rows[r], near[r, c], gap[r, c], weight[r, c]))
    row, col, d, w = (np.concatenate(parts) for parts in zip(*out, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], col[order], d[order], w[order], reach


def _wanted(xs: np.ndarray, radius: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """The points that are among the k nearest here, and within its radius, of any of ``xs``."""
    found = np.zeros(len(points), bool)
    for rows in _leaves(xs, LEAF):
        near_by = _within(points, xs[rows], radius[rows].max())
        if not len(near_by):
            continue
        distance, bound = _distances(xs[rows], points[near_by]), radius[rows]
        crowded = np.flatnonzero((distance <= bound[:, None]).sum(axis=1) > k)
        if len(crowded):
            bound = bound.copy()
            bound[crowded] = np.partition(distance[crowded], k - 1, axis=1)[:, k - 1]
        found[near_by[(distance <= bound[:, None]).any(axis=0)]] = True
    return np.flatnonzero(found)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _matrix(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy().astype("float64") for c in names])


def _lists(values: np.ndarray | pa.Array, counts: np.ndarray) -> pa.ListArray:
    """``values`` cut into lists of these lengths."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype("int32")), values)


def _ranks(ids: pa.Array, ties: str = "first") -> np.ndarray:
    return pc.rank(ids, sort_keys="ascending", tiebreaker=ties).to_numpy().astype("int64")


def knn_cells(points: DataFrame, columns: Sequence[str], k: int, by: Sequence[str] = (),
              cell_points: int = CELL_POINTS, regions: int = REGIONS, distances: bool = False) -> DataFrame:
    """Exact k nearest other rows of every distinct point, stored packed by cell.

    ``points`` comes from ``collapse_points``.  A row holds points of one (region, cell), a part of
    the cell where its points asked many others: ``pid`` and ``x_`` with a column's name hold its points, ``kd`` their
    distance to the last neighbour, ``n`` how many entries of ``at`` and ``used`` (and of ``d``, with
    ``distances``) are a point's.  ``at`` names a neighbour by its place in ``ids``; ``homes`` tells the cells these lie
    in.  Equal distances are ordered by the lowest uid.  k is clamped to n - 1.  ``regions`` bounds
    what every task is sent, not the number of cells.
    """
    by, names = list(by), list(columns)
    if len(by) > 1:
        raise ValueError("one key column: combine several into a struct or a string first")
    dim = len(names)
    spark = points.sparkSession
    types = dict(points.dtypes)

    totals = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total"))
    sizes = {tuple(r[c] for c in by): (r["n"], r["total"]) for r in totals.collect()}
    n_all = sum(n for n, _ in sizes.values())
    slots = 1 << 31
    share = min(1.0, SAMPLE_ROWS / max(n_all, 1))
    sample = points.filter(
        F.pmod(F.xxhash64("pid"), F.lit(slots)) < int(share * slots) + 1).select(*by, *names).toPandas()

    trees, clamp, first = {}, {}, 0
    for key, (n, total) in sorted(sizes.items()):
        mask = np.ones(len(sample), bool)
        for name, value in zip(by, key, strict=True):
            mask &= (sample[name] == value).to_numpy()
        cells = int(min(regions * n / n_all + 1, -(-n // cell_points)))
        tree = np.array(_split(sample.loc[mask, names].to_numpy("float64").reshape(-1, dim),
                               max(cells, 1), first), dtype="float64")
        first = int(tree[tree[:, 0] < 0, 2].max()) + 1
        trees[key], clamp[key] = tree, int(max(min(k, total - 1), 0))
    shared_trees = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("int")
    def cell_of(keys: pd.DataFrame, values: pd.DataFrame) -> pd.Series:
        xs = values.to_numpy("float64")
        out = np.zeros(len(xs), dtype="int32")
        groups = keys.iloc[:, 0].to_numpy() if by else None
        for key, tree in shared_trees.value.items():
            chosen = np.ones(len(xs), bool) if groups is None else groups == key[0]
            if chosen.any():
                out[chosen] = _assign(xs[chosen], tree)
        return pd.Series(out)

    key_struct = F.struct(*by) if by else F.struct(F.lit(0).alias("none"))
    placed = materialize(points.select(
        *by, *names, "pid", "w", cell_of(key_struct, F.struct(*names)).alias("region"),
        F.lit(0).cast("long").alias("cell")), "cells")

    edges = [a for c in names for a in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    lows, highs = [f"lo_{c}" for c in names], [f"hi_{c}" for c in names]
    boxes = placed.groupBy(*by, "region").agg(F.count(F.lit(1)).alias("n"), *edges).toPandas()
    boxes["split"] = boxes["n"] > OVERFULL * cell_points
    layout = {}
    for key in sizes:
        mask = np.ones(len(boxes), bool)
        for name, value in zip(by, key, strict=True):
            mask &= (boxes[name] == value).to_numpy()
        part = boxes[mask]
        layout[key] = (part["region"].to_numpy("int32"), part["split"].to_numpy(bool),
                       part[lows].to_numpy("float64"), part[highs].to_numpy("float64"), clamp[key])
    shared = spark.sparkContext.broadcast(layout)
    if boxes["split"].any():
        placed = _refine(placed, names, cell_points)

    pid_type = types["pid"]
    by_ddl = "".join(f"{c} {types[c]}, " for c in by)
    x_ddl = "".join(f"{c} double, " for c in names)

    def key_of(table: pa.Table) -> tuple:
        return tuple(table.column(c)[0].as_py() for c in by)

    local_ddl = (f"{by_ddl}{x_ddl}pid {pid_type}, w long, radius double, region int, cell long, "
                 f"part int, parts int, asks array<int>")
    local_type = to_arrow_schema(StructType.fromDDL(local_ddl))

    def inside(table: pa.Table) -> pa.Table:
        """The radius of every point within the cell, and the regions it has to ask."""
        regions_, split, low, high, k_here = shared.value[key_of(table)]
        xs, n = _matrix(table, names), len(table)
        radius, asks, asked = np.zeros(n), np.zeros(0, "int64"), np.zeros(0, "int32")
        if k_here:
            radius = _nearest(xs, np.arange(n), table.column("w").to_numpy(), _ranks(_whole(table.column("pid"))), k_here)[-1]
            # A split region has more cells than one's own.
            others = np.flatnonzero((regions_ != table.column("region")[0].as_py()) | split)
            asks, box = _touched(xs, radius, low[others], high[others])
            order = np.argsort(asks, kind="stable")
            asks, asked = asks[order], regions_[others[box[order]]]
        counts = np.bincount(asks, minlength=n)
        part = np.cumsum(counts) // REQUEST_ROWS  # points of a cell that ask much are answered apart
        return pa.Table.from_arrays([
            *(table.column(c) for c in (*by, *names, "pid", "w")), pa.array(radius), table.column("region"),
            table.column("cell"), pa.array(part), pa.array(np.full(n, part[-1] + 1)), _lists(asked, counts)],
            names=local_type.names).cast(local_type)

    local = materialize(placed.groupBy(*by, "region", "cell").applyInArrow(inside, local_ddl), "knn_local")

    home = ["home_region", "home_cell", "home_part"]

    def shares(requests: DataFrame, keys: list[str]) -> DataFrame:
        """In how many groups the requests of a key are answered."""
        return materialize(requests.groupBy(*keys).agg(
            F.ceil(F.count(F.lit(1)) / REQUEST_ROWS).cast("int").alias("parts")), "knn_load")

    def dealt(requests: DataFrame, load: DataFrame, keys: list[str]) -> DataFrame:
        return requests.join(load, keys).withColumn(
            "part", F.pmod(F.xxhash64(*home), F.col("parts")).cast("int"))

    def copied(rows: DataFrame, load: DataFrame, keys: list[str]) -> DataFrame:
        return rows.join(load, keys).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    request_columns = [*by, *names, "radius", *home, "region", "cell"]

    def route(req: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        """Requests to a split region, sent on to its cells but the point's own."""
        if req.empty or cells.empty:
            return pd.DataFrame({c: [] for c in request_columns})
        row, box = _touched(req[names].to_numpy("float64"), req["radius"].to_numpy(),
                            cells[lows].to_numpy("float64"), cells[highs].to_numpy("float64"))
        sent = req.iloc[row].assign(cell=cells["cell"].to_numpy()[box])
        own = (sent["region"] == sent["home_region"]) & (sent["cell"] == sent["home_cell"])
        return sent.loc[~own, request_columns]

    requests = local.select(*by, *names, "radius", F.col("region").alias("home_region"), F.col("cell").alias(
        "home_cell"), F.col("part").alias("home_part"), F.explode("asks").alias("region"), F.lit(0).cast("long").alias("cell"))
    if boxes["split"].any():
        fine = materialize(placed.filter("cell > 0").groupBy("region", "cell").agg(*edges), "cell_boxes")
        inner = requests.join(fine.select("region").distinct(), "region", "left_semi").select(*request_columns)
        load = shares(inner, ["region"])
        sent = dealt(inner, load, ["region"]).drop("parts").groupBy("region", "part").cogroup(
            copied(fine, load, ["region"]).drop("parts").groupBy("region", "part")).applyInPandas(
            route, requests.schema)
        requests = materialize(requests.join(fine.select("region").distinct(), "region", "left_anti").select(
            *request_columns).unionByName(sent), "knn_routed")
    keys = ["region", "cell"]
    load = shares(requests, keys)

    remote_ddl = f"home_region int, home_cell long, home_part int, {x_ddl}pid {pid_type}, w long, region int, cell long"
    remote_type = to_arrow_schema(StructType.fromDDL(remote_ddl))

    def across(req: pa.Table, table: pa.Table) -> pa.Table:
        """The points of this cell that the asking ones of a part need, once a part."""
        if not len(req) or not len(table):
            return remote_type.empty_table()
        xs, radius, points = _matrix(req, names), req.column("radius").to_numpy(), _matrix(table, names)
        asking, of = np.unique(np.stack([req.column(c).to_numpy() for c in home]), axis=1, return_inverse=True)
        order, k_here = np.argsort(of.ravel(), kind="stable"), shared.value[key_of(req)][4]
        found = [_wanted(xs[rows], radius[rows], points, k_here)
                 for rows in np.split(order, np.cumsum(np.bincount(of.ravel()))[:-1])]
        col = pa.array(np.concatenate(found))
        return pa.Table.from_arrays([*(pa.array(np.repeat(x, [len(f) for f in found])) for x in asking),
                                     *(table.column(c).take(col) for c in (*names, "pid", "w", *keys))],
                                    names=remote_type.names).cast(remote_type)

    remote = dealt(requests, load, keys).select(*by, *keys, "part", *home, *names, "radius").groupBy(
        *keys, "part").cogroup(
        copied(placed, load, keys).select(*keys, "part", *names, "pid", "w").groupBy(*keys, "part")
    ).applyInArrow(across, remote_ddl)

    near_ddl = (f"{by_ddl}region int, cell long, part int, pid array<{pid_type}>, "
                + "".join(f"x_{c} array<double>, " for c in names)
                + ("d array<double>, " if distances else "") + "kd array<double>, n array<int>, at binary, used array<int>, "
                f"ids array<{pid_type}>, homes array<struct<region:int,cell:bigint,start:int,n:int>>")
    near_type = to_arrow_schema(StructType.fromDDL(near_ddl))

    def merged(cell: pa.Table, answers: pa.Table) -> pa.Table:
        """The k nearest of the points of a part, among those of the cell and what others sent."""
        if not len(cell):
            return near_type.empty_table()
        tables = [cell, answers] if len(answers) else [cell]
        ids = pa.concat_arrays([_whole(t.column("pid")) for t in tables])
        xs = np.concatenate([_matrix(t, names) for t in tables])
        region, of_cell, w = (np.concatenate([t.column(c).to_numpy() for t in tables]) for c in (*keys, "w"))
        mine = np.flatnonzero(cell.column("part").to_numpy() == cell.column("_part").to_numpy())
        k_here = shared.value[key_of(cell)][4]
        row, col, d, used = np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0), np.zeros(0, "int64")
        if k_here:
            row, col, d, w, _ = _nearest(xs, mine, w, _ranks(ids), k_here, cell.column("radius").to_numpy()[mine])
            total = np.cumsum(w)
            before = total - w
            before -= np.concatenate([[0], total])[np.searchsorted(row, np.arange(len(mine)))][row]
            used = np.minimum(w, k_here - before)
        counts = np.bincount(row, minlength=len(mine))
        kd = np.full(len(mine), np.nan)
        kd[counts > 0] = d[(np.cumsum(counts) - 1)[counts > 0]]
        # Every neighbour once, by home cell.
        one, at = np.unique(col, return_inverse=True)
        order = np.lexsort((one, of_cell[one], region[one]))
        place = np.empty(len(one), "int64")
        place[order] = np.arange(len(one))
        one = one[order]
        homes = np.stack([region[one], of_cell[one]])
        starts = np.flatnonzero(np.concatenate([[True], (homes[:, 1:] != homes[:, :-1]).any(axis=0)])[:len(one)])
        homes = [{"region": int(region[i]), "cell": int(of_cell[i]), "start": int(s), "n": int(m)} for i, s, m in zip(
            one[starts], starts, np.diff([*starts, len(one)]), strict=True)]
        packed = [ids.take(pa.array(mine)), *xs[mine].T, *([d] if distances else []), kd, counts, used,
                  ids.take(pa.array(one)), pa.array(homes, near_type.field("homes").type.value_type)]
        columns_ = [_lists(np.ascontiguousarray(x) if isinstance(x, np.ndarray) else x, np.array([len(x)])) for x in packed]
        at = pa.array([place[at].astype(_place_type(len(one))).tobytes()], pa.binary())
        columns_.insert(len(columns_) - 3, at)
        return pa.Table.from_arrays([*(cell.column(c).slice(0, 1) for c in (*by, *keys, "_part")), *columns_],
                                    names=near_type.names).cast(near_type)

    own = local.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        *by, *keys, *names, "pid", "w", "radius", "part", "_part")
    near = own.groupBy(*keys, "_part").cogroup(remote.groupBy(*home)).applyInArrow(merged, near_ddl)
    return materialize(near, "neighbours")


def _place_type(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def places(at: bytes, n: int) -> np.ndarray:
    """The places, among ``n`` ids, that ``at`` of ``knn_cells`` holds."""
    return np.frombuffer(at, _place_type(n)).astype("int64")


def neighbour_values(near: DataFrame, values: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """What ``near`` (of ``knn_cells``) needs to look up columns of its neighbours.

    ``values`` has region, cell and, as arrays, ``pid`` and the ``wanted`` columns.  A row of the result
    is for the row (region, cell, part) of ``near``: ``found`` holds the values, side by side, of its ``ids``
    from ``start`` on, null for an unknown id.  An id that several points of a row have as a neighbour travels once.
    """
    keys = ["region", "cell"]
    asks = near.select("region", "cell", "part", "ids", F.explode("homes").alias("_h")).select(
        F.col("_h.region").alias("region"), F.col("_h.cell").alias("cell"), F.col("region").alias("to_region"),
        F.col("cell").alias("to_cell"), "part", F.col("_h.start").alias("start"),
        F.slice("ids", F.col("_h.start") + 1, F.col("_h.n")).alias("ids"))
    schema = "region int, cell long, part int, start int, found array<double>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def look_up(req: pa.Table, table: pa.Table) -> pa.Table:
        if not len(req) or not len(table):
            return arrow.empty_table()
        ids = _whole(req.column("ids"))
        at = pc.index_in(ids.flatten(), value_set=_whole(table.column("pid")).flatten(), skip_nulls=True)
        found = np.column_stack([_whole(table.column(c)).flatten().take(at).to_numpy(zero_copy_only=False) for c in wanted])
        return pa.Table.from_arrays([*(req.column(c) for c in ("to_region", "to_cell", "part", "start")), _lists(
            found.ravel(), pc.list_value_length(ids).to_numpy() * len(wanted))], names=arrow.names).cast(arrow)

    return asks.groupBy(*keys).cogroup(values.select(*keys, "pid", *wanted).groupBy(*keys)).applyInArrow(look_up, schema)


def gathered(found: pa.Table, size: int, width: int = 1) -> np.ndarray:
    """The values of a row's ids in their order, NaN where there is none."""
    out = np.full((size, width), np.nan)
    for start, values in zip(found.column("start").to_pylist(), _whole(found.column("found")), strict=True):
        part = values.values.to_numpy(zero_copy_only=False).reshape(-1, width)
        out[start:start + len(part)] = part
    return out


def knn_self(points: DataFrame, columns: Sequence[str], k: int, by: Sequence[str] = (),
             cell_points: int = CELL_POINTS, regions: int = REGIONS) -> DataFrame:
    """``knn_cells`` with one row per (pid, nid): distance ``d`` and ``used``, the copies of nid
    among the k neighbours."""
    near = knn_cells(points, columns, k, by, cell_points, regions, distances=True)
    types = dict(points.dtypes)
    schema = "".join(f"{c} {types[c]}, " for c in by) + f"pid {types['pid']}, nid {types['pid']}, d double, used long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {c: batch.column(c)[i] for c in batch.schema.names}
                n = cell["n"].values.to_numpy()
                point = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([
                    *(pa.repeat(cell[c], len(point)) for c in by), cell["pid"].values.take(point),
                    cell["ids"].values.take(pa.array(places(cell["at"].as_py(), len(cell["ids"].values)))), cell["d"].values, cell["used"].values.cast("int64")],
                    names=arrow.names).cast(arrow)

    return near.select(*by, "pid", "n", "at", "d", "used", "ids").mapInArrow(run, schema)
