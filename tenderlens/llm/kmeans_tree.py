"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample; every vector of the table is then put into its leaf.
A query walks the tree through a priority queue, nearest centre first, and visits leaves in
that order.  How many leaves are visited is calibrated: for a sample of queries the exact
neighbours are found, and visits are widened until the mean recall reaches the goal.  A query
whose leaves hold too few rows for ``k`` neighbours goes on to further leaves.

Queries and vectors of a leaf meet by a repartition on the leaf.  Large leaves, and leaves
that very many queries visit, are cut into blocks.  Of equal vectors only the ``k`` + 1
smallest ids can ever be found, so a frequent vector does not make a leaf hot.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlens.llm.common import Shared
from tenderlens.runtime import materialize

SAMPLE = 16_384  # vectors the tree is fitted on, at most
BRANCH = 8
LEAF_ROWS = 64  # vectors a leaf should hold; a fixed sample bounds the number of leaves
CALIBRATION = 256  # queries whose exact neighbours are found, at most
RECALL = 0.96  # mean recall that the calibration queries must reach
BLOCK = 4096  # rows of a leaf, or queries of a leaf, that meet in one group
_PENDING = 200_000  # candidate rows a task holds before it reduces them to the best k


def usable(vec: Column) -> Column:
    """Neither null, empty, zero nor with a null or non-finite component."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & good & F.exists(vec, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist() if isinstance(column, pd.Series) else column, dtype=np.float64)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (-2 * x @ centers.T + (centers ** 2).sum(1)).argmin(1)
        for j in range(k):
            if (near == j).any():
                centers[j] = x[near == j].mean(0)
    return centers


class KMeansTree:
    """Nodes in arrays: a node's children are consecutive, a leaf has none."""

    def __init__(self, sample: np.ndarray, n_leaves: int, branch: int = BRANCH, seed: int = 11):
        rng = np.random.default_rng(seed)
        least = max(len(sample) / max(n_leaves, 1), 1)
        width = sample.shape[1] if sample.ndim == 2 else 0
        self.centers, self.first, self.count = [np.zeros(width)], [0], [0]
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            k = int(min(branch, round(len(rows) / least)))
            if k < 2 or len(np.unique(sample[rows], axis=0)) < k:
                continue
            centers = _kmeans(sample[rows], k, rng)
            near = (-2 * sample[rows] @ centers.T + (centers ** 2).sum(1)).argmin(1)
            self.first[node], self.count[node] = len(self.centers), k
            for j in range(k):
                todo.append((len(self.centers), rows[near == j]))
                self.centers.append(centers[j])
                self.first.append(0)
                self.count.append(0)
        self.centers = np.array(self.centers)
        self.n_leaves = sum(c == 0 for c in self.count)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls into, nearest centre at every level."""
        node = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if not self.count[at] or not len(rows):
                node[rows] = at
                continue
            kids = self.centers[self.first[at]:self.first[at] + self.count[at]]
            near = (-2 * x[rows] @ kids.T + (kids ** 2).sum(1)).argmin(1)
            todo.extend((self.first[at] + j, rows[near == j]) for j in range(len(kids)))
        return node

    def visit(self, q: np.ndarray, most: int, held: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order: ``most`` of them, and on until they hold ``least`` rows by ``held``."""
        distance = ((self.centers - q) ** 2).sum(1)
        heap, found, rows = [(0.0, 0)], [], 0
        while heap and (len(found) < most or (held is not None and rows < least)):
            _, node = heapq.heappop(heap)
            if not self.count[node]:
                found.append(node)
                rows += held.get(node, 0) if held is not None else 0
                continue
            for child in range(self.first[node], self.first[node] + self.count[node]):
                heapq.heappush(heap, (float(distance[child]), child))
        return found


def prepare(vectors: DataFrame, vec_id: str, vec: str) -> DataFrame:
    """vec_id, vec (doubles) of the vectors that take part."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vec).cast("array<double>").alias("vec"))
    return rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))


def fit_tree(rows: DataFrame, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS) -> KMeansTree:
    """From ``sample`` vectors drawn by a hash of their id; all must have the same width."""
    n, width, widest = rows.agg(F.count(F.lit(1)), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if n and width != widest:
        raise ValueError("vectors of different widths")
    share = min(1.0, 1.2 * sample / max(n, 1))
    drawn = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    picked = drawn.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").toPandas()
    x = _matrix(picked["vec"]) if len(picked) else np.zeros((0, width or 0))
    return KMeansTree(x, int(min(max(n // leaf_rows, 1), max(len(x) // 8, 1))))


def assign(rows: DataFrame, tree: KMeansTree) -> DataFrame:
    """Every vector with its leaf: the index."""
    shared = Shared(rows.sparkSession, tree)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(leaf=shared.value.leaf_of(_matrix(frame["vec"])))

    return rows.mapInPandas(run, "vec_id long, vec array<double>, leaf int")


def _best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = frame.sort_values(["query_id", "score", "vec_id"], kind="stable")
    return ordered[ordered.groupby("query_id").cumcount() < k]


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact Euclidean distances in double precision, straight from the differences."""
    return np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(2))


def _nearest(query_ids, q, vec_ids, x, k: int) -> pd.DataFrame:
    """Best k of one block for each query, itself left out; ties to the smaller id."""
    order = np.argsort(vec_ids, kind="stable")
    vec_ids, x, parts = vec_ids[order], x[order], []
    step = max(1, 2_000_000 // max(x.size, 1))
    for at in range(0, len(q), step):
        d = _distances(q[at:at + step], x)
        d[query_ids[at:at + step, None] == vec_ids[None, :]] = np.inf
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        found = pd.DataFrame({
            "query_id": np.repeat(query_ids[at:at + step], best.shape[1]), "vec_id": vec_ids[best].ravel(),
            "score": np.take_along_axis(d, best, 1).ravel()})
        parts.append(found[np.isfinite(found["score"])])
    return pd.concat(parts)


def exact(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Brute force for a bounded set of queries, which travel to the vectors' blocks."""
    held = queries.toPandas()
    ids, q = held["query_id"].to_numpy(), _matrix(held["vec"])
    shared = rows.sparkSession.sparkContext.broadcast((ids, q))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        best = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        for frame in frames:
            if len(frame) and len(ids):
                near = _nearest(ids, q, frame["vec_id"].to_numpy(), _matrix(frame["vec"]), k)
                best = _best(pd.concat([best, near]), k)
        yield best

    found = rows.select("vec_id", "vec").mapInPandas(run, "query_id long, vec_id long, score double")
    return top(found, k)


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def calibrate(index: DataFrame, queries: DataFrame, tree: KMeansTree, k: int, goal: float = RECALL,
              sample: int = CALIBRATION) -> int:
    """Leaves to visit so that the sampled queries find ``goal`` of their exact neighbours."""
    drawn = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    drawn = materialize(drawn, "ann-calibration")
    truth = exact(index, drawn, k).join(index.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").toPandas()
    held = drawn.toPandas()
    if not len(truth):
        return 1
    needed = []
    for query_id, vec in zip(held["query_id"], held["vec"], strict=True):
        place = {leaf: i + 1 for i, leaf in enumerate(tree.visit(np.asarray(vec), tree.n_leaves))}
        needed.extend(place[leaf] for leaf in truth.loc[truth["query_id"] == query_id, "leaf"])
    needed.sort()
    return int(needed[min(int(np.ceil(goal * len(needed))), len(needed)) - 1])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vec: str = "vec",
           visits: int | None = None, goal: float = RECALL) -> DataFrame:
    """The ``k`` nearest found per query: query_id, rank, vec_id, score (Euclidean distance).

    ``queries`` has the same two columns; a query's own id is no candidate.  Vectors and
    queries that are null, empty, zero or hold null or non-finite components take no part.
    Ties go to the smaller id; of repeated ids every row is a candidate.  Fewer candidates
    than ``k``: all of them.  Empty tables give an empty result.
    """
    rows = prepare(vectors, vec_id, vec)
    tree = fit_tree(rows)
    copies = Window.partitionBy(F.xxhash64("vec"), "vec").orderBy("vec_id")
    index = materialize(assign(rows, tree).withColumn("_n", F.row_number().over(copies)).filter(
        F.col("_n") <= k + 1).drop("_n"), "ann-index")
    asked = materialize(prepare(queries, vec_id, vec).withColumnRenamed("vec_id", "query_id"), "ann-queries")
    held = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}  # one row per leaf of the tree
    shared = Shared(rows.sparkSession, (tree, held))
    most = visits or calibrate(index, asked, tree, k, goal)
    # A query's own rows are no candidates: one, or as many as repeat its id.
    repeated = materialize(index.groupBy("vec_id").agg(F.count(F.lit(1)).alias("_own")).filter("_own > 1"), "ann-repeated")
    counted = asked.join(repeated, F.col("query_id") == F.col("vec_id"), "left").select(
        "query_id", "vec", F.coalesce("_own", F.lit(1)).alias("own"))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, held = shared.value
        for frame in frames:
            if len(frame):
                found = [tree.visit(np.asarray(v), most, held, k + own)
                         for v, own in zip(frame["vec"], frame["own"], strict=True)]
                yield frame[["query_id"]].assign(leaf=[np.array(f, np.int32) for f in found])

    routed = counted.mapInPandas(route, "query_id long, leaf array<int>")
    visited = materialize(routed.select("query_id", F.explode("leaf").alias("leaf")), "ann-visits")
    blocks = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_rows")).join(
        visited.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_asked")), "leaf")
    blocks = materialize(blocks, "ann-blocks")
    every = F.sequence(F.lit(0), F.col("_other") - 1)
    left = index.join(blocks, "leaf").withColumnRenamed("_asked", "_other").select(
        "leaf", F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "vec",
        F.pmod(F.xxhash64("vec_id"), F.col("_rows")).cast("int").alias("row_block"), F.explode(every).alias("query_block"))
    right = visited.join(asked, "query_id").join(blocks, "leaf").withColumnRenamed("_rows", "_other").select(
        "leaf", F.lit(0).alias("kind"), F.col("query_id").alias("id"), "vec",
        F.explode(every).alias("row_block"), F.pmod(F.xxhash64("query_id"), F.col("_asked")).cast("int").alias("query_block"))
    met = left.unionByName(right).repartition("leaf", "row_block", "query_block").sortWithinPartitions(
        "leaf", "row_block", "query_block", "kind", "id")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, ids, q, pending, size = None, [], [], [], 0
        for frame in frames:
            keys = frame[["leaf", "row_block", "query_block", "kind"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(frame)], strict=True):
                if a == b:
                    continue
                if group is None or tuple(keys[a][:3]) != group:
                    group, ids, q = tuple(keys[a][:3]), [], []
                part = frame.iloc[a:b]
                if keys[a][3] == 0:
                    ids.append(part["id"].to_numpy())
                    q.append(_matrix(part["vec"]))
                elif ids:
                    near = _nearest(np.concatenate(ids), np.concatenate(q), part["id"].to_numpy(),
                                    _matrix(part["vec"]), k)
                    pending.append(near)
                    size += len(near)
                    if size > _PENDING:
                        pending = [_best(pd.concat(pending), k)]
                        if len(pending[0]) > _PENDING // 2:
                            yield pending.pop()
                        size = sum(map(len, pending))
        if pending:
            yield _best(pd.concat(pending), k)

    found = met.mapInPandas(scan, "query_id long, vec_id long, score double")
    return top(found, k)
