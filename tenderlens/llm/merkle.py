"""Merkle manifest of a dataset by lag/lead windows.

Every row is a leaf; the leaves of a group are nodes of level 0 in key order.  On each level a
run of 16 consecutive nodes is one window.  Lag and lead columns at the fixed offsets 1 to 15,
masked by the node's slot and the length of its run, supply its siblings; the first child of
a run, which sees the others by its leads, hashes them to the parent.  The roots of the groups
are the leaves of one last tree.

Going up, only (tree, position, digest) moves.  Going down, the sibling steps of the parents
(a sixteenth of the rows) meet the children on the key of the window, so the children are
dealt once for the window and the join.  No group is ever sorted as a whole: positions come
from one range partitioning of all leaves, rows counted per partition, and prefix sums over
the partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.runtime import materialize

RUN = 16
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value; integers as decimals."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(*[encoded(v) for v in values])


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds the position 0..n-1 in the order of the columns ``order`` (nulls first).

    Rows are dealt by ranges of the order, so equal rows should be told apart by a last
    column.  What is gathered is one count per partition.
    """
    place = F.monotonically_increasing_id()  # partition << 33 | row inside the partition
    dealt = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place),
                        "merkle-dealt")
    counts = dealt.groupBy(F.shiftright("_place", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")),
                          "merkle-offsets")
    inside = F.col("_place").bitwiseAND((1 << 33) - 1)
    return dealt.join(offsets, F.shiftright("_place", 33) == F.col("_part")).withColumn(
        name, F.col("_before") + inside).drop("_place", "_part", "_before", "_rows")


def _in_runs(nodes: DataFrame) -> DataFrame:
    """Adds run, slot in the run and the run's length."""
    placed = nodes.withColumns({"_run": F.expr(f"pos div {RUN}"), "_slot": (F.col("pos") % RUN).cast("int")})
    return placed.withColumn("_len", F.least(F.lit(RUN), F.col("n") - F.col("_run") * RUN))


def _neighbours(offsets: Sequence[int]) -> list[Column]:
    """Digests at the given offsets from a node, nearest slots as named; empty beyond its run."""
    run = Window.partitionBy("tree", "_run").orderBy("_slot")
    found = []
    for k in offsets:
        beside, inside = (F.lag("node", -k), F.col("_slot") >= -k) if k < 0 else (
            F.lead("node", k), F.col("_slot") + k < F.col("_len"))
        found.append(F.when(inside, beside.over(run)).otherwise(""))
    return found


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: first-child rows hash their run."""
    others = [c.alias(f"_k{k}") for k, c in zip(range(1, RUN), _neighbours(range(1, RUN)), strict=True)]
    seen = _in_runs(nodes.filter("n > 1")).select("tree", "n", "_run", "_slot", "node", *others)
    return seen.filter("_slot = 0").select(
        "tree", F.col("_run").alias("pos"), F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"),
        digest("node", *[F.col(f"_k{k}") for k in range(1, RUN)]).alias("node"))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """Node tables (tree, pos, n, node) from the leaves up; a tree's top is its row with n = 1."""
    found = [nodes]
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        found.append(materialize(parents(found[-1].select("tree", "pos", "n", "node")), "merkle-level"))
        largest = -(-largest // RUN)
    return found


def with_steps(nodes: DataFrame, above: DataFrame | None, tops: DataFrame) -> DataFrame:
    """Adds ``steps`` (before, after) from the node to the root, and the columns that ``tops`` hands down.

    ``above`` is the next level with steps; ``tops`` has one row per tree: tree, steps of its
    top, and any other columns, which ``above`` has too.
    """
    handed = [c for c in tops.columns if c not in ("tree", "steps")]
    lone = nodes.filter("n = 1").join(tops, "tree")
    if above is None:
        return lone
    up = above.select("tree", F.col("pos").alias("_run"), F.col("steps").alias("_above"), *handed)
    before = [c.alias(f"_b{k}") for k, c in zip(range(1, RUN), _neighbours(range(-1, -RUN, -1)), strict=True)]
    after = [c.alias(f"_a{k}") for k, c in zip(range(1, RUN), _neighbours(range(1, RUN)), strict=True)]
    seen = _in_runs(nodes.filter("n > 1")).select(*nodes.columns, "_run", *before, *after)
    step = F.struct(F.concat(*[F.col(f"_b{k}") for k in range(RUN - 1, 0, -1)]).alias("before"),
                    F.concat(*[F.col(f"_a{k}") for k in range(1, RUN)]).alias("after"))
    inner = seen.join(up, ["tree", "_run"]).select(
        *nodes.columns, F.concat(F.array(step), F.col("_above")).alias("steps"), *handed)
    return inner.unionByName(lone.select(inner.columns))


def descend(found: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with the steps to their root; the tables above them are stored level by level."""
    above = None
    for nodes in reversed(found[1:]):
        above = materialize(with_steps(nodes, above, tops), "merkle-steps")
    return with_steps(found[0], above, tops)


def proof(steps: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf gives with the siblings of its steps."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", fields: Sequence[str] = FIELDS,
             changed: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, leaf, changed, subroot, root, steps.

    A leaf hashes ``fields`` in order.  Groups are the values of ``source``, null among them,
    ordered null first and then bytewise; leaves ascend by ``doc_id`` (null first), then by
    digest; rows that agree in all fields are leaves of their own.  ``changed`` gives new values
    of fields, null where a row keeps its value: the digest with these is returned beside the
    leaf.  A group of one row is its own subroot and has no step inside the group.  An empty
    table has no rows, and so no root.
    """
    changed = changed or {}
    now = [F.coalesce(changed[f], F.col(f)) if f in changed else F.col(f) for f in fields]
    touched = F.lit(False)
    for value in changed.values():
        touched = touched | value.isNotNull()
    now_digest = F.when(touched, leaf_digest(*now)) if changed else F.lit(None).cast("string")
    leaves = materialize(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        leaf_digest(*[F.col(f) for f in fields]).alias("node"), now_digest.alias("changed"),
        F.rand(0).alias("_tie")), "merkle-leaves")
    placed = numbered(leaves, ["source", "doc_id", "node", "_tie"], "_at").drop("_tie")
    groups = placed.groupBy("source").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    trees = materialize(numbered(groups, ["source"], "tree").withColumnRenamed("source", "_source"), "merkle-trees")
    nodes = materialize(placed.join(trees, F.col("source").eqNullSafe(F.col("_source"))).select(
        "tree", (F.col("_at") - F.col("_first")).alias("pos"), "n", "node", "doc_id", "changed"), "merkle-nodes")
    found = levels(nodes)
    subroots = found[0].select("tree", "n", "node")
    for level in found[1:]:
        subroots = subroots.unionByName(level.select("tree", "n", "node"))
    subroots = materialize(subroots.filter("n = 1").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees.count()).alias("n"), "node"),
        "merkle-subroots")
    upper = levels(subroots)
    root = upper[-1].filter("n = 1").select(
        "tree", F.array().cast("array<struct<before:string,after:string>>").alias("steps"), F.col("node").alias("root"))
    tops = materialize(descend(upper, materialize(root, "merkle-root")).select(
        F.col("pos").alias("tree"), "steps", F.col("node").alias("subroot"), "root"), "merkle-tops")
    return descend(found, tops).select(
        "doc_id", F.col("node").alias("leaf"), F.coalesce("changed", "node").alias("changed"), "subroot", "root", "steps")


def verify(docs: DataFrame, tampered: Column, doc_id: str = "doc_id", source: str = "source",
           fields: Sequence[str] = FIELDS, text: str = "text") -> DataFrame:
    """The manifest, and the check of every row after the rows marked ``tampered`` had A-Z of their text lowered.

    doc_id, leaf, subroot, root, proof_sha256 (of the untampered rows), folded_root (from the
    row as it is now and the stored siblings), verified.  Null texts stay, and so do rows
    whose mark is null.
    """
    lowered = F.when(tampered, F.translate(F.col(text), UPPER, LOWERED))
    return manifest(docs, doc_id, source, fields, {text: lowered}).select(
        "doc_id", "leaf", "subroot", "root", proof(F.col("steps")).alias("proof_sha256"),
        folded(F.col("changed"), F.col("steps")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
