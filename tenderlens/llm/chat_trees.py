"""Chat formatting from reply trees, in DataFrame operations only.

Ancestors are found by self-joins that double their reach: after round k every leaf knows
its 2**k nearest ancestors, so a thread of n turns takes log2(n) rounds.  Joins use
(tree, node) keys and move ids only; texts are joined once, to the chosen paths.

One turn is written ``<s>[INST]role[/INST]text</s>``.  Inside roles and texts a backslash is
doubled and the control strings get a backslash after their first character, which makes
the escape reversible and keeps every written control string a real one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.runtime import materialize

OPEN, SPLIT, CLOSE = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(?=s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])"


def escape(text: Column) -> Column:
    """Null counts as empty."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def branches(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every ancestor of every leaf, ``up`` steps above it.

    ``nodes`` has tree, node, parent.  A null or unknown parent makes a root.  Nodes on a
    cycle lie on no path from a root and are left out.  Trees may be null.
    """
    links = materialize(nodes.select("tree", "node", "parent").dropDuplicates(["tree", "node"]), "chat-links")
    key, other = links.alias("a"), links.alias("b")

    def same(left: str, right: str) -> Column:
        return F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col(left) == F.col(right))

    leaf = key.join(other, same("a.node", "b.parent"), "left_anti").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up"))
    jump = materialize(key.join(other, same("a.parent", "b.node")).select("a.tree", "a.node", "a.parent"), "chat-jump")
    reach, limit = 1, max(links.count(), 1)
    while reach <= limit and not jump.isEmpty():
        further = leaf.alias("a").join(jump.alias("b"), same("a.node", "b.node")).select(
            "a.tree", "a.leaf", F.col("b.parent").alias("node"), (F.col("a.up") + reach).alias("up"))
        leaf = materialize(leaf.unionByName(further), "chat-paths")
        jump = materialize(jump.alias("a").join(jump.alias("b"), same("a.parent", "b.node")).select(
            "a.tree", "a.node", "b.parent"), "chat-jump")
        reach *= 2
    return leaf


def format_trees(nodes: DataFrame, top: int = 1) -> DataFrame:
    """One formatted conversation per chosen root-to-leaf path.

    ``nodes`` has tree, node, parent, role, text, score (null scores count as 0).  Branches
    are ranked per tree by mean score, then by length, then by leaf; ``top`` of them are
    taken.  A repeated (tree, node) keeps its smallest (role, text).  Assistant text is under
    the loss mask in the best chosen branch that holds it.  A conversation is one row by
    nature: its size is that of its own turns.

    Returns tree, leaf, branch, score, n_turns, formatted, loss_spans (code point start and
    end of the escaped assistant texts in ``formatted``).
    """
    order = Window.partitionBy("tree", "node").orderBy(F.col("role"), F.col("text"), F.col("parent"))
    nodes = nodes.withColumn("_first", F.row_number().over(order)).filter("_first = 1").drop("_first")
    paths = branches(nodes)
    n, p = nodes.alias("n"), paths.alias("p")
    same = F.col("n.tree").eqNullSafe(F.col("p.tree")) & (F.col("n.node") == F.col("p.node"))
    scored = p.join(n.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score")).alias("n"), same)
    rated = scored.groupBy(F.col("p.tree").alias("tree"), "leaf").agg(
        F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_turns"))
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n_turns"), F.asc("leaf"))
    rated = rated.withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= top)
    r = rated.alias("r")
    chosen = p.join(r, F.col("p.tree").eqNullSafe(F.col("r.tree")) & (F.col("p.leaf") == F.col("r.leaf"))).select(
        "r.tree", "r.leaf", "branch", "score", "n_turns", "p.node", (F.col("n_turns") - 1 - F.col("up")).alias("place"))
    first = F.min("branch").over(Window.partitionBy("tree", "node")) if top > 1 else F.col("branch")
    chosen = chosen.withColumn("_home", first == F.col("branch"))
    c = chosen.alias("c")
    turns = c.join(n, F.col("n.tree").eqNullSafe(F.col("c.tree")) & (F.col("n.node") == F.col("c.node"))).select(
        "c.tree", "leaf", "branch", "c.score", "n_turns", "place", "_home", "role",
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SPLIT)).alias("_head"), escape(F.col("text")).alias("_body"))
    turns = turns.withColumn("_turn", F.concat("_head", "_body", F.lit(CLOSE)))
    so_far = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("_turn").cast("long")).over(so_far), F.lit(0)) + F.length("_head")
    masked = F.col("_home") & (F.col("role") == "assistant")
    turns = turns.withColumn("_span", F.when(masked, F.struct(
        begin.alias("start"), (begin + F.length("_body")).alias("end"))))
    listed = turns.groupBy("tree", "leaf", "branch", "score", "n_turns").agg(
        F.sort_array(F.collect_list(F.struct("place", "_turn", "_span"))).alias("_all"))
    return listed.select(
        "tree", "leaf", "branch", "score", "n_turns",
        F.array_join(F.transform("_all", lambda x: x["_turn"]), "").alias("formatted"),
        F.filter(F.transform("_all", lambda x: x["_span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), parsed back from a formatted conversation."""
    def turn(written):
        body = F.substring(written, F.lit(len(OPEN) + 1), F.length(written))
        at = F.instr(body, SPLIT)
        return F.struct(unescape(F.substring(body, F.lit(1), at - 1)).alias("role"),
                        unescape(F.substring(body, at + len(SPLIT), F.length(body))).alias("text"))
    written = F.split(formatted, CLOSE, -1)
    return F.transform(F.slice(written, F.lit(1), F.size(written) - 1), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def threads(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees of one branch each.

    Turns are ordered by turn, then role, then text; repeated turns are all kept.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select(F.col("conv_id").alias("tree"), "role", "text",
                                    F.row_number().over(order).cast("long").alias("node"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                           "role", "text", F.lit(0.0).alias("score"))
