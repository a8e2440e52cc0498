"""Exact deduplication that stays even when one text makes up a third of all rows.

Texts are combined three times, each time compared in full: inside the task that reads
them, then by (digest, salt), then by digest alone.  After the first step a text has at
most one row per task and after the second one row per salt, so no task ever meets the
copies of a frequent text themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.runtime import materialize

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _combine(docs: DataFrame, text: str, digest, salts: int, first: dict[str, Column],
             again: dict[str, Column]) -> DataFrame:
    """One row per distinct text; ``first`` and ``again`` are the aggregates of rows and of winners.

    Grouping by the text itself makes Spark combine inside each reading task before the
    first shuffle and compare whole texts, not digests, at every step.
    """
    keyed = docs.withColumns({"_text": F.coalesce(F.col(text), F.lit(""))}).withColumns(
        {"_digest": digest(F.col("_text")), "_salt": F.spark_partition_id() % salts})
    salted = keyed.groupBy("_digest", "_salt", "_text").agg(*[c.alias(n) for n, c in first.items()])
    return salted.groupBy("_digest", "_text").agg(*[c.alias(n) for n, c in again.items()])


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=sha256,
                     salts: int = SALTS) -> DataFrame:
    """One row per input row: its id, digest, keep_id, group_size and kept.

    A null text counts as empty.  The largest id of a text stays; a null id is smaller than
    every other.  Of repeated rows (same id, same text) exactly one is kept.  Texts whose
    digests collide are told apart by content.  An empty table gives an empty result.
    """
    won = _combine(
        docs.select(doc_id, text), text, digest, salts,
        {"keep_id": F.max(doc_id), "group_size": F.count(F.lit(1))},
        {"keep_id": F.max("keep_id"), "group_size": F.sum("group_size")})
    won = materialize(won.select("_digest", F.xxhash64("_text").alias("_check"), "keep_id", "group_size"), "dedup-won")
    shared = won.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1")
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_digest", digest(F.col("_text")))
    counted = rows.groupBy("_id", "_digest").agg(F.count(F.lit(1)).alias("_rows"))
    if shared.isEmpty():  # every digest stands for one text: the narrow join is exact
        found = counted.join(won.drop("_check"), "_digest")
    else:
        found = _by_content(docs, doc_id, text, digest, salts)
    copies = found.select("*", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_copy"))
    return copies.select(
        F.col("_id").alias(doc_id), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        F.lower(F.hex("_digest")).alias("digest"))


def _by_content(docs: DataFrame, doc_id: str, text: str, digest, salts: int) -> DataFrame:
    """Membership by whole texts, for digests that several texts share."""
    won = _combine(
        docs.select(doc_id, text), text, digest, salts,
        {"keep_id": F.max(doc_id), "group_size": F.count(F.lit(1))},
        {"keep_id": F.max("keep_id"), "group_size": F.sum("group_size")})
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.groupBy("_id", "_text").agg(F.count(F.lit(1)).alias("_rows"))
    return rows.join(won, "_text").drop("_text")


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=sha256,
              salts: int = SALTS) -> DataFrame:
    """The whole row of the largest id for every distinct text, with the input's columns.

    Nulls, ties and repeated rows as in ``duplicate_groups``; one row per text always.
    """
    rest = [c for c in docs.columns if c != text]
    plain = [c for c, kind in docs.dtypes if c != text and "map<" not in kind]
    row = F.struct(F.col(text).isNull().alias("_null"), *rest)
    order = F.struct(F.col(doc_id), F.xxhash64(*plain))
    packed = docs.select(row.alias("_row"), order.alias("_order"), text)
    best = _combine(packed, text, digest, salts,
                    {"_row": F.max_by("_row", "_order"), "_order": F.max("_order")},
                    {"_row": F.max_by("_row", "_order")})
    back = {c: F.col("_row").getField(c) for c in rest}
    back[text] = F.when(~F.col("_row").getField("_null"), F.col("_text"))
    return best.select(*[back[c].alias(c) for c in docs.columns])
