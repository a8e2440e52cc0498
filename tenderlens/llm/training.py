"""Labelled documents for the models trained here: all of them, or a bounded sample."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlens.llm.common import fold
from tenderlens.runtime import materialize

SAMPLE_DOCS = 8000  # labelled documents a model is trained on, at most
SAMPLE_BYTES = 40 << 20  # bytes of their whole texts, at most
LARGE = 16  # a text above this part of the bytes is not taken


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int,
                  extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, label and ``extra`` columns of every labelled document outside the fold ``held_out``.

    Of rows that share an id the smallest text is taken.
    """
    known = labels.filter(F.col(label).isNotNull() & (fold("doc_id", parts) != held_out))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra).join(known, "doc_id")
    smallest = F.min(F.struct("text", *extra)).alias("_row")
    return rows.groupBy("doc_id", "label").agg(smallest).select("doc_id", "_row.text", "label", *[f"_row.{c}" for c in extra])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int,
                    extra: tuple[str, ...] = (), max_docs: int = SAMPLE_DOCS,
                    max_bytes: int = SAMPLE_BYTES) -> pa.Table:
    """Text, label and ``extra`` columns of at most ``max_docs`` labelled documents, whole texts.

    Rows whose fold is ``held_out`` and rows without a label are never taken.  The documents
    are drawn by a hash of their id, so the sample does not depend on partitioning; those that
    would exceed ``max_bytes`` together are left out, and so is any single text above a
    sixteenth of it, which would push out all that follow.  Of rows that share an id the
    smallest text is taken.  A sample that lost one of two labels raises an error.
    """
    known = labels.filter(F.col(label).isNotNull() & (fold("doc_id", parts) != held_out))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    drawn = materialize(drawn.withColumnRenamed("doc_id", "_id"), "labelled")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra)
    rows = rows.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))  # max_docs rows
    sized = rows.select("doc_id", F.octet_length("text").alias("_bytes"))
    sized = sized.groupBy("doc_id").agg(F.max("_bytes").alias("_bytes")).filter(F.col("_bytes") <= max_bytes // LARGE)
    running = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fits = sized.withColumn("_upto", F.sum("_bytes").over(running)).filter(F.col("_upto") <= max_bytes)
    rows = rows.join(F.broadcast(fits.select("doc_id")), "doc_id")
    rows = rows.select("doc_id", "text", F.col("_label").alias("label"), *extra)
    first = Window.partitionBy("doc_id").orderBy("text", *extra)
    rows = rows.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    taken = rows.orderBy("doc_id").toArrow()
    there = {r["_label"] for r in drawn.join(docs.select(F.col("doc_id").alias("_id")), "_id").select("_label").distinct().collect()}
    lost = there - set(taken["label"].to_pylist())
    if lost:
        raise ValueError(f"no text of at most {max_bytes // LARGE} bytes is labelled {sorted(lost)}")
    return taken
