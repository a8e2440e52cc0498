"""Vectors kept as a Parquet table, one folder per commit and in it one per model.

A commit writes a folder of its own, so a writer that is lost leaves nothing that is read, one
that is repeated under its name replaces what it wrote, and of two writers that encode the
same texts the later one counts.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlens.runtime import materialize
from tenderlens.schema import VECTOR_SCHEMA

Encoder = Callable[[list[str]], "list[list[float]]"]
ENCODE_ROWS = 256  # texts that an encoder is given at once
_STORED = T.StructType([*VECTOR_SCHEMA.fields, T.StructField("commit", T.StringType())])


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The newest vector of every uid and model; a store that does not exist yet is empty."""
    try:
        rows = spark.read.schema(_STORED).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], VECTOR_SCHEMA)
        raise
    return rows.groupBy("uid", "model").agg(F.max_by("vec", "commit").alias("vec"))


def append_vectors(vectors: DataFrame, path: str, commit: str | None = None) -> None:
    """Write one commit.  Commits count in the order of their names, by default the time they began;
    a name that exists already is replaced."""
    commit = commit or f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    vectors.select("uid", "vec", "model").write.mode("overwrite").partitionBy("model").parquet(f"{path}/commit={commit}")


def missing_uids(uids: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Rows of ``uids`` without a stored vector of this model (anti join)."""
    stored = vectors.filter(F.col("model") == model).select("uid")
    return uids.join(stored, "uid", "left_anti")


def encode(texts: DataFrame, model: str, encoder: Encoder, text: str = "objet") -> DataFrame:
    """Run a batch encoder over at most ``ENCODE_ROWS`` texts at a time; vectors come back at unit length."""
    names = VECTOR_SCHEMA.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, ENCODE_ROWS):
                batch = whole.slice(low, ENCODE_ROWS)
                vectors = np.asarray(encoder(batch.column("_text").to_pylist()), dtype="float64")
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = (vectors / np.where(norms == 0, 1.0, norms)).astype("float32")
                at = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
                columns = {"uid": batch.column("uid"), "model": pa.array([model] * len(vectors), pa.string()),
                           "vec": pa.ListArray.from_arrays(pa.array(at), pa.array(vectors.ravel()))}
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    source = texts.select(F.col("uid").cast("string").alias("uid"),
                          F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return source.mapInArrow(run, VECTOR_SCHEMA)


def upsert_vectors(texts: DataFrame, path: str, model: str, encoder: Encoder,
                   text: str = "objet") -> DataFrame:
    """Encode only texts the store lacks, append them, return the store.

    Of several texts of one uid the smallest is encoded, whatever the partitioning.
    """
    spark = texts.sparkSession
    todo = missing_uids(
        texts.groupBy(F.col("uid").cast("string").alias("uid")).agg(F.min(text).alias(text)),
        read_vectors(spark, path), model)
    encoded = materialize(encode(todo, model, encoder, text), "encoded")
    if not encoded.isEmpty():
        append_vectors(encoded, path)
    return read_vectors(spark, path)
