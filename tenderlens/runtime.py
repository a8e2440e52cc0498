"""Lineage cuts and small-side joins.

``materialize`` writes an intermediate result to the shared folder the cluster
names in ``spark.checkpoint.dir`` and reads it back.  The files survive the loss
of any executor, later stages read only the columns they need, and Catalyst sees
the true size, so it broadcasts the table only when it really is small and
otherwise falls back to a shuffled join by itself.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIR_KEY = "spark.checkpoint.dir"
_RELEASE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str | None:
    """The session's shared folder; a temporary one only for unset local runs."""
    configured = spark.conf.get(_DIR_KEY, None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set(_DIR_KEY, folder)
        return folder
    return None


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    base = shared_dir(spark)
    if base is None:
        raise RuntimeError(f"set {_DIR_KEY} to a folder that driver and executors share")
    return f"{base}/tenderlens/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of the actions inside go when these end, not when the driver collects garbage."""
    before = spark.conf.get(_RELEASE_KEY, None)
    spark.conf.set(_RELEASE_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE_KEY)
        else:
            spark.conf.set(_RELEASE_KEY, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Compute ``df`` once, cut its lineage, and return the stored copy."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    with released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(stored: DataFrame) -> None:
    """Delete the files of a ``materialize`` result that nothing reads any more."""
    files = stored.inputFiles()
    if files:
        jvm = stored.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
        folder.getFileSystem(stored.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the columns of ``stats`` (one row per ``by`` key) to every row of ``df``.

    Without keys ``stats`` is a single row and becomes a scalar subquery: no join.
    """
    by = list(by)
    if by:
        return df.join(stats, by, "left")
    row = stats.select(F.struct(*stats.columns).alias("_row")).scalar()
    return df.select("*", *[row.getField(c).alias(c) for c in stats.columns])
