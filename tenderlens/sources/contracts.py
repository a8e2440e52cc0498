"""Contract table scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.schema import CORE_COLUMNS, CURRENT_FLAG, DATE_COLUMNS


def coerce_dates(df: DataFrame, columns: Sequence[str] = tuple(DATE_COLUMNS),
                 min_valid: str | None = None) -> DataFrame:
    """Turn date columns into timestamps; what cannot be read becomes null.

    ``min_valid`` also nulls earlier dates; by default they stay and get flagged.
    """
    present = [c for c in columns if c in df.columns]
    out = {}
    for name in present:
        kind = dict(df.dtypes)[name]
        value = F.try_to_timestamp(F.col(name)) if kind == "string" else F.col(name).cast("timestamp")
        if min_valid is not None:
            value = F.when(value >= F.lit(min_valid).cast("timestamp"), value)
        out[name] = value
    return df.withColumns(out) if out else df


def prune(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Projection by name; the default list skips columns a table does not have."""
    if columns is None:
        return df.select(*[c for c in CORE_COLUMNS if c in df.columns])
    return df.select(*columns)


def load_raw(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
             min_valid: str | None = None) -> DataFrame:
    """Pruned Parquet scan with coerced dates and no other cleaning."""
    return coerce_dates(prune(spark.read.parquet(path), columns), min_valid=min_valid)


def current_only(df: DataFrame, columns: Sequence[str] | None = None,
                 flag: str = CURRENT_FLAG) -> DataFrame:
    """Current versions only.  The filter runs before the projection, so it applies
    (and reaches the Parquet scan) even when the flag itself is not asked for."""
    kept = df.filter(F.col(flag)) if flag in df.columns else df
    return prune(kept, columns)


def load_current_only(spark: SparkSession, path: str,
                      columns: Sequence[str] | None = None) -> DataFrame:
    return coerce_dates(current_only(spark.read.parquet(path), columns))


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))
