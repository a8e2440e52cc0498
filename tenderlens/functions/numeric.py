"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_log(x: Column) -> Column:
    """sign(x) * ln(1 + |x|): compresses both tails and keeps the sign."""
    return F.signum(x) * F.log1p(F.abs(x))


def to_counts(log_value: Column) -> Column:
    """Back from log1p space to a count, floored at zero."""
    return F.greatest(F.expm1(log_value), F.lit(0.0))


def clean_double(x: Column) -> Column:
    """Double with NaN turned into null (NaN sorts and compares differently)."""
    value = x.cast("double")
    return F.when(~F.isnan(value), value)


def unit_hash(seed: int | str, *keys: str) -> Column:
    """md5 hex of ``key:key:seed``; the same in any engine and on any partitioning."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))
