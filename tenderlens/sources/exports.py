"""CSV results and annotation sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BOM = "﻿"
_QUOTING = {"quote": '"', "escape": '"', "multiLine": True}


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None,
              mode: str = "error") -> None:
    """Distributed CSV export of selected columns with a header in every part."""
    out = df.select(*columns) if columns else df
    out.write.mode(mode).csv(path, header=True, quote='"', escape='"')


def annotation_sheet(results: DataFrame, top_k: int = 8, text: str = "objet") -> DataFrame:
    """Top results of every query with an empty ``pertinent`` column to fill in.

    ``results`` carries ``requete`` and ``rank``; absent optional columns stay empty.
    """
    def optional(name):
        return F.col(name) if name in results.columns else F.lit("")

    order = Window.partitionBy("requete").orderBy("rank")
    return (
        results.withColumn("rang", F.row_number().over(order))
        .filter(F.col("rang") <= top_k)
        .select("requete", "rang", optional(text).alias("objet"),
                optional("montant").alias("montant"),
                optional("acheteur_region_nom").alias("region"),
                F.lit("").alias("pertinent"))
    )


def write_annotation_sheet(sheet: DataFrame, path: str, mode: str = "error") -> None:
    """CSV for a spreadsheet: the header name starts with a byte-order mark.

    A sheet is for reading by hand (queries x k rows), hence one ordered file.
    """
    first, *rest = sheet.columns
    out = sheet.orderBy("requete", "rang").select(
        F.col(first).alias(_BOM + first), *rest).coalesce(1)
    out.write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="")


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Filled-in sheet, separated by ``,`` or ``;``; refuses unanswered rows."""
    header = spark.read.text(path).first()[0].lstrip(_BOM)
    separator = ";" if header.count(";") > header.count(",") else ","
    df = spark.read.csv(path, sep=separator, header=True, **_QUOTING)
    df = df.select(*[F.col(f"`{c}`").alias(c.strip(_BOM + '"')) for c in df.columns])
    blank = F.col("pertinent").isNull() | (F.trim("pertinent") == "")
    missing = df.filter(blank).count()
    if missing:
        raise ValueError(f"{missing} row(s) not annotated (empty 'pertinent'); fill them first")
    return df.withColumn("pertinent", F.col("pertinent").cast("double").cast("int")).withColumn(
        "rang", F.col("rang").cast("int"))
