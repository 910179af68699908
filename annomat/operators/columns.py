"""Metadata columns: categories, factors, logicals and nullable values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def levels(df: DataFrame, column: str) -> DataFrame:
    """(code, level): the sorted distinct labels with 0-based codes. Only distinct labels are ordered globally."""
    found = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("level")).distinct()
    return found.select((F.row_number().over(Window.orderBy("level")) - 1).cast("int").alias("code"), "level")


def encoded(df: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """Adds code: the label's place in its levels; null for null and for labels that the levels lack."""
    table = known if known is not None else levels(df, column)
    return df.join(table.select(F.col("level").alias("_level"), "code"), F.col(column) == F.col("_level"), "left").drop("_level")


def decoded(df: DataFrame, code: str, known: DataFrame, name: str, base: int = 0) -> DataFrame:
    """Adds the label for a code counted from ``base``; null for null, negative and unknown codes."""
    table = known.select((F.col("code") + base).alias("_code"), F.col("level").alias(name))
    return df.join(table, F.col(code) == F.col("_code"), "left").drop("_code")


def label(code: Column, names: list[str], base: int = 0) -> Column:
    """The label for a code from levels held in the plan."""
    return F.when(code >= base, F.get(F.array(*[F.lit(x) for x in names]), code - base)) if names else F.lit(None).cast("string")


def factor(code: Column) -> Column:
    """Codes counted from 1, null for missing, as factor columns are stored."""
    return (code + 1).cast("int")


def code_width(n_levels: int) -> str:
    """The integer type in which codes of so many levels are stored."""
    return "tinyint" if n_levels <= 127 else "smallint" if n_levels <= 32767 else "int"


def preview(names: list[str], limit: int = 5) -> str:
    """The first levels and how many there are."""
    shown = ", ".join(names[:limit])
    return f"{shown}, ... ({len(names)} levels)" if len(names) > limit else f"{shown} ({len(names)} levels)"
