"""Casts between matrix types: truncating, saturating, NaN to zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matrix dtype name -> Spark type. Unsigned 32-bit values are held as longs; the name is kept in the manifest.
DTYPES = {"f32": "float", "f64": "double", "i32": "int", "u32": "bigint"}
_BOUNDS = {"i32": (-2147483648, 2147483647), "u32": (0, 4294967295)}


def spark_type(dtype: str) -> str:
    if dtype not in DTYPES:
        raise ValueError(f"unknown dtype {dtype!r}; expected one of {', '.join(DTYPES)}")
    return DTYPES[dtype]


def to_dtype(value: Column, dtype: str) -> Column:
    """``value`` in a matrix dtype. Integers truncate toward zero and saturate, NaN becomes 0; null stays null."""
    if dtype not in _BOUNDS:
        return value.cast(spark_type(dtype))
    low, high = _BOUNDS[dtype]
    wide = value.cast("double")
    # least and greatest would take a bound for a null.
    return F.when(F.isnan(wide), 0.0).when(wide > high, float(high)).when(wide < low, float(low)).otherwise(wide).cast(spark_type(dtype))


def rounded(value: Column) -> Column:
    """Numbers rounded to longs, halves away from zero: what ``round`` gives without its detour over decimals."""
    whole = value.cast("long")
    rest = value - whole
    return whole + F.when((rest >= 0.5) & (rest < 1), 1).when(rest <= -0.5, -1).otherwise(0)


def nan_for_null(value: Column) -> Column:
    """Nullable numbers as doubles with NaN for null."""
    return F.coalesce(value.cast("double"), F.lit(float("nan")))


def false_for_null(value: Column) -> Column:
    return F.coalesce(value.cast("boolean"), F.lit(False))


def logical(value: Column) -> Column:
    """A three-valued logical stored as 0, 1 or 2 (missing): true only for 1."""
    return F.coalesce(value == 1, F.lit(False))


def widened(value: Column, kind: str) -> Column:
    """Metadata numbers as the engine holds them: every integer as int (saturating), every float as double."""
    return to_dtype(value, "i32") if kind in ("tinyint", "smallint", "int", "bigint") else value.cast("double")
