"""Numeric narrowing at the storage edge (DWN1, AGG17).

Floats are stored as 32-bit; integers take the narrowest of int8/16/32 whose
bounds *strictly* contain the observed range (the reference's rule: -128 or
127 do not fit int8).  The ranges come from one aggregate over all integer
columns; only that one-row result reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Signed integer bounds of int8, int16, int32.
INT_BOUNDS = [
    ("tinyint", -128, 127),
    ("smallint", -32768, 32767),
    ("int", -2147483648, 2147483647),
]

_INT_TYPES = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def integer_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType))]


def column_ranges(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per integer column: ``column, min_value, max_value`` (AGG17).

    A single pass computes every min/max; the stack turns the one wide row into
    rows so the result has a fixed schema.
    """
    cols = columns if columns is not None else integer_columns(df)
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("bigint").alias(f"mn_{c}"), F.max(c).cast("bigint").alias(f"mx_{c}")]
    wide = df.agg(*aggs)
    stack_args = ", ".join(f"'{c}', `mn_{c}`, `mx_{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack_args}) as (column, min_value, max_value)")


def narrow_type(lo: int | None, hi: int | None) -> str | None:
    """Narrowest integer type whose bounds strictly contain [lo, hi]."""
    if lo is None or hi is None:
        return None
    for name, tmin, tmax in INT_BOUNDS:
        if lo > tmin and hi < tmax:
            return name
    return None


def narrow_expr_sql(col: str) -> str:
    """SQL CASE choosing the narrow type name from a column's min/max."""
    parts = [f"WHEN min_value > {tmin} AND max_value < {tmax} THEN '{name}'" for name, tmin, tmax in INT_BOUNDS]
    return "CASE " + " ".join(parts) + " ELSE NULL END"


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast floats to ``float`` and integers to their narrowest type.

    Reads the one-row range table, then emits one ``select`` of casts; the
    data itself is never collected.
    """
    cols = integer_columns(df)
    target = {}
    if cols:
        for r in column_ranges(df, cols).collect():  # one row per column
            target[r["column"]] = narrow_type(r["min_value"], r["max_value"])
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            out.append(F.col(f.name).cast("float").alias(f.name))
        elif f.name in target and target[f.name] is not None:
            out.append(F.col(f.name).cast(target[f.name]).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
