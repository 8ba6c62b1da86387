"""Column expressions.  All are built-in Spark functions (codegen, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference's rules.
EVAL_SUFFIX = "_evaluation"
VALID_SUFFIX = "_validation"
# Store id inside a series id, anchored at the id's end (decision B1).
STORE_PATTERN_ANCHORED = r"_([A-Z]{2}_\d+)_(?:evaluation|validation)$"
# The unanchored first-match pattern the reference's report code applies.
STORE_PATTERN_FIRST_MATCH = r"([A-Z]{2}_\d)"
SAFETY_LEAD_DAYS = 3
SAFETY_BUFFER = 1.15


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_index(d="d") -> Column:
    """``d_1914`` -> 1914 (SCL1).  Plain string split, no Python lambda."""
    return F.split(col_(d), "_").getItem(1).cast("int")


def day_label(d_int="d_int") -> Column:
    """1914 -> ``d_1914``."""
    return F.concat(F.lit("d_"), col_(d_int).cast("string"))


def weekday0(date="date") -> Column:
    """Weekday with Monday = 0 (SCL3).  ``dayofweek`` is Sunday = 1, so not it."""
    return F.weekday(col_(date))


def store_from_id(id_col="id", anchored: bool = True) -> Column:
    """Store part of a series id (SCL7).

    ``anchored=True`` reads the store right before the id suffix; the
    first-match form reproduces the reference's report grouping (B1).
    """
    pattern = STORE_PATTERN_ANCHORED if anchored else STORE_PATTERN_FIRST_MATCH
    return F.regexp_extract(col_(id_col), pattern, 1)


def to_validation_id(id_col="id") -> Column:
    """Literal ``_evaluation`` -> ``_validation`` (SCL6)."""
    return F.replace(col_(id_col), F.lit(EVAL_SUFFIX), F.lit(VALID_SUFFIX))


def occurrence(sales="sales") -> Column:
    """0/1 demand occurrence label (SCL14)."""
    return (col_(sales) > 0).cast("int")


def clip0(c) -> Column:
    """Clip at zero (SCL10)."""
    return F.greatest(col_(c), F.lit(0.0))


def safety_stock(forecast, lead_days: int = SAFETY_LEAD_DAYS,
                 buffer: float = SAFETY_BUFFER) -> Column:
    """``int(forecast * lead * buffer)`` truncating toward zero (SCL13)."""
    return (col_(forecast) * F.lit(lead_days) * F.lit(buffer)).cast("int")


def safe_ratio(num, den, default: float | None = None) -> Column:
    """``num / den`` with NULL (or ``default``) for a missing or zero divisor (B10)."""
    r = F.try_divide(col_(num), col_(den))
    return F.coalesce(r, F.lit(default)) if default is not None else r
