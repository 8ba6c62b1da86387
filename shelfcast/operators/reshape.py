"""Reshape operators: unpivot (melt), day pivot, horizon pivot, dense grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.columns import day_index


def day_columns(df: DataFrame, prefix: str = "d_") -> list[str]:
    """Columns selected by name rule: every column starting with ``prefix`` (PRJ2)."""
    return [c for c in df.columns if c.startswith(prefix)]


def unpivot_wide(wide: DataFrame, id_cols: list[str], prefix: str = "d_",
                 var_name: str = "d", value_name: str = "sales") -> DataFrame:
    """Melt wide day columns into ``(id_cols..., d, sales)`` rows (RSH1).

    A narrow transformation: no shuffle, each wide row becomes one row per day
    column in the same task.  Written as ``inline(array(struct(name, value)))``
    rather than ``DataFrame.unpivot``: with ~2,000 day columns the latter's
    Expand node outgrows code generation and runs ~15x slower.
    """
    cols = day_columns(wide, prefix)
    # One SQL string instead of thousands of Column objects: each Python-side
    # Column is a round trip to the JVM, which dominates with ~2,000 columns.
    cells = ", ".join(f"named_struct('{var_name}', '{c}', '{value_name}', `{c}`)" for c in cols)
    return wide.selectExpr(*[f"`{c}`" for c in id_cols], f"inline(array({cells}))")


def pivot_days(long: DataFrame, id_cols: list[str], n_days: int,
               day_col: str = "d", value_col: str = "sales") -> DataFrame:
    """Dense long panel -> wide with columns ``d_1..d_n`` in day order.

    One aggregate gathers each series' values sorted by day (one entry per
    day, so bounded by the calendar); a projection reads column ``d_i`` at
    array position ``i``.  Positional reads are exact only on a dense panel,
    so a series without exactly days ``1..n`` raises instead of shifting
    values.  Much cheaper than ``pivot`` or map lookups with thousands of
    day values (a map lookup scans its keys).
    """
    cell = F.struct(day_index(day_col).alias("i"), F.col(value_col).alias("v"))
    arr = F.sort_array(F.collect_list(cell))
    per_series = long.groupBy(*id_cols).agg(arr.alias("__cells"))
    a = F.col("__cells")
    dense = (F.size(a) == n_days) & (a.getItem(0)["i"] == 1) & (a.getItem(n_days - 1)["i"] == n_days)
    checked = per_series.withColumn(
        "__cells", F.when(dense, a).otherwise(F.raise_error(F.lit("pivot_days needs one row per day 1..n"))))
    return checked.selectExpr(*[f"`{c}`" for c in id_cols],
                              *[f"__cells[{i - 1}].v AS d_{i}" for i in range(1, n_days + 1)])


def column_totals(wide: DataFrame, prefix: str = "d_",
                  var_name: str = "d", value_name: str = "sales") -> DataFrame:
    """Wide column sums as ``(d, sales)`` rows (RSH3 + AGG1).

    Every row gives its values with their positions; partial sums per task,
    one row per day after the shuffle, and only these rows get their labels.
    (A single wide ``agg`` of every column would pull all partial sums into
    one task, with a 2,000-column codegen stage.)
    """
    cols = day_columns(wide, prefix)
    cells = wide.selectExpr(f"posexplode(array({', '.join(f'`{c}`' for c in cols)})) AS (pos, v)")
    totals = cells.groupBy("pos").agg(F.sum("v").cast("bigint").alias(value_name))
    names = ", ".join(f"'{c}'" for c in cols)
    return totals.selectExpr(f"element_at(array({names}), pos + 1) AS {var_name}", value_name)


def dense_grid(sparse: DataFrame, series_cols: list[str], day_col: str,
               lo: Column | None = None, hi: Column | None = None,
               value_cols: list[str] | None = None, fill=0,
               num_partitions: int | None = None) -> DataFrame:
    """Series x day grid with missing cells filled (RSH4), without a cross join.

    Each distinct series explodes ``sequence(lo, hi)`` of its own; the series
    list is hash-partitioned first so the generated rows spread over
    ``num_partitions`` tasks (a series yields exactly one row per day, so no
    task holds more than its share).  The sparse values join back on
    ``(series, day)``, a key that is unique on both sides, so no key is hot.
    ``lo``/``hi`` default to the sparse table's own day bounds as scalar
    subqueries; each re-reads ``sparse``, so pass known bounds (e.g. the
    calendar's) when ``sparse`` is expensive.
    """
    value_cols = value_cols or [c for c in sparse.columns if c not in series_cols + [day_col]]
    spark = sparse.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if lo is None:
        lo = sparse.select(F.min(day_col)).scalar()
    if hi is None:
        hi = sparse.select(F.max(day_col)).scalar()
    series = sparse.select(*series_cols).distinct().repartition(n, *series_cols)
    grid = series.select(*series_cols, F.explode(F.sequence(lo, hi)).alias(day_col))
    types = dict(sparse.dtypes)
    filled = [F.coalesce(F.col(c), F.lit(fill)).cast(types[c]).alias(c) for c in value_cols]
    return (grid.join(sparse, series_cols + [day_col], "left")
            .select(*series_cols, day_col, *filled))


def horizon_pivot(preds: DataFrame, train_end, horizon: int = 28,
                  value_col: str = "simple_avg_pred", key: str = "id",
                  day_col: str = "d") -> DataFrame:
    """Validation rows to one row per series with columns ``F1..F{horizon}`` (RSH2).

    ``F{d - train_end}``; a duplicate ``(id, F)`` pair raises, as pandas
    ``pivot`` does.  The check is an aggregate in the same plan, not a
    separate action.
    """
    t = train_end if isinstance(train_end, Column) else F.lit(train_end)
    d_int = day_index(day_col)
    steps = (preds.where((d_int > t) & (d_int <= t + horizon))
             .select(key, F.concat(F.lit("F"), (d_int - t).cast("string")).alias("F_day"),
                     F.col(value_col).alias("v")))
    checked = (steps.groupBy(key, "F_day")
               .agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
               .select(key, "F_day",
                       F.when(F.col("n") > 1,
                              F.raise_error(F.lit("duplicate (id, F) pair in horizon pivot")))
                       .otherwise(F.col("v")).cast("double").alias("v")))
    f_cols = [f"F{i}" for i in range(1, horizon + 1)]
    return checked.groupBy(key).pivot("F_day", f_cols).agg(F.first("v")).select(key, *f_cols)
