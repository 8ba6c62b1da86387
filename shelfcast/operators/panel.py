"""Panel operators: star join, pre-release drop, temporal splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.columns import day_index

HORIZON = 28
LOOKBACK_DAYS = 365
SEQ_LEN = 28
PRICE_KEYS = ["store_id", "item_id", "wm_yr_wk"]


def star_join(long: DataFrame, calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """Panel x calendar on ``d`` (inner, JON1), x prices on 3 keys (left, JON2).

    The calendar has one row per day, a bounded dimension, so it is broadcast.
    Prices grow with series x weeks: no hint; AQE broadcasts them only when the
    measured side is small, otherwise it is a sort-merge join on the 3 keys.
    """
    return (long.join(F.broadcast(calendar), "d", "inner")
            .join(prices, PRICE_KEYS, "left"))


def drop_prerelease(joined: DataFrame) -> DataFrame:
    """Drop rows without a price: days before an item was on sale (FLT4).

    Over ``star_join`` Catalyst turns the left join + not-null filter into an
    inner join with the filter pushed to the price side.
    """
    return joined.where(F.col("sell_price").isNotNull())


def prerelease_counts(joined: DataFrame) -> DataFrame:
    """The reported counts of FLT4, one pass: rows before / after / removed."""
    return joined.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count("sell_price").alias("rows_after"),
        (F.count(F.lit(1)) - F.count("sell_price")).alias("rows_removed"),
    )


def train_end_of(calendar: DataFrame, horizon: int = HORIZON) -> Column:
    """Last training day ``T = max(d_int) - horizon`` as a scalar subquery."""
    return calendar.select(F.max(day_index("d")) - F.lit(horizon)).scalar()


def _day(df: DataFrame) -> Column:
    """The stored day number, which a scan can filter on, else the parsed label."""
    return F.col("d_int") if "d_int" in df.columns else day_index("d")


def temporal_split(df: DataFrame, train_end, horizon: int = HORIZON) -> DataFrame:
    """Label rows ``train`` (d <= T) or ``validation`` (T < d <= T+H); drop the rest (FLT1)."""
    t = train_end if isinstance(train_end, Column) else F.lit(train_end)
    d_int = _day(df)
    split = (F.when(d_int <= t, F.lit("train"))
             .when(d_int <= t + horizon, F.lit("validation")))
    return df.withColumn("split", split).where(F.col("split").isNotNull())


def lookback_split(df: DataFrame, train_end, horizon: int = HORIZON,
                   lookback: int = LOOKBACK_DAYS, context: int = SEQ_LEN - 1) -> DataFrame:
    """Short-history splits for sequence models (FLT2).

    train: ``T - lookback + 1 <= d <= T``; validation: ``T + 1 - context <= d
    <= T + H`` (context 27 when the label sits in the window, 28 for a
    next-step label).  A row can be in both; it is emitted once per split.
    """
    t = train_end if isinstance(train_end, Column) else F.lit(train_end)
    d_int = _day(df)
    tr = df.where((d_int >= t + 1 - lookback) & (d_int <= t)).withColumn("split", F.lit("train"))
    va = (df.where((d_int >= t + 1 - context) & (d_int <= t + horizon))
          .withColumn("split", F.lit("validation")))
    return tr.unionByName(va)
