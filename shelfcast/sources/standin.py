"""Stand-in retail star schema over the driver's TPC-H-ish tables.

The reference reads three inputs: wide daily sales per series, a calendar and
weekly prices.  This module only gives rows in those schemas (see
FIXTURES.md §2); every analytic step runs later, in ``shelfcast.operators``.

- series: ``item_id`` from the part brand, ``store_id`` from the supplier's
  region; ``sales`` = summed quantity per (item, store, ship date)
- calendar: one row per day from the first to the last ship date
- prices: mean unit price per (store, item, week), carried over empty weeks;
  weeks before a series' first sale are absent

Everything stays lazy except the two date bounds, which are read once as
scalars and enter the plans as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.functions.columns import day_label
from shelfcast.operators.reshape import dense_grid, pivot_days
from shelfcast.sources.tables import read_table, table_stamp

ID_COLS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
SERIES_KEYS = ["item_id", "store_id"]

# Fixed calendar events by month-day: (MM-DD, event_name_1, event_type_1).
EVENTS = [
    ("01-01", "NewYear", "National"),
    ("02-14", "ValentinesDay", "Cultural"),
    ("07-04", "IndependenceDay", "National"),
    ("10-31", "Halloween", "Cultural"),
    ("12-25", "Christmas", "National"),
]
SNAP_LAST_DAY = 10  # snap flags are set on days 1..10 of each month


def _series_attrs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Part -> item/dept/cat and supplier -> store/state lookup tables."""
    brand_no = F.regexp_extract("p_brand", r"#(\d+)$", 1).cast("int")
    items = read_table(spark, sf_dir, "part", ["p_partkey", "p_brand"]).select(
        "p_partkey",
        F.concat(F.lit("BRAND_"), brand_no.cast("string")).alias("item_id"),
        F.concat(F.lit("DEPT_"), (brand_no % 6).cast("string")).alias("dept_id"),
        F.concat(F.lit("CAT_"), (brand_no % 3).cast("string")).alias("cat_id"),
    )
    # nation (25 rows) and region (5 rows) are fixed-size TPC-H dimensions.
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    geo = F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey)
                      .select("n_nationkey", F.upper(F.substring("r_name", 1, 2)).alias("state_id")))
    stores = (read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
              .join(geo, F.col("s_nationkey") == F.col("n_nationkey"))
              .select("s_suppkey", "state_id",
                      F.concat(F.col("state_id"), F.lit("_1")).alias("store_id")))
    return items, stores


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items tagged with series attributes and a ship date."""
    items, stores = _series_attrs(spark, sf_dir)
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"])
    return (li.join(items, li.l_partkey == items.p_partkey)
              .join(stores, li.l_suppkey == stores.s_suppkey)
              .select("item_id", "dept_id", "cat_id", "store_id", "state_id",
                      F.to_date("l_shipdate").alias("date"),
                      F.col("l_quantity").alias("qty"),
                      F.col("l_extendedprice").alias("ext_price")))


_BOUNDS: dict = {}


def date_range(spark: SparkSession, sf_dir: str):
    """(first, last) ship date as Python dates, read once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, table_stamp(spark, sf_dir, "lineitem"))
    if key not in _BOUNDS:
        ship = read_table(spark, sf_dir, "lineitem", ["l_shipdate"])
        row = ship.agg(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi")).first()
        as_date = [v.date() if hasattr(v, "date") else v for v in (row["lo"], row["hi"])]
        _BOUNDS[key] = tuple(as_date)
    return _BOUNDS[key]


def n_days(spark: SparkSession, sf_dir: str) -> int:
    lo, hi = date_range(spark, sf_dir)
    return (hi - lo).days + 1


def date_bounds(spark: SparkSession, sf_dir: str):
    """(first, last) ship date as two literal columns.

    One aggregate over a scan of a single column with partial minima and
    maxima; only the two dates reach the driver.  Using literals keeps every
    downstream plan small instead of re-embedding a scalar subquery wherever a
    bound is used.
    """
    lo, hi = date_range(spark, sf_dir)
    return F.lit(lo), F.lit(hi)


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day: ``date, wm_yr_wk, d, event_*, snap_*``.

    Built from ``sequence(first, last)``, never from distinct sale dates (days
    without a sale must exist).  Size = number of days, so it is a bounded
    dimension.
    """
    lo, hi = date_bounds(spark, sf_dir)
    days = spark.range(1).select(F.posexplode(F.sequence(lo, hi)).alias("pos", "date"))
    md = F.date_format("date", "MM-dd")
    name = F.lit(None).cast("string")
    kind = F.lit(None).cast("string")
    for mmdd, ev_name, ev_type in reversed(EVENTS):
        name = F.when(md == mmdd, F.lit(ev_name)).otherwise(name)
        kind = F.when(md == mmdd, F.lit(ev_type)).otherwise(kind)
    snap = (F.dayofmonth("date") <= SNAP_LAST_DAY).cast("int")
    d_int = F.col("pos") + 1
    return days.select(
        "date",
        F.floor((d_int - 1) / 7).cast("int").alias("wm_yr_wk"),
        day_label(d_int).alias("d"),
        name.alias("event_name_1"), kind.alias("event_type_1"),
        F.lit(None).cast("string").alias("event_name_2"),
        F.lit(None).cast("string").alias("event_type_2"),
        snap.alias("snap_CA"), snap.alias("snap_TX"), snap.alias("snap_WI"),
    )


SERIES_ATTRS = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]


def daily_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (series, ship date) with a sale: ``sales`` (summed quantity),
    ``ratio_sum`` (sum of unit prices of the lines) and ``n_lines`` (lines that
    have a unit price; a line without quantity has none).

    The single pass over the raw line items: sales and weekly prices both
    derive from it.  Partial (map-side) aggregation runs before the shuffle,
    so a brand/region holding a third of all lines still shuffles one row per
    (series, day, task).
    """
    return (sales_lines(spark, sf_dir)
            .groupBy(*SERIES_ATTRS, "date")
            .agg(F.sum("qty").cast("int").alias("sales"),
                 F.sum(F.try_divide("ext_price", "qty")).alias("ratio_sum"),
                 F.count(F.try_divide("ext_price", "qty")).alias("n_lines")))


def sparse_sales(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """Non-zero daily sales per series: ``item_id..state_id, date, sales``."""
    daily = daily if daily is not None else daily_lines(spark, sf_dir)
    return daily.select(*SERIES_ATTRS, "date", "sales")


def _with_series_id(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.concat_ws("_", "item_id", "store_id", F.lit("evaluation")))


def sales_long(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """Long panel ``id, item_id, dept_id, cat_id, store_id, state_id, d, sales``.

    Dense: every series has a row for every calendar day, 0 when nothing sold
    (what melting the reference's wide file yields).
    """
    lo, hi = date_bounds(spark, sf_dir)
    grid = dense_grid(sparse_sales(spark, sf_dir, daily),
                      ["item_id", "dept_id", "cat_id", "store_id", "state_id"],
                      "date", lo, hi, value_cols=["sales"])
    d_int = F.datediff("date", lo) + 1
    return _with_series_id(grid).select(*ID_COLS, day_label(d_int).alias("d"), "sales")


def sales_wide(spark: SparkSession, sf_dir: str, long: DataFrame | None = None) -> DataFrame:
    """Wide sales: one row per series, one ``d_N`` column per day.

    The trailing repartition (one row per series) is a plan barrier: without
    it Catalyst folds a later melt's thousands of struct fields into this
    projection, producing an expression too large to compile.
    """
    long = long if long is not None else sales_long(spark, sf_dir)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pivot_days(long, ID_COLS, n_days(spark, sf_dir)).repartition(n, "id")


def sell_prices(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """Weekly prices ``store_id, item_id, wm_yr_wk, sell_price``.

    Mean unit price of the lines per (store, item, week), from the daily
    sums (sum of ratios / number of lines); empty weeks carry the last price
    forward; weeks before a series' first sale stay absent.  The carry-forward
    window is per series and bounded by the number of weeks.
    """
    lo, hi = date_bounds(spark, sf_dir)
    wk = F.floor(F.datediff("date", lo) / 7).cast("int")
    daily = daily if daily is not None else daily_lines(spark, sf_dir)
    weekly = (daily.groupBy("store_id", "item_id", wk.alias("wm_yr_wk"))
              .agg((F.sum("ratio_sum") / F.sum("n_lines")).alias("unit_price")))
    last_week = F.floor(F.datediff(hi, lo) / 7).cast("int")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    weeks = (weekly.groupBy("store_id", "item_id").agg(F.min("wm_yr_wk").alias("first_wk"))
             .repartition(n, "store_id", "item_id")
             .select("store_id", "item_id",
                     F.explode(F.sequence("first_wk", last_week)).alias("wm_yr_wk")))
    w = (Window.partitionBy("store_id", "item_id").orderBy("wm_yr_wk")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (weeks.join(weekly, ["store_id", "item_id", "wm_yr_wk"], "left")
            .select("store_id", "item_id", "wm_yr_wk",
                    F.last("unit_price", ignorenulls=True).over(w).alias("sell_price")))
