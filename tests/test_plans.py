"""Plans of the series windows and of ranges; released tables are built anew."""

import pytest
from pyspark.sql import functions as F

from shelfcast.functions.narrowing import column_ranges
from shelfcast.plans import queries as Q
from shelfcast.plans.context import ctx
from shelfcast.session import materialize, materialize_by_key, release_tables, small_side
from shelfcast.sources.tables import folder_of, footer_scan

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["price_momentum", "price_max_ratio", "sales_lags", "rolling_stats", "rmsse_denominator"])
def test_series_windows_need_no_exchange(spark, name):
    text = plan(Q.queries()[name](spark, SF))
    assert "Window" in text and "Exchange" not in text


def test_ranges_come_from_the_footers(spark):
    df = spark.range(5000).select((F.col("id") - 7).cast("int").alias("a"), (F.col("id") * 3).alias("b"), (F.col("id") % 2).alias("k"),
                                  F.when(F.col("id") > 9, F.col("id")).alias("c"))
    written = materialize(df, "footer", ["k"])
    ranges = column_ranges(footer_scan(spark, folder_of(written)), ["a", "b", "c"])
    text = plan(ranges)
    assert "PushedAggregation: [MIN(a), MAX(a), MIN(b), MAX(b), MIN(c), MAX(c)]" in text
    assert sorted(tuple(r) for r in ranges.collect()) == [("a", -7, 4992), ("b", 0, 14997), ("c", 10, 4999)]
    assert "PushedAggregation: [MIN(sales)" in plan(Q.queries()["column_ranges"](spark, SF)).replace("MIN(wm", "MIN(sales), MIN(wm")
    assert "PushedAggregation" not in plan(column_ranges(written, ["a"]))   # the default reader is left as it was


def test_bucketed_tables_hold_the_same_rows(spark):
    df = spark.range(300).select(F.concat(F.lit("k"), F.col("id") % 7).alias("id"), (F.col("id") * 11 % 300).alias("d_int"))
    by_key = materialize_by_key(df, "bucketed", "id", "d_int")
    assert sorted(map(tuple, by_key.collect())) == sorted(map(tuple, df.collect()))
    assert "Exchange" not in plan(by_key.groupBy("id").agg(F.max("d_int")))
    assert materialize_by_key(df.limit(0), "bucketed-none", "id", "d_int").count() == 0


def test_small_sides_are_small_in_bytes(spark):
    few = spark.range(50).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small_side(few, "few"))
    assert not hinted(small_side(few, "few", most_bytes=40_000))
    assert not hinted(small_side(few, "few", rows=49))


def test_released_tables_are_built_anew(spark):
    one = ctx(spark, SF).series.count()
    assert release_tables(spark) > 0
    assert ctx(spark, SF).series.count() == one
    assert Q.queries()["price_momentum"](spark, SF).count() > 0
