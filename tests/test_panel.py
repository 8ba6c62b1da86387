import datetime as dt

from pyspark.sql import functions as F

from shelfcast.operators import panel as P


def _inputs(spark, n_days=28):
    cal = spark.createDataFrame(
        [(dt.date(2020, 1, 1) + dt.timedelta(days=i), (i // 7), f"d_{i + 1}") for i in range(n_days)],
        "date date, wm_yr_wk int, d string")
    long = spark.createDataFrame([("x_S_1_evaluation", "x", "S_1", f"d_{i + 1}", i % 3) for i in range(n_days)],
                                 "id string, item_id string, store_id string, d string, sales int")
    # Price starts in week 2 (0-based), week 3 present: weeks 0-1 are pre-release.
    prices = spark.createDataFrame([("S_1", "x", 2, 1.5), ("S_1", "x", 3, 2.0)],
                                   "store_id string, item_id string, wm_yr_wk int, sell_price double")
    return long, cal, prices


def test_star_join_and_prerelease_drop(spark):
    long, cal, prices = _inputs(spark)
    j = P.star_join(long, cal, prices)
    assert j.count() == 28
    c = P.prerelease_counts(j).first()
    assert (c["rows_before"], c["rows_after"], c["rows_removed"]) == (28, 14, 14)
    kept = P.drop_prerelease(j)
    assert kept.agg(F.min("wm_yr_wk")).first()[0] == 2


def test_temporal_and_lookback_split_bounds(spark):
    long, cal, prices = _inputs(spark)
    sp = {r["d"]: r["split"] for r in P.temporal_split(long, train_end=20, horizon=5).collect()}
    assert sp["d_20"] == "train" and sp["d_21"] == "validation" and sp["d_25"] == "validation"
    assert "d_26" not in sp
    lb = P.lookback_split(long, train_end=20, horizon=5, lookback=10, context=3).collect()
    tr = sorted(int(r["d"][2:]) for r in lb if r["split"] == "train")
    va = sorted(int(r["d"][2:]) for r in lb if r["split"] == "validation")
    assert tr == list(range(11, 21)) and va == list(range(18, 26))


def test_train_end_from_calendar(spark):
    _, cal, _ = _inputs(spark)
    assert cal.select(P.train_end_of(cal, 7)).first()[0] == 21
