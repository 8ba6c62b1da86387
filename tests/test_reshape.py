import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import reshape as R
from tests.conftest import rows


def _wide(spark, n_series=3, n_days=10):
    data = []
    for s in range(n_series):
        data.append((f"S{s}_evaluation", *[(s + 1) * d % 4 for d in range(1, n_days + 1)]))
    cols = ["id"] + [f"d_{d}" for d in range(1, n_days + 1)]
    return spark.createDataFrame(data, cols)


def test_day_columns_by_prefix(spark):
    w = _wide(spark).withColumn("dx", F.lit(1))
    assert R.day_columns(w) == [f"d_{d}" for d in range(1, 11)]


def test_unpivot_then_pivot_is_identity(spark):
    wide = _wide(spark)
    long = R.unpivot_wide(wide, ["id"])
    assert long.count() == 30
    back = R.pivot_days(long, ["id"], 10)
    assert rows(back) == rows(wide.select(*back.columns))


def test_pivot_days_rejects_gaps(spark):
    long = R.unpivot_wide(_wide(spark), ["id"]).where("d != 'd_4'")
    with pytest.raises(Exception):
        R.pivot_days(long, ["id"], 10).collect()


def test_column_totals(spark):
    tot = {r["d"]: r["sales"] for r in R.column_totals(_wide(spark)).collect()}
    assert tot["d_1"] == 1 + 2 + 3
    assert len(tot) == 10


def test_dense_grid_fills_zero_and_every_day(spark):
    sparse = spark.createDataFrame(
        [("a", dt.date(2020, 1, 1), 3), ("a", dt.date(2020, 1, 4), 1), ("b", dt.date(2020, 1, 2), 5)],
        "s string, date date, sales int")
    g = R.dense_grid(sparse, ["s"], "date")
    assert g.count() == 8  # 2 series x 4 days
    got = {(r["s"], r["date"].day): r["sales"] for r in g.collect()}
    assert got[("a", 2)] == 0 and got[("a", 4)] == 1 and got[("b", 1)] == 0 and got[("b", 2)] == 5
    assert dict(g.dtypes)["sales"] == "int"


def test_horizon_pivot_orders_f_columns_and_rejects_duplicates(spark):
    preds = spark.createDataFrame(
        [("x", f"d_{d}", float(d)) for d in range(1, 8)], "id string, d string, simple_avg_pred double")
    piv = R.horizon_pivot(preds, train_end=3, horizon=4)
    assert piv.columns == ["id", "F1", "F2", "F3", "F4"]
    r = piv.collect()[0]
    assert (r["F1"], r["F4"]) == (4.0, 7.0)
    dup = preds.unionByName(preds.where("d = 'd_5'"))
    with pytest.raises(Exception):
        R.horizon_pivot(dup, train_end=3, horizon=4).collect()
