import math

import numpy as np
import pytest

from shelfcast.operators import metrics as M


def _long(spark, series):
    data = [(sid, f"d_{i + 1}", int(v)) for sid, vals in series.items() for i, v in enumerate(vals)]
    return spark.createDataFrame(data, "id string, d string, sales int")


def _numpy_denominator(vals):
    vals = np.asarray(vals)
    nz = np.where(vals > 0)[0]
    if len(nz) == 0:
        return 1.0
    act = vals[nz[0]:]
    if len(act) < 2:
        return 1.0
    m = np.mean(np.diff(act) ** 2)
    return m if m > 0 else 1.0


def test_rmsse_denominator_fallbacks(spark):
    series = {
        "zeros": [0, 0, 0, 0],
        "one_active_last": [0, 0, 0, 2],
        "flat": [0, 3, 3, 3],
        "normal": [0, 0, 1, 4, 0, 2],
    }
    den = {r["id"]: r["denominator"] for r in M.rmsse_denominator(_long(spark, series)).collect()}
    for sid, vals in series.items():
        assert den[sid] == pytest.approx(_numpy_denominator(vals))


def test_rmsse_denominator_train_only(spark):
    series = {"a": [1, 2, 3, 100]}
    den = M.rmsse_denominator(_long(spark, series), train_end=3).collect()[0]["denominator"]
    assert den == pytest.approx(1.0)  # diffs 1, 1 only


def test_rmsse_missing_denominator_is_null_and_skipped(spark):
    preds = spark.createDataFrame([("a", "d_3", 1, 2.0), ("b", "d_3", 0, 1.0)],
                                  "id string, d string, sales int, simple_avg_pred double")
    den = spark.createDataFrame([("a", 4.0)], "id string, denominator double")
    per = M.rmsse_by_series(preds, den, train_end=2, horizon=1)
    got = {r["id"]: r["rmsse"] for r in per.collect()}
    assert got["a"] == pytest.approx(0.5) and got["b"] is None
    assert M.rmsse_overall(per).collect()[0]["mean_rmsse"] == pytest.approx(0.5)


def test_confusion_matrix_all_cells_strict_cut(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.51), (1, 0.2), (0, 0.0)],
                               "sales int, simple_avg_pred double")
    cm = {(r["actual"], r["predicted"]): r["n"] for r in M.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 1}


def test_classification_metrics_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, predicted int")
    m = M.classification_metrics(df).collect()[0]
    assert m["precision"] == 0.0 and m["recall"] == 0.0 and m["f1"] == 0.0 and m["accuracy"] == 0.5


def test_balanced_weights(spark):
    df = spark.createDataFrame([("s", 1)] * 3 + [("s", 0)] + [("t", 0)] * 2, "store_id string, label int")
    w = {(r["store_id"], r["label"]): r["weight"] for r in M.balanced_weights(df).collect()}
    assert w[("s", 1)] == pytest.approx(4 / (2 * 3)) and w[("s", 0)] == pytest.approx(4 / (2 * 1))
    assert w[("t", 0)] == pytest.approx(1.0)


def test_financial_impact_and_savings(spark):
    df = spark.createDataFrame([(2, 1.0), (0, 1.5), (4, 4.0)], "sales int, simple_avg_pred double")
    f = M.financial_impact(df).collect()[0]
    assert f["excess_units"] == pytest.approx(1.5) and f["stockout_units"] == pytest.approx(1.0)
    assert f["total_loss"] == pytest.approx(1.5 * 0.5 + 1.0 * 5.0)
    s = M.savings_vs_baseline(df).collect()[0]
    mean = 2.0
    base_over = sum(max(mean - y, 0) for y in (2, 0, 4))
    base_under = sum(max(y - mean, 0) for y in (2, 0, 4))
    assert s["baseline_loss"] == pytest.approx(base_over * 0.5 + base_under * 5.0)
    assert s["total_savings"] == pytest.approx(s["baseline_loss"] - f["total_loss"])


def test_rmse_by_store_anchored_vs_first_match(spark):
    ids = ["HOBBIES_1_001_CA_1_evaluation", "FOODS_3_555_WI_3_evaluation", "HOUSEHOLD_2_104_TX_2_evaluation"]
    df = spark.createDataFrame([(i, 1, 1.0) for i in ids], "id string, sales int, simple_avg_pred double")
    anchored = sorted(r["store_id"] for r in M.rmse_by_store(df).collect())
    first = sorted(r["store_id"] for r in M.rmse_by_store(df, anchored=False).collect())
    assert anchored == ["CA_1", "TX_2", "WI_3"]
    assert first == ["DS_3", "ES_1", "LD_2"]
    assert not math.isnan(M.rmse(df).collect()[0]["rmse"])
