import numpy as np
import pytest

from shelfcast.operators import ensemble as E


def test_threshold_grid_is_linspace():
    g = E.threshold_grid()
    assert len(g) == 161 and g == [float(x) for x in np.linspace(0.1, 0.9, 161)]


def test_weights_sum_to_one_per_store(spark):
    rm = spark.createDataFrame([("s1", "a", 1.0), ("s1", "b", 3.0), ("s2", "a", 2.0), ("s2", "b", 2.0)],
                               "store_id string, model_id string, rmse double")
    w = E.ensemble_weights(rm)
    sums = {r["store_id"]: r["s"] for r in w.groupBy("store_id").agg({"weight": "sum"})
            .withColumnRenamed("sum(weight)", "s").collect()}
    assert sums["s1"] == pytest.approx(1.0) and sums["s2"] == pytest.approx(1.0)
    got = {(r["store_id"], r["model_id"]): r["weight"] for r in w.collect()}
    wa, wb = 1 / (1 + 1e-6), 1 / (3 + 1e-6)
    assert got[("s1", "a")] == pytest.approx(wa / (wa + wb))


def test_weighted_ensemble_clips_and_shrinks(spark):
    preds = spark.createDataFrame(
        [("x", "d_1", "s1", 2, "a", 4.0), ("x", "d_1", "s1", 2, "b", -2.0)],
        "id string, d string, store_id string, sales int, model_id string, pred double")
    w = spark.createDataFrame([("s1", "a", 0.25), ("s1", "b", 0.75)], "store_id string, model_id string, weight double")
    r = E.weighted_ensemble(preds, w).collect()[0]
    assert r["simple_avg_pred"] == pytest.approx((0.25 * 4.0 + 0.75 * 0.0) * 0.98)


def test_power_mean_without_root(spark):
    p = spark.createDataFrame([("x", "d_1", 1, "a", 0.5), ("x", "d_1", 1, "b", 1.0)],
                              "id string, d string, label int, model_id string, prob double")
    assert E.power_mean(p).collect()[0]["score"] == pytest.approx((0.25 + 1.0) / 2)


def _naive_sweep(scores, labels, cuts):
    out = []
    s, y = np.asarray(scores), np.asarray(labels)
    for t in cuts:
        p = (s >= t).astype(int)
        tp = int(((p == 1) & (y == 1)).sum()); fp = int(((p == 1) & (y == 0)).sum())
        fn = int(((p == 0) & (y == 1)).sum()); tn = int(((p == 0) & (y == 0)).sum())
        out.append((tp, fp, fn, tn))
    return out


def test_sweep_equals_naive_passes(spark):
    rng = np.random.default_rng(7)
    scores = list(rng.random(400))
    cuts = E.threshold_grid()
    scores += cuts[:20]  # scores exactly on cuts
    labels = [int(x) for x in rng.integers(0, 2, len(scores))]
    df = spark.createDataFrame([(float(s), l) for s, l in zip(scores, labels)], "score double, label int")
    sw = E.threshold_sweep(df).orderBy("k").collect()
    got = [(r["tp"], r["fp"], r["fn"], r["tn"]) for r in sw]
    assert got == _naive_sweep(scores, labels, cuts)


def _sweep_rows(spark, rows):
    return spark.createDataFrame(rows, "k int, threshold double, accuracy double, precision double, recall double, f1 double")


def test_best_threshold_prefers_all_kill_then_lowest_cut(spark):
    rows = [(0, 0.1, 0.9, 0.9, 0.9, 0.7), (1, 0.2, 0.9, 0.9, 0.9, 0.7), (2, 0.3, 0.5, 0.5, 0.5, 0.95)]
    b = E.best_threshold(_sweep_rows(spark, rows)).collect()[0]
    assert b["optimal_threshold"] == 0.1 and b["all_kill_success"] is True


def test_best_threshold_falls_back_to_max_f1(spark):
    rows = [(0, 0.1, 0.1, 0.1, 0.1, 0.3), (1, 0.2, 0.1, 0.1, 0.1, 0.4), (2, 0.3, 0.1, 0.1, 0.1, 0.4)]
    b = E.best_threshold(_sweep_rows(spark, rows)).collect()[0]
    assert b["optimal_threshold"] == 0.2 and b["all_kill_success"] is False


def test_best_threshold_default_when_f1_zero(spark):
    rows = [(0, 0.1, 0.5, 0.0, 0.0, 0.0), (1, 0.2, 0.5, 0.0, 0.0, 0.0)]
    assert E.best_threshold(_sweep_rows(spark, rows)).collect()[0]["optimal_threshold"] == 0.5


def test_final_metrics_at_cut(spark):
    df = spark.createDataFrame([(0.9, 1), (0.6, 0), (0.2, 1), (0.1, 0)], "score double, label int")
    m = E.final_metrics(df, 0.5).collect()[0]
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (1, 1, 1, 1)
    assert m["f1"] == pytest.approx(0.5)
