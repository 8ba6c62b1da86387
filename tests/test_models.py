"""Model operators on a small frame with known structure."""

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import features as FT
from shelfcast.operators import models as MD


def test_grid_is_complete():
    grid = MD.model_grid()
    assert len(grid) == 50 and len({g.model_id for g in grid}) == 50
    assert sum(g.is_hurdle for g in grid) == 2
    assert {(g.objective, g.feature_set) for g in grid if not g.is_hurdle} == {
        (o, f) for o in MD.LOSSES for f in MD.FEATURE_SETS}


def test_feature_sets():
    every, no_lags = FT.feature_set("all"), FT.feature_set("no_lags")
    assert len(every) == 30 and len(FT.OCCURRENCE_FEATURES) == 32
    assert [f for f in every if f not in no_lags] == ["sales_lag_28", "sales_lag_35", "sales_lag_42", "sales_lag_364"]
    with pytest.raises(ValueError):
        FT.feature_set("some")


@pytest.fixture(scope="module")
def frames(spark):
    """Sales follow the weekday mean: twice as much on half of the days."""
    df = spark.range(1200).select(
        F.concat(F.lit("BRAND_"), F.col("id") % 6, F.lit("_AF_1_evaluation")).alias("id"),
        F.concat(F.lit("d_"), (F.col("id") / 6).cast("int") + 1).alias("d"),
        ((F.col("id") / 6).cast("int") + 1).alias("d_int"), F.lit("AF_1").alias("store_id"))
    high = F.pmod("d_int", F.lit(2)) == 0
    df = df.withColumn("sales", F.when(high, 6 + F.pmod(F.xxhash64("id", "d"), F.lit(3))).otherwise(0).cast("int"))
    known = {f: F.lit(0.0) for f in FT.OCCURRENCE_FEATURES}
    known["item_wday_mean"] = F.when(high, 7.0).otherwise(0.2)
    known["dept_wday_mean"] = F.when(high, 0.95).otherwise(0.05)
    df = df.withColumns(known).cache()
    return df.where("d_int <= 160"), df.where("d_int > 160")


def _rmse(df, p):
    return df.select(F.sqrt(F.avg((F.col("sales") - p) ** 2))).first()[0]


@pytest.mark.parametrize("objective", ["squared_error", "poisson"])
def test_quantity_models_beat_the_train_mean(frames, objective):
    train, val = frames
    out = MD.gbt_quantity(train, val, MD.ModelConfig(objective, "all", 42), rounds=10, lr=0.5).cache()
    mean = train.select(F.avg("sales")).first()[0]
    assert out.count() == val.count() and out.where("pred < 0").count() == 0
    assert _rmse(out, F.col("pred")) < 0.6 * _rmse(val, F.lit(mean))


def test_grid_fits_stand_for_all_seeds(frames):
    train, val = frames
    grid = [g for g in MD.model_grid() if g.objective == "poisson" and not g.is_hurdle]
    out = MD.fit_grid(train, val, grid).cache()
    assert out.groupBy("model_id").count().where(F.col("count") != val.count()).count() == 0
    assert {r.model_id for r in out.select("model_id").distinct().collect()} == {g.model_id for g in grid}
    assert out.groupBy("id", "d").agg(F.count_distinct("pred").alias("n")).agg(F.max("n")).first()[0] <= 2


def test_occurrence_model_tells_days_apart(frames):
    from shelfcast.operators import metrics as M
    train, val = frames
    w = M.balanced_weights(train.withColumn("label", (F.col("sales") > 0).cast("int")))
    out = MD.occurrence_model(train, val, "lr", w, features=FT.OCCURRENCE_FEATURES)
    means = {r.label: r.p for r in out.groupBy("label").agg(F.avg("prob").alias("p")).collect()}
    assert means[1] > 0.9 and means[0] < 0.1


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_trees_part_codes_as_sets(spark, kind):
    """Sold in departments 1, 3 and the missing one, among 40: no order of the codes tells."""
    dept = (F.col("id") % 41 - 1).cast("int")
    df = spark.range(4100).select(
        F.concat(F.lit("x"), F.col("id")).alias("id"), F.concat(F.lit("d_"), F.col("id")).alias("d"), F.lit("A").alias("store_id"),
        dept.alias("dept_id"), F.when(dept.isin(-1, 1, 3, 17, 30), 2).otherwise(0).alias("sales"))
    df = df.withColumns({f: F.lit(0.0) for f in FT.OCCURRENCE_FEATURES if f != "dept_id"})
    nulls = df.withColumn("dept_id", F.when(F.col("dept_id") >= 0, F.col("dept_id")))
    weights = spark.createDataFrame([("A", 0, 1.0), ("A", 1, 1.0)], "store_id string, label int, weight double")
    shallow = MD.RF_DEPTH
    try:
        MD.RF_DEPTH = 3
        out = MD.occurrence_model(df, nulls, kind, weights, features=["dept_id", "sell_price"], rounds=3)
    finally:
        MD.RF_DEPTH = shallow
    wrong = out.where((F.col("prob") > 0.5).cast("int") != F.col("label")).count()
    assert out.count() == 4100 and wrong <= (100 if kind == "rf" else 0)   # of 500 sold; sampled trees may miss a code
    sizes = MD.category_sizes(df, nulls, ["dept_id"])
    assert sizes == {"dept_id": 41}
    again = MD.with_categories(nulls, ["dept_id"], sizes)
    assert again.schema["dept_id"].metadata["ml_attr"]["type"] == "nominal"
    assert again.agg(F.min("dept_id"), F.max("dept_id")).first()[:] == (0.0, 40.0)


def test_members_take_their_own_fits_once(spark, frames, monkeypatch):
    from shelfcast.plans import context as C
    from shelfcast.plans import model_queries as Q
    train, val = frames
    c = C.RetailContext(spark, "members")
    c.__dict__.update(coded=train.unionByName(val), train_end=160, horizon=40)
    grown, grow = [], MD.grow_fits
    monkeypatch.setattr(C, "_stamp", lambda *a: ())
    monkeypatch.setattr(C, "_TABLES", {})
    monkeypatch.setattr(MD, "ROUNDS", 2)
    monkeypatch.setattr(MD, "grow_fits", lambda t, v, fits, depth=2: grown.append([f.name for f in fits]) or grow(t, v, fits, depth))
    monkeypatch.setattr(Q, "ctx", lambda *a: c)
    alone = {r["id"] + r["d"]: r["pred"] for r in Q.hurdle_poisson(spark, "members").collect()}
    assert grown == [["sold_all", "amount_poisson_all"]] and len(alone) == val.count()
    Q.hurdle_forecast(spark, "members").count()
    Q.poisson_trees(spark, "members").count()
    assert grown[1:] == [["amount_squared_error_all"], ["poisson_all"]]
    grid = c.fitted_grid
    assert len(grown) == 4 and len(grown[3]) == 5 and not {n for some in grown[:3] for n in some} & set(grown[3])
    assert grid.groupBy("id", "d").count().where("count != 50").count() == 0
    model = MD.ModelConfig("poisson", "all", 1, True).model_id
    whole = MD.fit_grid(train, val, [g for g in MD.model_grid() if g.objective == "poisson"], depth=2)
    for table in (grid, whole):
        some = {r["id"] + r["d"]: r["pred"] for r in table.where(F.col("model_id") == model).collect()}
        assert some.keys() == alone.keys() and all(abs(some[k] - v) < 1e-9 for k, v in alone.items())
