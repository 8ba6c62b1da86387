import os

import pytest

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"


def test_registry_and_oracle_names():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 50


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver tables absent")
def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "d", "forecast", "safety_stock"]
    assert df.count() > 0


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver tables absent")
def test_panel_is_dense_and_matches_fixture_counts(spark):
    from shelfcast.plans.context import ctx
    c = ctx(spark, SMOKE)
    assert c.sales_long.count() == 312375
    assert c.sales_long.where("sales > 0").count() == 5920
    assert c.joined.where("sell_price IS NULL").count() == 8897


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver tables absent")
@pytest.mark.parametrize("name", ["weighted_ensemble", "threshold_sweep", "submission_table",
                                  "rmsse_overall", "sequence_windows_next", "unpivot_sales"])
def test_queries_run_on_smoke_tables(spark, name):
    assert E.queries()[name](spark, SMOKE).count() > 0


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver tables absent")
@pytest.mark.parametrize("name", ["star_join", "dense_panel", "drop_prerelease", "prerelease_counts"])
def test_panel_queries_read_the_daily_table_only(spark, name):
    from shelfcast.plans.context import ctx
    ctx(spark, SMOKE).daily  # the one pass over the raw line items
    df = E.queries()[name](spark, SMOKE)
    df.collect()  # so that the final adaptive plan is there
    assert "lineitem" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver tables absent")
def test_sequence_inputs_do_not_see_the_day_they_predict(spark):
    from pyspark.sql import functions as F

    from shelfcast.operators import features as FT
    from shelfcast.plans.context import ctx
    from shelfcast.plans.model_queries import SEQ_FEATURES, sequence_inputs
    c = ctx(spark, SMOKE)
    assert "sales" not in SEQ_FEATURES
    day = c.train_end + 28
    changed = c.panel.withColumn("sales", F.when(F.col("d_int") == day, F.col("sales") + 50).otherwise(F.col("sales")))
    one = [sequence_inputs(FT.build_features(p, c.train_end), c.train_end)
           .where((F.col("d_int") == day) & (F.col("id") == "BRAND_1_AF_1_evaluation")).select(*SEQ_FEATURES).first()
           for p in (c.panel, changed)]
    assert one[0] == one[1]


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver tables absent")
def test_feature_windows_share_one_series_shuffle(spark):
    import re

    from shelfcast.operators import features as FT
    from shelfcast.plans.context import ctx
    c = ctx(spark, SMOKE)
    plan = FT.build_features(c.panel, c.train_end)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(id#\d+", plan)) == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
