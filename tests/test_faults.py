"""Faults that once lost or changed rows silently."""

import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shelfcast import session
from shelfcast.operators import ensemble as E
from shelfcast.operators import features as FT
from shelfcast.sources import files as FS
from shelfcast.sources import standin as S


def test_lines_without_quantity_have_no_price(spark):
    root = tempfile.mkdtemp(prefix="shelfcast-tables-")
    tables = {
        "region": ("r_regionkey long, r_name string", [(0, "AFRICA")]),
        "nation": ("n_nationkey long, n_regionkey long", [(0, 0)]),
        "supplier": ("s_suppkey long, s_nationkey long", [(1, 0)]),
        "part": ("p_partkey long, p_brand string", [(1, "Brand#7")]),
        "lineitem": ("l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp",
                     None),
    }
    for name, (schema, rows) in tables.items():
        if rows is None:
            df = spark.sql("SELECT 1L l_partkey, 1L l_suppkey, q l_quantity, p l_extendedprice, "
                           "timestamp'2000-01-03' l_shipdate FROM VALUES (10D, 100D), (0D, 50D) AS t(q, p)")
        else:
            df = spark.createDataFrame(rows, schema)
        df.write.parquet(os.path.join(root, f"{name}.parquet"))
    assert [r.sell_price for r in S.sell_prices(spark, root).collect()] == [10.0]


def test_missing_scores_count_as_negative_at_every_cut(spark):
    df = spark.createDataFrame([(1, 0.95), (0, 0.2), (1, None), (0, float("nan"))], "label int, score double")
    sweep = E.threshold_sweep(df).collect()
    assert all(r.tp + r.fp + r.fn + r.tn == 4 for r in sweep)
    assert all(r.fn >= 1 and r.tn >= 1 for r in sweep)
    final = E.final_metrics(df, 0.5).first()
    assert (final.tp, final.fp, final.fn, final.tn) == (1, 0, 1, 2)
    assert not math.isnan(final.f1)


@pytest.mark.parametrize("header,row", [("store_id,item_id,wm_yr_wk,sell_price", "CA_1,X,3,1.5"),
                                        ("item_id,sell_price,store_id,extra,wm_yr_wk", "X,1.5,CA_1,zz,3")])
def test_csv_columns_are_matched_by_name(spark, header, row):
    path = tempfile.mkdtemp(prefix="shelfcast-csv-") + "/prices.csv"
    with open(path, "w") as f:
        f.write(f"{header}\n{row}\n")
    df = FS.read_csv(spark, path, FS.PRICES_SCHEMA)
    assert df.schema == FS.PRICES_SCHEMA
    assert tuple(df.first()) == ("CA_1", "X", 3, 1.5)


def test_csv_with_a_missing_column_raises(spark):
    path = tempfile.mkdtemp(prefix="shelfcast-csv-") + "/calendar.csv"
    with open(path, "w") as f:
        f.write("date,d\n2000-01-01,d_1\n")
    with pytest.raises(ValueError, match="wm_yr_wk"):
        FS.read_csv(spark, path, FS.CALENDAR_SCHEMA)


def test_dictionaries_number_sorted_values_per_column(spark):
    rows = [(f"v{i % 37:02d}", None if i % 5 == 0 else f"w{i % 11}") for i in range(400)]
    df = spark.createDataFrame(rows, "x string, y string").repartition(7)
    got = {(r["column"], r["value"]): r["code"] for r in FT.category_dictionaries(df, ["x", "y"]).collect()}
    want = {("x", v): i for i, v in enumerate(sorted({r[0] for r in rows}))}
    want |= {("y", v): i for i, v in enumerate(sorted({r[1] for r in rows if r[1]}))}
    assert got == want
    assert {r.y for r in FT.category_codes(df, ["y"]).where(F.col("x") == "v00").collect()} >= {-1}


def test_no_fact_shuffle_by_few_keys(spark):
    """With Spark's own broadcasts off, the counted maps still spare the fact
    rows a shuffle by weekday, department or event."""
    import re
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in old:
        spark.conf.set(k, "-1")
    try:
        df = spark.range(1000).select(F.concat(F.lit("i"), F.col("id") % 9).alias("item_id"), F.lit("D").alias("dept_id"),
                                      (F.col("id") % 7).cast("int").alias("wday"), F.lit(None).cast("string").alias("event_name_1"),
                                      F.col("id").cast("int").alias("d_int"), (F.col("id") % 3).cast("int").alias("sales"))
        plan = FT.add_encodings(df, 900)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert not re.search(r"Exchange hashpartitioning\((item_id|dept_id|wday)", plan)


def test_cluster_sessions_need_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_released_tables_are_gone(spark):
    path = session.materialize(spark.range(3), "release-me").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    keep, session._WRITTEN[:] = session._WRITTEN[:-1], session._WRITTEN[-1:]
    assert session.release_tables(spark) == 1 and not os.path.exists(path)
    session._WRITTEN[:] = keep
