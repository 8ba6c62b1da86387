import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import publish as PB
from shelfcast.operators import reshape as R
from shelfcast.sources import files as FS


def _preds(spark):
    data = [(sid, f"d_{d}", 1, float(d) + (0.5 if sid.startswith("b") else 0.0))
            for sid in ("a_evaluation", "b_evaluation") for d in range(1, 6)]
    return spark.createDataFrame(data, "id string, d string, sales int, simple_avg_pred double")


def test_submission_template_order_zero_fill(spark):
    template = spark.createDataFrame(
        [("b_validation", 1), ("zz_unknown", 2), ("a_evaluation", 3), ("a_validation", 0)],
        "id string, row_pos int")
    sub = PB.submission_table(_preds(spark), template, train_end=3, horizon=2).collect()
    assert [r["id"] for r in sub] == ["a_validation", "b_validation", "zz_unknown", "a_evaluation"]
    by = {r["id"]: r for r in sub}
    assert (by["a_validation"]["F1"], by["a_validation"]["F2"]) == (4.0, 5.0)
    assert (by["b_validation"]["F1"], by["zz_unknown"]["F2"]) == (4.5, 0.0)
    assert by["a_evaluation"]["F1"] == 4.0


def test_stand_in_template_has_both_suffixes(spark):
    t = PB.sample_submission_template(_preds(spark)).orderBy("row_pos").collect()
    assert [r["id"] for r in t] == ["a_validation", "b_validation", "a_evaluation", "b_evaluation"]


def test_head_sample_safety_stock(spark):
    p = _preds(spark)
    head = PB.forecast_head(p, 3).collect()
    assert [(r["id"], r["d"]) for r in head] == [("a_evaluation", "d_1"), ("a_evaluation", "d_2"),
                                                  ("a_evaluation", "d_3")]
    s1 = [r["item"] for r in PB.forecast_sample(p, 4).collect()]
    s2 = [r["item"] for r in PB.forecast_sample(p.repartition(3), 4).collect()]
    assert len(s1) == 4 and s1 == s2
    ss = {(r["id"], r["d"]): r["safety_stock"] for r in PB.safety_stock_rows(p).collect()}
    assert ss[("a_evaluation", "d_1")] == int(1.0 * 3 * 1.15)


def test_item_overlay(spark):
    cal = spark.createDataFrame([(f"d_{d}", dt.date(2020, 1, d)) for d in range(1, 6)], "d string, date date")
    probs = spark.createDataFrame([("a_evaluation", "d_2", 0.4)], "id string, d string, prob double")
    o = PB.item_overlay(_preds(spark), cal, "a_evaluation", probs).collect()
    assert len(o) == 5 and o[0]["date"] == dt.date(2020, 1, 1)
    assert o[1]["single_model_pred"] == pytest.approx(0.6) and o[0]["single_model_pred"] is None


def test_csv_wide_read_and_sinks(spark):
    d = tempfile.mkdtemp(prefix="shelfcast-files-")
    path = os.path.join(d, "wide.csv")
    with open(path, "w") as fh:
        fh.write("id,item_id,dept_id,cat_id,store_id,state_id,d_1,d_2\n")
        fh.write("X_CA_1_evaluation,X,D,C,CA_1,CA,3,0\n")
    w = FS.read_wide_sales(spark, path)
    assert dict(w.dtypes)["d_2"] == "int" and w.first()["d_1"] == 3
    preds = _preds(spark).withColumn("store_id", F.substring("id", 1, 1))
    out = os.path.join(d, "stores")
    FS.write_store_results(preds.where("store_id = 'a'"), out)
    FS.write_store_results(preds.where("store_id = 'b'"), out)
    FS.write_store_results(preds.where("store_id = 'b'").withColumn("sales", F.lit(9)), out)
    back = spark.read.parquet(out)
    assert back.count() == 10 and back.where("store_id = 'b' AND sales = 9").count() == 5
    FS.write_csv(_preds(spark), os.path.join(d, "preds_csv"))
    assert FS.read_csv(spark, os.path.join(d, "preds_csv"), FS.PREDICTIONS_SCHEMA).count() == 10
    FS.write_json(PB.forecast_sample(_preds(spark), 3), os.path.join(d, "sample_json"))
    assert spark.read.json(os.path.join(d, "sample_json")).count() == 3


def test_melt_of_a_wide_file_by_its_lines(spark, tmp_path):
    from shelfcast.sources.files import melt_wide_lines, write_wide_lines
    rows = [(f'it,em "{s}"', "S1", d, s * 10 + d if d != 3 else None) for s in range(5) for d in range(1, 8)]
    long = spark.createDataFrame(rows, "id string, store_id string, d_int int, sales int")
    path = str(tmp_path / "wide")
    write_wide_lines(long.repartition(3), path, ["id", "store_id"], 7)
    got = sorted((r["id"], r["store_id"], r["d"], r["sales"]) for r in melt_wide_lines(spark, path).collect())
    assert got == sorted((i, s, f"d_{d}", v) for i, s, d, v in rows)
    plain = FS.read_wide_sales(spark, path)
    assert plain.columns == ["id", "store_id", *[f"d_{i}" for i in range(1, 8)]] and plain.count() == 5
    by_columns = R.unpivot_wide(plain, ["id", "store_id"])
    assert sorted((r["id"], r["store_id"], r["d"], r["sales"]) for r in by_columns.collect()) == got


def test_melt_of_odd_wide_files(spark, tmp_path):
    from shelfcast.sources.files import melt_wide_lines, write_wide_lines
    one = tmp_path / "odd.csv"
    one.write_bytes(b'id,"store_id",d_9,d_2\r\nx,S,1,\r\n"y,z",S, 7,a\r\n\r\n')
    got = sorted(tuple(r) for r in melt_wide_lines(spark, str(one)).collect())
    assert got == [("x", "S", "d_2", None), ("x", "S", "d_9", 1), ("y,z", "S", "d_2", None), ("y,z", "S", "d_9", 7)]
    (tmp_path / "header.csv").write_text("id,d_1\n")
    assert melt_wide_lines(spark, str(tmp_path / "header.csv")).count() == 0
    for text in ("", "id,store_id\n", "d_1,d_2\n1,2\n"):
        (tmp_path / "bad.csv").write_text(text)
        with pytest.raises(ValueError):
            melt_wide_lines(spark, str(tmp_path / "bad.csv"))
    gap = spark.createDataFrame([("x", 1, 5), ("x", 3, 6)], "id string, d_int int, sales int")
    with pytest.raises(Exception, match="one row per day"):
        write_wide_lines(gap, str(tmp_path / "gap"), ["id"], 2)
