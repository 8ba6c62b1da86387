import os
import tempfile

from pyspark.sql import functions as F

from shelfcast.streaming.store_results import read_store_results, stream_store_results


def _chunk(spark, src, store, sales, days, name):
    df = spark.createDataFrame([(f"x_{store}_evaluation", f"d_{d}", sales, 1.0, store) for d in days],
                               "id string, d string, sales int, simple_avg_pred double, store_id string")
    df.write.mode("overwrite").parquet(os.path.join(src, name))


def test_later_batches_replace_rows_by_key(spark):
    root = tempfile.mkdtemp(prefix="shelfcast-stream-")
    src, sink, ckpt = (os.path.join(root, x) for x in ("in", "out", "ckpt"))
    os.makedirs(src)
    _chunk(spark, src, "A", 1, range(1, 4), "p1")
    _chunk(spark, src, "B", 2, range(1, 4), "p2")
    stream_store_results(spark, os.path.join(src, "*"), sink, ckpt).awaitTermination(120)
    assert read_store_results(spark, sink).count() == 6
    _chunk(spark, src, "B", 9, range(2, 5), "p3")  # store B again: two days replaced, one new
    stream_store_results(spark, os.path.join(src, "*"), sink, ckpt).awaitTermination(120)
    out = read_store_results(spark, sink)
    assert out.count() == 7
    assert sorted(r.sales for r in out.where("store_id = 'B'").collect()) == [2, 9, 9, 9]
    assert out.where(F.col("store_id") == "A").agg(F.max("sales")).first()[0] == 1


def test_a_store_spread_over_many_files_and_batches_is_whole(spark):
    root = tempfile.mkdtemp(prefix="shelfcast-stream-")
    src, sink, ckpt = (os.path.join(root, x) for x in ("in", "out", "ckpt"))
    os.makedirs(src)
    for part in range(3):
        df = spark.createDataFrame([(f"x_{i}", f"d_{part}", i, 1.0, "A") for i in range(30)],
                                   "id string, d string, sales int, simple_avg_pred double, store_id string")
        df.repartition(30).write.parquet(os.path.join(src, f"p{part}"))
        stream_store_results(spark, os.path.join(src, "*"), sink, ckpt).awaitTermination(120)
    assert read_store_results(spark, sink).count() == 90
