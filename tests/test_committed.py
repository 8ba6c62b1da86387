"""Results that survive a stop between stores, and in the middle of one."""

import os

import pytest
from pyspark.sql import functions as F

from shelfcast.sources.committed import StoreResults, resume

SCHEMA = "id string, d string, sales int, pred double, store_id string, model_id string"
STORES, MEMBERS = ["A", "B", "C", "D"], ["m1", "m2"]


def maker(spark, asked, fail_at=None):
    def make(stores, members):
        if fail_at in stores:
            raise RuntimeError("driver lost")
        asked.append((tuple(stores), tuple(members)))
        rows = [(f"x{i}", f"d_{d}", i, i * 0.5 + d, s, m) for s in stores for m in members for i in range(3) for d in range(4)]
        return spark.createDataFrame(rows, SCHEMA)
    return make


def rows(results):
    return sorted(tuple(r[c] for c in ("store_id", "model_id", "id", "d", "sales", "pred")) for r in results.read(SCHEMA).collect())


def test_a_stopped_run_is_continued(spark, tmp_path):
    whole, asked = StoreResults(spark, str(tmp_path / "whole")), []
    assert resume(whole, STORES, MEMBERS, maker(spark, asked), 2) == 8
    assert asked == [(("A", "B"), ("m1", "m2")), (("C", "D"), ("m1", "m2"))]

    results, asked = StoreResults(spark, str(tmp_path / "stopped")), []
    with pytest.raises(RuntimeError):
        resume(results, STORES, MEMBERS, maker(spark, asked, fail_at="C"))
    assert {r["store_id"] for r in results.manifest().collect()} == {"A", "B"}
    assert {r[0] for r in rows(results)} == {"A", "B"}
    asked.clear()
    assert resume(results, STORES, MEMBERS, maker(spark, asked)) == 4
    assert [a[0] for a in asked] == [("C",), ("D",)]          # A and B are not made again
    assert rows(results) == rows(whole)
    assert resume(results, STORES, MEMBERS, maker(spark, asked)) == 0 and len(asked) == 2
    assert resume(results, STORES, [*MEMBERS, "m3"], maker(spark, asked), 4) == 4
    assert asked[-1] == (("A", "B", "C", "D"), ("m3",)) and len(rows(results)) == 12 * 12


def test_data_without_a_manifest_row_is_not_read(spark, tmp_path, monkeypatch):
    results, asked = StoreResults(spark, str(tmp_path)), []
    resume(results, ["A"], MEMBERS, maker(spark, asked))
    before = rows(results)
    maker(spark, asked)(["B"], MEMBERS).write.partitionBy("store_id", "model_id").parquet(
        os.path.join(results.path, "data", "00000000000000000001-lost"))        # stopped before its manifest
    assert rows(results) == before
    assert resume(results, ["A", "B"], MEMBERS, maker(spark, asked)) == 2
    assert len(rows(results)) == 2 * len(before)


def test_a_pair_committed_twice_counts_once(spark, tmp_path):
    results = StoreResults(spark, str(tmp_path))
    one = maker(spark, [])(["A"], ["m1"])
    results.commit(one)
    results.commit(one.withColumn("pred", F.col("pred") + 1))
    assert len(rows(results)) == 12 and min(r[-1] for r in rows(results)) == 1.0


def test_nothing_there(spark, tmp_path):
    results = StoreResults(spark, str(tmp_path / "none"))
    assert rows(results) == [] and results.missing(["A"], ["m"]) == {"A": ["m"]}
    assert results.commit(maker(spark, [])(["A"], ["m1"]).limit(0)) == 0
    assert rows(results) == []
