import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfcast.functions import columns as C
from shelfcast.functions.narrowing import column_ranges, narrow_type, narrow_types
from shelfcast.operators import features as FT
from shelfcast.operators import sequences as SQ


def _series(spark, sid, prices, sales=None):
    sales = sales or [1] * len(prices)
    data = [(sid, i + 1, f"d_{i + 1}", p, s) for i, (p, s) in enumerate(zip(prices, sales))]
    return spark.createDataFrame(data, "id string, d_int int, d string, sell_price double, sales int")


def test_price_momentum_counts_rows_not_days(spark):
    # Days 1..10 then a gap (day 11 missing), then 12..40: row lag != day lag.
    prices = [float(i) for i in range(1, 41)]
    df = _series(spark, "a", prices).where("d_int != 11")
    out = {r["d_int"]: r for r in FT.price_momentum(df).collect()}
    assert out[8]["price_change_w1"] == pytest.approx(8 / 1)
    assert out[12]["price_change_w1"] == pytest.approx(12 / 4)  # 7 rows back is day 4
    assert out[3]["price_change_w1"] == 1.0  # no earlier row
    assert out[40]["price_max_ratio"] == 1.0 and out[20]["price_max_ratio"] == pytest.approx(20 / 40)


def test_price_zero_divisor_gives_one(spark):
    df = _series(spark, "a", [0.0] * 8 + [2.0])
    assert {r["d_int"]: r["price_change_w1"] for r in FT.price_momentum(df).collect()}[9] == 1.0


def test_causal_price_max(spark):
    df = _series(spark, "a", [1.0, 4.0, 2.0])
    got = {r["d_int"]: r["price_max_ratio"] for r in FT.price_momentum(df, causal=True).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.5}


def test_rolling_needs_full_frame(spark):
    df = _series(spark, "a", [1.0] * 40, sales=list(range(40)))
    out = {r["d_int"]: r for r in FT.rolling_stats(df, windows=[7]).collect()}
    assert out[34]["rolling_mean_7"] is None
    assert out[35]["rolling_mean_7"] == pytest.approx(sum(range(0, 7)) / 7)  # rows 1..7
    assert out[35]["rolling_std_7"] == pytest.approx(2.160246899, rel=1e-6)


def _calendar(spark, events):
    data = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), events.get(i)) for i in range(6)]
    return spark.createDataFrame(data, "date date, event_name_1 string")


@pytest.mark.parametrize("events,since,to", [
    ({}, [9999] * 6, [9999] * 6),
    ({2: "E"}, [9999, 9999, 0, 1, 2, 3], [2, 1, 0, 9999, 9999, 9999]),
    ({1: "E", 4: "F"}, [9999, 0, 1, 2, 0, 1], [1, 0, 2, 1, 0, 9999]),
])
def test_event_distance_sentinels(spark, events, since, to):
    out = FT.event_days(_calendar(spark, events)).orderBy("date").collect()
    assert [r["days_since_event"] for r in out] == since
    assert [r["days_to_event"] for r in out] == to


def test_event_days_one_row_per_date(spark):
    cal = _calendar(spark, {2: "E"}).unionByName(_calendar(spark, {2: "X"}))
    assert FT.event_days(cal).count() == 6


def test_target_encoding_null_event_and_fallback(spark):
    data = [("i1", 1, None, 2), ("i1", 2, "E", 0), ("i1", 3, "E", 3), ("i2", 4, None, 5), ("i1", 5, "E", 7)]
    df = spark.createDataFrame(data, "item_id string, d_int int, event_name_1 string, sales int")
    enc = FT.target_encode(df, 4, ["item_id", "event_name_1"], "m", "occurrence")
    got = {r["d_int"]: r["m"] for r in enc.collect()}
    assert got[1] == 0.0 and got[4] == 0.0  # NULL key never matches
    assert got[2] == 0.5 and got[5] == 0.5  # train rows only (d <= 4)
    df2 = df.withColumn("wday", F.lit(1)).unionByName(
        spark.createDataFrame([("i3", 6, None, 9, 2)], "item_id string, d_int int, event_name_1 string, sales int, wday int"))
    enc2 = FT.target_encode(df2, 4, ["item_id", "wday"], "q", "quantity", fallback_keys=["item_id"])
    got2 = {r["d_int"]: r["q"] for r in enc2.collect()}
    assert got2[6] == 0.0  # unseen item in training: fallback missing too -> 0
    assert got2[1] == pytest.approx((2 + 0 + 3) / 3)


def test_encoding_is_leak_free(spark):
    base = [("i", d, 1 + (d % 7), d % 3) for d in range(1, 30)]
    df = spark.createDataFrame(base, "item_id string, d_int int, wday int, sales int")
    changed = df.withColumn("sales", F.when(F.col("d_int") > 20, F.lit(100)).otherwise(F.col("sales")))
    a = FT.target_encode(df, 20, ["item_id", "wday"], "m").orderBy("d_int").collect()
    b = FT.target_encode(changed, 20, ["item_id", "wday"], "m").orderBy("d_int").collect()
    assert [r["m"] for r in a] == [r["m"] for r in b]


def test_category_codes_sorted_rank_null_minus_one(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "x string")
    got = sorted((r["x"],) for r in FT.category_codes(df, ["x"]).collect())
    assert got == [(-1,), (0,), (0,), (1,), (2,)]


def test_standardize_population_zero_variance(spark):
    df = spark.createDataFrame([("s", 1.0, 5.0), ("s", 3.0, 5.0)], "store_id string, a double, b double")
    out = FT.standardize(df, ["a", "b"]).collect()
    assert sorted(r["a"] for r in out) == [-1.0, 1.0]
    assert [r["b"] for r in out] == [0.0, 0.0]


def test_sequence_window_counts(spark):
    data = [(sid, d, d % 2) for sid, n in (("a", 34), ("b", 33), ("c", 33)) for d in range(1, n + 1)]
    df = spark.createDataFrame(data, "id string, d_int int, sales int")
    seqs = SQ.sequence_windows(df, ["sales"])
    assert seqs.count() == 19
    first = seqs.where("id = 'a'").orderBy("d_int").first()
    assert first["d_int"] == 28 and len(first["seq"]) == 28 and first["label"] == 0
    nxt = SQ.sequence_windows_next(df, ["sales"])
    assert nxt.count() == 6 + 5 + 5
    flat = SQ.flatten_sequence(seqs, ["sales"]).first()["seq_flat"]
    assert len(flat) == 28


def test_narrowing_strict_bounds(spark):
    assert narrow_type(-127, 126) == "tinyint"
    assert narrow_type(-128, 0) == "smallint"
    assert narrow_type(0, 127) == "smallint"
    assert narrow_type(0, 32767) == "int"
    df = spark.createDataFrame([(-128, 5, 1.5), (127, 6, 2.5)], "a int, b int, c double")
    rng = {r["column"]: (r["min_value"], r["max_value"]) for r in column_ranges(df).collect()}
    assert rng == {"a": (-128, 127), "b": (5, 6)}
    out = dict(narrow_types(df).dtypes)
    assert out == {"a": "smallint", "b": "tinyint", "c": "float"}


def test_scalar_columns(spark):
    df = spark.createDataFrame([("d_1914", dt.date(2016, 4, 25), 2.0, 0)], "d string, date date, f double, s int")
    r = df.select(C.day_index("d").alias("i"), C.weekday0("date").alias("w"),
                  C.safety_stock("f").alias("ss"), C.occurrence("s").alias("o")).first()
    assert (r["i"], r["w"], r["ss"], r["o"]) == (1914, 0, 6, 0)  # 2016-04-25 is a Monday


def test_rolling_by_running_sums_equals_frames(spark):
    """Whole numbers, with gaps and short series, against the frame itself; no bounded frame in the plan."""
    from pyspark.sql import Window
    rows = [(f"s{s}", t, None if (s * t) % 29 == 7 else (t * t * 7 + s) % 11 * (10 ** 6 if s == 2 else 1))
            for s in range(4) for t in range(1, 150 - 40 * s)]
    df = spark.createDataFrame(rows, "id string, d_int int, sales int").withColumn("d", F.concat(F.lit("d_"), "d_int"))
    out = FT.recent_occurrence(FT.rolling_stats(df, [1, 7, 30]))
    plan = out._jdf.queryExecution().toString()
    assert "boundedpreceding" in plan.replace("-", "").lower() and "RowFrame, -34" not in plan and "RowFrame, -57" not in plan
    w = Window.partitionBy("id").orderBy("d_int")
    for n in (1, 7, 30):
        fr = w.rowsBetween(-(27 + n), -28)
        full = F.count("sales").over(fr) == n
        out = out.withColumns({f"m{n}": F.when(full, F.avg("sales").over(fr)), f"v{n}": F.when(full, F.stddev_samp("sales").over(fr))})
    fr = w.rowsBetween(-55, -28)
    out = out.withColumn("o", F.when(F.count("sales").over(fr) == 28, F.avg((F.col("sales") > 0).cast("double")).over(fr)))
    n_values = 0
    for r in out.collect():
        for a, b in [(r[f"rolling_mean_{n}"], r[f"m{n}"]) for n in (1, 7, 30)] + [
                (r[f"rolling_std_{n}"], r[f"v{n}"]) for n in (1, 7, 30)] + [(r["occ_rate_28"], r["o"])]:
            assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * (1 + abs(b))), r
            n_values += a is not None
    assert n_values > 500


def test_windows_of_chunked_series(spark, monkeypatch):
    """Slices over chunks equal the rows themselves, in order, across chunk ends."""
    monkeypatch.setattr(SQ, "CHUNK", 10)
    rows = [(f"s{s}", 2 * t, (t * 7 + s) % 5, float(t)) for s in range(3) for t in range(33 - 14 * s)]
    df = spark.createDataFrame(rows, "id string, d_int int, sales int, x double").repartition(3)
    for make, gap in ((SQ.sequence_windows, 0), (SQ.sequence_windows_next, 1)):
        got = {(r["id"], r["d_int"]): (r["label"], [s["x"] for s in r["seq"]]) for r in make(df, ["x"], 6).collect()}
        want = {}
        for sid in {r[0] for r in rows}:
            mine = sorted(r for r in rows if r[0] == sid)
            for i in range(5 + gap, len(mine)):
                want[sid, mine[i][1]] = (int(mine[i][2] > 0), [m[3] for m in mine[i - 5 - gap:i + 1 - gap]])
        assert got == want
    assert SQ.sequence_windows(df.limit(0), ["x"], 6).count() == 0
