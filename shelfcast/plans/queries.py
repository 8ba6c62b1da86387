"""Named queries: one per operator of SURVEY §2, each ``(spark, sf_dir) -> DataFrame``.

Column names match the DuckDB oracle in ``shelfcast.plans.oracle``.  Doubles
are rounded to 6 places on both sides where summation order could differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions import columns as C
from shelfcast.functions.narrowing import column_ranges, narrow_expr_sql
from shelfcast.functions.narrowing import narrow_types as narrow_cast
from shelfcast.operators import ensemble as E
from shelfcast.operators import features as FT
from shelfcast.operators import metrics as M
from shelfcast.operators import panel as P
from shelfcast.operators import publish as PB
from shelfcast.operators import reshape as R
from shelfcast.operators import sequences as SQ
from shelfcast.plans.context import ctx
from shelfcast.session import new_path
from shelfcast.sources import files as FS
from shelfcast.sources import standin as S
from shelfcast.sources.tables import folder_of, footer_scan

OVERLAY_SERIES = "BRAND_1_AF_1_evaluation"
CATEGORIES = ["item_id", "dept_id", "cat_id", "event_name_1", "event_type_1"]
ROUND = 6

#: The numeric inputs of the sequence model: all features but the categories
#: and the 0/1 flags.
SCALED = [f for f in FT.OCCURRENCE_FEATURES if f not in CATEGORIES and not f.startswith("snap_")]

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def r6(c, name: str | None = None):
    """Round a double to 6 places, keeping (or setting) its name."""
    col = F.round(F.col(c) if isinstance(c, str) else c, ROUND)
    alias = name or (c if isinstance(c, str) else None)
    return col.alias(alias) if alias else col


def r3(c, name: str):
    """Round a sum of scaled values to 3 places, without a negative zero."""
    return (F.round(c, 3) + F.lit(0.0)).alias(name)


# ------------------------------------------------------------ reshape / panel


def _joined_from_daily(spark, sf):
    """The star join computed from the daily sums: the one table that reads the
    raw line items, written once per application."""
    c = ctx(spark, sf)
    return P.star_join(S.sales_long(spark, sf, c.daily), c.calendar, S.sell_prices(spark, sf, c.daily))


@query
def unpivot_sales(spark, sf):
    """SRC1 + RSH1/PRJ2: melt the wide sales CSV (d_* columns) into the long panel."""
    return FS.melt_wide_lines(spark, ctx(spark, sf).wide_file)


@query
def daily_total_sales(spark, sf):
    """RSH3/AGG1: daily totals of the wide table's day columns, with dates."""
    c = ctx(spark, sf)
    totals = R.column_totals(c.sales_wide)
    return totals.join(F.broadcast(c.calendar.select("d", "date")), "d", "left")


@query
def dense_panel(spark, sf):
    """RSH4: sparse non-zero daily sales densified over every day, 0-filled."""
    sparse = S.sparse_sales(spark, sf, ctx(spark, sf).daily)
    lo, hi = S.date_bounds(spark, sf)  # the calendar's range, read once
    return R.dense_grid(sparse, ["item_id", "dept_id", "cat_id", "store_id", "state_id"], "date",
                        lo, hi, value_cols=["sales"])


@query
def star_join(spark, sf):
    """JON1/JON2: panel x calendar (inner on d) x prices (left on 3 keys)."""
    return _joined_from_daily(spark, sf).withColumn("sell_price", r6("sell_price"))


@query
def drop_prerelease(spark, sf):
    """FLT4: the panel without rows before an item's first price."""
    return P.drop_prerelease(_joined_from_daily(spark, sf)).select(
        *S.ID_COLS, "d", "sales", "wm_yr_wk", r6("sell_price"))


@query
def prerelease_counts(spark, sf):
    """FLT4 report: rows before / after / removed."""
    return P.prerelease_counts(_joined_from_daily(spark, sf))


@query
def temporal_split(spark, sf):
    """FLT1: train (d <= T) / validation (T < d <= T+28) labels."""
    c = ctx(spark, sf)
    return P.temporal_split(c.panel, c.train_end).select("id", "d", "sales", "split")


@query
def lookback_split(spark, sf):
    """FLT2: last 365 train days and validation with 27 days of context."""
    c = ctx(spark, sf)
    return P.lookback_split(c.panel, c.train_end).select("id", "d", "split")


@query
def day_index(spark, sf):
    """SCL1: d_N -> N."""
    return ctx(spark, sf).sales_long.select("d").distinct().select("d", C.day_index("d").alias("d_int"))


@query
def date_parts(spark, sf):
    """SCL2/SCL3: weekday (Monday = 0), month, year of each panel day."""
    days = ctx(spark, sf).joined.select("d", "date").distinct()
    return FT.add_date_parts(days).select("d", "date", "wday", "month", "year")


@query
def store_from_id(spark, sf):
    """SCL7: store parsed from the series id, anchored and first-match (B1)."""
    ids = ctx(spark, sf).sales_long.select("id").distinct()
    return ids.select("id", C.store_from_id("id", True).alias("store_anchored"),
                      C.store_from_id("id", False).alias("store_first_match"))


@query
def log_target_roundtrip(spark, sf):
    """SCL9: log1p target and its expm1 inverse per panel row."""
    p = ctx(spark, sf).panel
    return p.select("id", "d", "sales", r6(F.log1p("sales"), "log_sales"),
                    r6(F.expm1(F.log1p("sales")), "roundtrip"))


@query
def occurrence_label(spark, sf):
    """SCL14: 0/1 demand occurrence."""
    p = ctx(spark, sf).panel
    return p.select("id", "d", "sales", C.occurrence("sales").alias("label"))


@query
def column_ranges_q(spark, sf):
    """AGG17: min / max of every integer column of the joined panel."""
    return column_ranges(footer_scan(spark, folder_of(ctx(spark, sf).joined)))


@query
def narrow_types(spark, sf):
    """DWN1: narrowest strict integer type per column, from one range pass."""
    rng = column_ranges(footer_scan(spark, folder_of(ctx(spark, sf).joined)))
    return rng.withColumn("narrow_type", F.expr(narrow_expr_sql("x")))


# ------------------------------------------------------------------ features


@query
def price_momentum(spark, sf):
    """WIN1: price / price 7 and 28 rows back, 1.0 when missing."""
    f = FT.price_momentum(ctx(spark, sf).series_panel)
    return f.select("id", "d", r6("price_change_w1"), r6("price_change_m1"))


@query
def price_max_ratio(spark, sf):
    """WIN2: price / the series' maximum price."""
    f = FT.price_momentum(ctx(spark, sf).series_panel)
    return f.select("id", "d", r6("price_max_ratio"))


@query
def sales_lags(spark, sf):
    """WIN3/WIN4: sales 28, 35, 42 and 364 rows back."""
    f = FT.sales_lags(ctx(spark, sf).series_panel)
    return f.select("id", "d", *[F.col(f"sales_lag_{k}").cast("double").alias(f"sales_lag_{k}")
                                 for k in FT.SALES_LAGS])


@query
def rolling_stats(spark, sf):
    """WIN5: rolling mean / sample std over 7/14/30/60 rows ending 28 rows back."""
    f = FT.rolling_stats(ctx(spark, sf).series_panel)
    cols = [f"rolling_{s}_{n}" for n in FT.ROLL_WINDOWS for s in ("mean", "std")]
    return f.select("id", "d", *[r6(c) for c in cols])


@query
def event_distance(spark, sf):
    """WIN6/JON3/SET2: days since last / to next event per panel date."""
    return FT.event_days(ctx(spark, sf).panel)


@query
def event_distance_panel(spark, sf):
    """JON3: the distances joined to every panel row by date."""
    f = FT.event_distance(ctx(spark, sf).panel)
    return f.select("id", "d", F.col("days_since_event").cast("int").alias("days_since_event"),
                    F.col("days_to_event").cast("int").alias("days_to_event"))


def _encoded(spark, sf, *keys):
    """The panel's distinct keys, which take the encodings, and the train rows:
    the panel itself is only aggregated, never joined."""
    c = ctx(spark, sf)
    df = FT.add_date_parts(c.panel)
    return df.select(*keys).distinct(), FT.train_rows(df, c.train_end)


@query
def target_encode_item_wday(spark, sf):
    """AGG2: train mean sales per (item, weekday), item mean fallback, then 0."""
    keys, train = _encoded(spark, sf, "item_id", "wday")
    enc = FT.target_encode(keys, None, ["item_id", "wday"], "item_wday_mean", "quantity",
                           fallback_keys=["item_id"], train=train)
    return enc.select("item_id", "wday", r6("item_wday_mean"))


@query
def target_encode_dept_wday(spark, sf):
    """AGG3: train occurrence rate per (department, weekday), 0 when missing."""
    keys, train = _encoded(spark, sf, "dept_id", "wday")
    enc = FT.target_encode(keys, None, ["dept_id", "wday"], "dept_wday_mean", "occurrence", train=train)
    return enc.select("dept_id", "wday", r6("dept_wday_mean"))


@query
def target_encode_item_event(spark, sf):
    """AGG4: train occurrence rate per (item, event); non-event days get 0."""
    keys, train = _encoded(spark, sf, "item_id", "event_name_1")
    enc = FT.target_encode(keys, None, ["item_id", "event_name_1"], "item_event_mean", "occurrence", train=train)
    return enc.select("item_id", "event_name_1", r6("item_event_mean"))


@query
def target_encode_quantity(spark, sf):
    """AGG5: the one-store variant over quantity, run for every store at once.

    Keys carry the store, so each store gets its own (dept, weekday) and
    (item, event) means of sales, as the single-store script computes for one.
    """
    keys, train = _encoded(spark, sf, "store_id", "item_id", "dept_id", "wday", "event_name_1")
    enc = FT.target_encode(keys, None, ["store_id", "dept_id", "wday"], "dept_wday_qty", "quantity", train=train)
    enc = FT.target_encode(enc, None, ["store_id", "item_id", "event_name_1"], "item_event_qty", "quantity",
                           train=train)
    return enc.select("store_id", "item_id", "dept_id", "wday", "event_name_1",
                      r6("dept_wday_qty"), r6("item_event_qty"))


@query
def category_codes(spark, sf):
    """WIN10: per categorical column, value -> rank among sorted distinct values, NULL -> -1."""
    p = ctx(spark, sf).panel
    known = FT.category_dictionaries(p, CATEGORIES)
    absent = p.agg(*[F.max(F.col(c).isNull()).alias(c) for c in CATEGORIES])
    missing = absent.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("some"))
                                                for c in CATEGORIES])).alias("m")).where("m.some")
    return known.unionByName(missing.select("m.column", F.lit(None).cast("string").alias("value"),
                                            F.lit(-1).alias("code")))


@query
def standardize_features(spark, sf):
    """AGG19: per-store z-scores, population std with zero-variance -> 1."""
    c = ctx(spark, sf)
    f = FT.sales_lags(c.panel, [28])
    z = FT.standardize(f, ["sell_price", "sales_lag_28"], by="store_id")
    return z.select("id", "d", r6("sell_price", "sell_price_z"), r6("sales_lag_28", "sales_lag_28_z"))


@query
def standardize_sample(spark, sf):
    """AGG19, second form: sample std + 1e-8, every numeric feature of the
    lookback rows, one scale per store."""
    c = ctx(spark, sf)
    cols = SCALED
    f = P.lookback_split(c.features, c.train_end).where(F.col("split") == "train")
    z = FT.standardize(f, cols, by="store_id", ddof=1, eps=1e-8)
    return z.groupBy("id").agg(*[r3(F.sum(x), f"{x}_z") for x in cols])


def _window_sum(name: str):
    """Sum of one input over a window's rows."""
    return F.aggregate("seq", F.lit(0.0), lambda total, step: total + step[name])


@query
def sequence_features(spark, sf):
    """WIN8 over the model's inputs: every feature of the 28 rows ending at the
    labelled validation row, scaled per store on the train rows (AGG19), as
    sums over the window."""
    c = ctx(spark, sf)
    rows = SQ.scaled_inputs(c.features, c.train_end, SCALED)
    va = rows.where(F.col("d_int") >= c.train_end + 1 - 27)
    seqs = SQ.sequence_windows(va, SCALED)
    return seqs.select("id", "d_int", "label", *[r3(_window_sum(x), f"{x}_sum") for x in SCALED])


def _window_order(name: str):
    """Sum of one input over a window's rows, each times its place from 1."""
    weighed = F.transform("seq", lambda step, i: step[name] * (i + 1))
    return F.aggregate(weighed, F.lit(0.0), lambda total, x: total + x)


@query
def sequence_steps(spark, sf):
    """WIN8 step by step: as ``sequence_features``, every step times its place
    in the window, so that a step out of order shows."""
    c = ctx(spark, sf)
    rows = SQ.scaled_inputs(c.features, c.train_end, SCALED)
    seqs = SQ.sequence_windows(rows.where(F.col("d_int") >= c.train_end + 1 - 27), SCALED)
    return seqs.select("id", "d_int", "label", *[r3(_window_order(x), f"{x}_steps") for x in SCALED])


@query
def sequence_steps_next(spark, sf):
    """WIN9 step by step."""
    c = ctx(spark, sf)
    rows = SQ.scaled_inputs(c.features, c.train_end, SCALED)
    seqs = SQ.sequence_windows_next(rows.where(F.col("d_int") >= c.train_end + 1 - 28), SCALED)
    return seqs.select("id", "d_int", "label", *[r3(_window_order(x), f"{x}_steps") for x in SCALED])


@query
def sequence_features_next(spark, sf):
    """WIN9 over the model's inputs: the 28 rows before the labelled one, with
    28 context days (FLT2)."""
    c = ctx(spark, sf)
    rows = SQ.scaled_inputs(c.features, c.train_end, SCALED)
    va = rows.where(F.col("d_int") >= c.train_end + 1 - 28)
    seqs = SQ.sequence_windows_next(va, SCALED)
    return seqs.select("id", "d_int", "label", *[r3(_window_sum(x), f"{x}_sum") for x in SCALED])


@query
def sequence_windows(spark, sf):
    """WIN8: 28-row windows ending at the labelled row, never crossing series."""
    p = ctx(spark, sf).panel
    seqs = SQ.sequence_windows(p, ["sales"])
    return seqs.select("id", "d_int", "label",
                       F.array_join(F.transform("seq", lambda s: s["sales"].cast("int").cast("string")), ",")
                       .alias("sales_seq"))


@query
def sequence_windows_next(spark, sf):
    """WIN9: 28 days before the labelled day on the dense grid (next-step label)."""
    g = FT.with_day_index(ctx(spark, sf).sales_long)
    seqs = SQ.sequence_windows_next(g, ["sales"])
    return seqs.select("id", "d_int", "label",
                       F.array_join(F.transform("seq", lambda s: s["sales"].cast("int").cast("string")), ",")
                       .alias("sales_seq"))


# ------------------------------------------------------- forecasts / metrics


@query
def hurdle_stat(spark, sf):
    """MOD4 twin: weekday occurrence rate x mean positive sale per series."""
    q = ctx(spark, sf).quantity_preds
    return q.where(F.col("model_id") == "hurdle_stat").select("id", "d", r6("pred"))


@query
def model_rmse(spark, sf):
    """AGG6/AGG8/MOD10: RMSE per (store, model) over the long prediction table."""
    return ctx(spark, sf).model_rmse.select("store_id", "model_id", r6("rmse"))


@query
def rmse_global(spark, sf):
    """AGG6: one RMSE over all validation rows."""
    return M.rmse(ctx(spark, sf).ensemble).select(r6("rmse"))


@query
def validation_counts(spark, sf):
    """AGG18: rows, stores and sold rows of the validation days."""
    c = ctx(spark, sf)
    return M.validation_counts(E.validation_rows(c.features, c.train_end, c.horizon))


@query
def ensemble_weights_past(spark, sf):
    """ENS1 with weights from other rows than it is scored on (B4): fitted on
    the first validation fortnight, scored on the second."""
    c = ctx(spark, sf)
    q = c.quantity_preds.withColumn("d_int", C.day_index("d"))
    first, second = q.where(F.col("d_int") <= c.train_end + 14), q.where(F.col("d_int") > c.train_end + 14)
    w = E.ensemble_weights(M.rmse(first, "sales", "pred", ["store_id", "model_id"]))
    return E.weighted_ensemble(second, w).select("id", "d", r6("simple_avg_pred"))


@query
def threshold_choice_past(spark, sf):
    """ENS4/ENS5 with the cut chosen on other rows than it is scored on (B5)."""
    c = ctx(spark, sf)
    s = c.scored.withColumn("d_int", C.day_index("d"))
    best = E.best_threshold(E.threshold_sweep(s.where(F.col("d_int") <= c.train_end + 14)))
    m = E.final_metrics(s.where(F.col("d_int") > c.train_end + 14), best.select("optimal_threshold").scalar())
    return m.select("tp", "fp", "fn", "tn", r6("f1"), "optimal_threshold")


@query
def price_max_ratio_causal(spark, sf):
    """WIN2 with the running maximum instead of the whole series' (B7)."""
    f = FT.price_momentum(ctx(spark, sf).series_panel, causal=True)
    return f.select("id", "d", r6("price_max_ratio"))


@query
def standardize_train_fit(spark, sf):
    """AGG19 with the scales of the train rows only (B6)."""
    c = ctx(spark, sf)
    z = FT.standardize(c.features, ["sell_price", "sales_lag_28"], by="store_id",
                       fit_rows=FT.train_rows(c.features, c.train_end))
    return z.select("id", "d", r6("sell_price", "sell_price_z"), r6("sales_lag_28", "sales_lag_28_z"))


def _scaled_sums(z: DataFrame) -> DataFrame:
    """Per series the sum of every scaled feature, and one that weighs the days
    apart, so that a value on the wrong day shows."""
    day = F.col("d_int") % 97
    return z.groupBy("id").agg(*[r3(F.sum(x), f"{x}_z") for x in SCALED], *[r3(F.sum(F.col(x) * day), f"{x}_zd") for x in SCALED])


@query
def standardize_all_population(spark, sf):
    """AGG19, population form, on every scaled feature: per store over all rows."""
    c = ctx(spark, sf)
    return _scaled_sums(FT.standardize(c.features, SCALED, by="store_id"))


@query
def standardize_all_train_fit(spark, sf):
    """AGG19, population form, on every scaled feature with the train rows' scales (B6)."""
    c = ctx(spark, sf)
    return _scaled_sums(FT.standardize(c.features, SCALED, by="store_id", fit_rows=FT.train_rows(c.features, c.train_end)))


@query
def narrowed_features(spark, sf):
    """DWN1/SNK1: the feature table cast to its narrowest types, written as
    Parquet, read again; per column its type and how many values it has."""
    c = ctx(spark, sf)
    path = new_path(spark, "narrowed")
    FS.write_parquet(narrow_cast(c.features.drop("occ_rate_28")).hint("rebalance", "store_id"), path)
    back = FS.read_parquet(spark, path)
    counts = back.agg(*[F.count(x).alias(x) for x in back.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"),
                                         F.lit(f.dataType.simpleString()).alias("type"),
                                         F.col(f.name).alias("n_values")) for f in back.schema.fields]))
    return counts.select(pairs.alias("p")).select("p.column", "p.type", "p.n_values")


@query
def files_round_trip(spark, sf):
    """SRC1/SRC2/SNK2: calendar, prices and the submission template as CSV,
    read by their schemas and joined to the panel: daily sales and sum of prices,
    and the template's row count."""
    c = ctx(spark, sf)
    root = new_path(spark, "files")
    cal = c.calendar.select(*[F.col(f.name) if f.name in c.calendar.columns else F.lit(None).cast(f.dataType)
                              .alias(f.name) for f in FS.CALENDAR_SCHEMA.fields])
    FS.write_csv(cal, f"{root}/calendar")
    FS.write_csv(c.prices.select("sell_price", "item_id", "wm_yr_wk", "store_id"), f"{root}/prices")
    FS.write_csv(PB.sample_submission_template(c.sales_long).orderBy("row_pos").select(
        "id", *[F.lit(0.0).alias(f"F{i}") for i in range(1, 29)]), f"{root}/template")
    calendar = FS.read_csv(spark, f"{root}/calendar", FS.CALENDAR_SCHEMA)
    prices = FS.read_csv(spark, f"{root}/prices", FS.PRICES_SCHEMA)
    n = PB.read_template(spark, f"{root}/template").agg(F.count(F.lit(1)).alias("n_template"))
    joined = P.star_join(c.sales_long.drop("d_int"), calendar, prices)
    daily = joined.groupBy("date").agg(F.sum("sales").alias("sales"), F.count("sell_price").alias("n_prices"),
                                       r3(F.sum("sell_price"), "prices"))
    return daily.withColumn("n_template", F.lit(n.first()["n_template"]))


@query
def metrics_json(spark, sf):
    """SNK4: the metrics record written as JSON and read again."""
    c = ctx(spark, sf)
    m = E.final_metrics(c.scored, c.best.select("optimal_threshold").scalar())
    path = new_path(spark, "metrics")
    FS.write_json(FS.metrics_record(m, c.best), path)
    back = spark.read.schema("Accuracy double, Precision double, Recall double, `F1-Score` double, "
                             "Optimal_Threshold double, All_Kill_Success boolean").json(path)
    return back.select(r6("Accuracy"), r6("Precision"), r6("Recall"), r6(F.col("`F1-Score`"), "f1_score"),
                       "Optimal_Threshold", "All_Kill_Success")


@query
def item_comparison(spark, sf):
    """OUT2: one series by date: sold or not, one model's probability, the
    power mean of all."""
    c = ctx(spark, sf)
    single = c.occurrence_probs.where(F.col("model_id") == "series_wday_rate")
    rows = E.validation_rows(c.features, c.train_end, c.horizon)
    o = PB.item_comparison(rows, single, c.scored, OVERLAY_SERIES)
    return o.select("date", "actual_sold", r6("single_prob"), r6("v10_prob"))


@query
def lookback_split_next(spark, sf):
    """FLT2 with 28 days of context, for a next-step label."""
    c = ctx(spark, sf)
    return P.lookback_split(c.panel, c.train_end, context=28).select("id", "d", "split")


@query
def ensemble_weights(spark, sf):
    """ENS1: inverse-RMSE weights normalised per store."""
    return ctx(spark, sf).weights.select("store_id", "model_id", r6("rmse"), r6("weight"))


@query
def weighted_ensemble(spark, sf):
    """ENS1: weighted mean of clipped member forecasts x 0.98."""
    return ctx(spark, sf).ensemble.select("id", "d", "store_id", "sales", r6("simple_avg_pred"))


@query
def rmse_by_store(spark, sf):
    """AGG7/SRT2: RMSE per store (anchored id parse), ascending."""
    return M.rmse_by_store(ctx(spark, sf).ensemble).select("store_id", r6("rmse"))


@query
def rmse_by_store_first_match(spark, sf):
    """AGG7 with the reference's first-match id parse (B1)."""
    return M.rmse_by_store(ctx(spark, sf).ensemble, anchored=False).select("store_id", r6("rmse"))


@query
def rmsse_denominator(spark, sf):
    """AGG10/WIN7: mean squared first difference after leading zeros, train days."""
    c = ctx(spark, sf)
    return M.rmsse_denominator(c.series, c.train_end).select("id", r6("denominator"))


@query
def rmsse_denominator_all_days(spark, sf):
    """AGG10 over every day, validation included (the reference's B2)."""
    c = ctx(spark, sf)
    return M.rmsse_denominator(c.series, None).select("id", r6("denominator"))


@query
def rmsse_by_series(spark, sf):
    """AGG9/JON5/AGG11: per-series RMSSE of the ensemble."""
    c = ctx(spark, sf)
    den = M.rmsse_denominator(c.sales_long, c.train_end)
    return M.rmsse_by_series(c.ensemble, den, c.train_end).select(
        "id", r6("mse"), r6("denominator"), r6("rmsse"))


@query
def rmsse_overall(spark, sf):
    """AGG11: unweighted mean RMSSE."""
    c = ctx(spark, sf)
    den = M.rmsse_denominator(c.sales_long, c.train_end)
    per = M.rmsse_by_series(c.ensemble, den, c.train_end)
    return M.rmsse_overall(per).select(r6("mean_rmsse"), "n_series")


@query
def confusion_matrix(spark, sf):
    """AGG12: sales > 0 vs forecast > 0.5."""
    return M.confusion_matrix(ctx(spark, sf).ensemble)


@query
def classification_metrics(spark, sf):
    """AGG13: accuracy / precision / recall / F1 of forecast > 0.5."""
    e = ctx(spark, sf).ensemble
    df = e.select(C.occurrence("sales").alias("label"),
                  (F.col("simple_avg_pred") > 0.5).cast("int").alias("predicted"))
    m = M.classification_metrics(df)
    return m.select("tp", "fp", "fn", "tn", *[r6(x) for x in ("accuracy", "precision", "recall", "f1")])


@query
def balanced_weights(spark, sf):
    """AGG14: n / (k * n_c) per store and class over train rows."""
    c = ctx(spark, sf)
    tr = FT.train_rows(c.panel, c.train_end).withColumn("label", C.occurrence("sales"))
    return M.balanced_weights(tr).select("store_id", "label", "n_class", "n_group", r6("weight"))


@query
def financial_impact(spark, sf):
    """AGG15: over / under units and their holding / stock-out costs."""
    f = M.financial_impact(ctx(spark, sf).ensemble)
    return f.select(*[r6(x) for x in ("excess_units", "stockout_units", "opex_loss", "pnl_loss", "total_loss")])


@query
def savings_vs_baseline(spark, sf):
    """AGG16: savings of the ensemble over a constant-mean baseline."""
    s = M.savings_vs_baseline(ctx(spark, sf).ensemble)
    return s.select(*[r6(x) for x in s.columns])


@query
def power_mean(spark, sf):
    """ENS2: mean of squared member probabilities per row."""
    return ctx(spark, sf).scored.select("id", "d", "label", r6("score"))


@query
def threshold_sweep(spark, sf):
    """ENS3: metrics at the 161 cuts 0.1..0.9 in one pass."""
    sw = ctx(spark, sf).sweep
    return sw.select("k", "threshold", "tp", "fp", "fn", "tn",
                     *[r6(x) for x in ("accuracy", "precision", "recall", "f1")])


@query
def best_threshold(spark, sf):
    """ENS4: cut beating all four targets with the best F1, else the best F1."""
    return ctx(spark, sf).best


@query
def final_metrics(spark, sf):
    """ENS5: metrics at the chosen cut."""
    c = ctx(spark, sf)
    cut = c.best.select("optimal_threshold").scalar()
    m = E.final_metrics(c.scored, cut)
    return m.select("tp", "fp", "fn", "tn", *[r6(x) for x in ("accuracy", "precision", "recall", "f1")],
                    "optimal_threshold")


# ---------------------------------------------------------------- publish


@query
def horizon_pivot(spark, sf):
    """RSH2/SCL8: validation forecasts as F1..F28 per series."""
    c = ctx(spark, sf)
    piv = R.horizon_pivot(c.ensemble, c.train_end)
    return piv.select("id", *[r6(f"F{i}") for i in range(1, 29)])


@query
def submission_table(spark, sf):
    """OUT1: pivot, both id suffixes, first wins, aligned to the template."""
    c = ctx(spark, sf)
    template = PB.sample_submission_template(c.sales_long)
    sub = PB.submission_table(c.ensemble, template, c.train_end)
    return sub.select("id", *[r6(f"F{i}") for i in range(1, 29)])


@query
def item_overlay(spark, sf):
    """OUT2/FLT3/JON7/SCL15: one series, actual vs ensemble vs a rescaled probability."""
    c = ctx(spark, sf)
    probs = c.occurrence_probs.where(F.col("model_id") == "series_wday_rate")
    o = PB.item_overlay(c.ensemble, c.calendar, OVERLAY_SERIES, probs)
    return o.select("date", "sales", r6("ensemble_pred"), r6("single_model_pred"))


@query
def safety_stock(spark, sf):
    """OUT3/SCL13: int(forecast * 3 * 1.15) per forecast row."""
    s = PB.safety_stock_rows(ctx(spark, sf).ensemble)
    return s.select("id", "d", r6("forecast"), "safety_stock")


@query
def forecast_head(spark, sf):
    """LIM1: the first five forecasts by (id, d)."""
    h = PB.forecast_head(ctx(spark, sf).ensemble)
    return h.select("id", "d", r6("forecast"))


@query
def forecast_sample(spark, sf):
    """SMP1: 200 forecasts chosen by a seeded hash, rounded to 2."""
    return PB.forecast_sample(ctx(spark, sf).ensemble)


def queries() -> dict[str, Query]:
    out = dict(REGISTRY)
    out["column_ranges"] = out.pop("column_ranges_q")
    return out
