"""Result tables: submission, one-series overlay, forecast head / sample,
safety-stock rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.columns import occurrence
from shelfcast.functions.columns import safety_stock as safety_stock_expr
from shelfcast.functions.columns import to_validation_id
from shelfcast.operators.reshape import horizon_pivot

SAMPLE_SIZE = 200
SAMPLE_SEED = 42
HEAD_ROWS = 5
OVERLAY_SCALE = 1.5  # the overlay draws a probability rescaled by 1.5


def submission_table(preds: DataFrame, template: DataFrame, train_end,
                     horizon: int = 28, value_col: str = "simple_avg_pred") -> DataFrame:
    """Kaggle-style submission aligned to a template (OUT1).

    Pivot the validation horizon to ``F1..F28`` (RSH2), copy it under the
    ``_validation`` suffix (SCL6) ahead of the original rows (SET1), keep the
    first row per id (SET3: validation copy wins), then left join from the
    template so the output has exactly its ids, missing ones as 0, in the
    template's ``row_pos`` order (JON6).
    """
    piv = horizon_pivot(preds, train_end, horizon, value_col)
    f_cols = [f"F{i}" for i in range(1, horizon + 1)]
    both = (piv.select(to_validation_id("id").alias("id"), *f_cols, F.lit(0).alias("prio"))
            .unionByName(piv.withColumn("prio", F.lit(1))))
    first = (both.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("prio")))
             .where(F.col("rn") == 1).drop("rn", "prio"))
    return (template.select("id", "row_pos").join(first, "id", "left")
            .fillna(0.0, subset=f_cols)
            .orderBy("row_pos").select("id", *f_cols))


def item_overlay(preds: DataFrame, calendar: DataFrame, series_id: str,
                 probs: DataFrame | None = None, value_col: str = "simple_avg_pred",
                 scale: float = OVERLAY_SCALE) -> DataFrame:
    """One series: actual vs forecast by date, plus a rescaled probability (OUT2).

    FLT3 on the series key (pushed to the scan side of the plan), a
    broadcast calendar lookup for dates (JON7), a left join of a second
    model's probability on date, ``prob * 1.5`` (SCL15), ordered by date.
    """
    one = preds.where(F.col("id") == series_id)
    dated = one.join(F.broadcast(calendar.select("d", "date")), "d", "left")
    out = dated.select("date", "sales", F.col(value_col).alias("ensemble_pred"))
    if probs is not None:
        p = (probs.where(F.col("id") == series_id)
             .join(F.broadcast(calendar.select("d", "date")), "d", "left")
             .select("date", (F.col("prob") * F.lit(scale)).alias("single_model_pred")))
        out = out.join(p, "date", "left")
    return out.orderBy("date")


def item_comparison(panel_rows: DataFrame, single: DataFrame, ensemble: DataFrame, series_id: str) -> DataFrame:
    """One series by date: ``date, actual_sold, single_prob, v10_prob`` (OUT2).

    ``panel_rows`` has ``id, d, date, sales``; ``single`` one model's ``prob``
    and ``ensemble`` the power-mean ``score``, both keyed ``(id, d)``.
    """
    one = panel_rows.where(F.col("id") == series_id).select("d", "date", occurrence("sales").alias("actual_sold"))
    a = single.where(F.col("id") == series_id).select("d", F.col("prob").alias("single_prob"))
    b = ensemble.where(F.col("id") == series_id).select("d", F.col("score").alias("v10_prob"))
    return (one.join(a, "d", "left").join(b, "d", "left")
            .select("date", "actual_sold", "single_prob", "v10_prob").orderBy("date"))


def forecast_head(preds: DataFrame, n: int = HEAD_ROWS, key=("id", "d"),
                  value_col: str = "simple_avg_pred") -> DataFrame:
    """First ``n`` forecasts by an explicit key (LIM1): a top-k, not a sort."""
    return preds.orderBy(*key).limit(n).select("id", "d", F.col(value_col).alias("forecast"))


def forecast_sample(preds: DataFrame, n: int = SAMPLE_SIZE, seed: int = SAMPLE_SEED,
                    value_col: str = "simple_avg_pred") -> DataFrame:
    """Repeatable sample of exactly ``n`` rows, forecast rounded to 2 (SMP1).

    Rows are ranked by a seeded digest of their key, so the sample does not
    depend on partitioning; ``limit`` after the ordering is a distributed top-k.
    """
    h = F.md5(F.concat_ws("|", "id", "d", F.lit(str(seed))).cast("binary"))
    return (preds.orderBy(h, "id", "d").limit(n)
            .select(F.col("id").alias("item"), F.round(F.col(value_col), 2).alias("forecast")))


def safety_stock_rows(forecasts: DataFrame, value_col: str = "simple_avg_pred",
                      lead_days: int = 3, buffer: float = 1.15) -> DataFrame:
    """One row per forecast: ``int(forecast * lead * buffer)`` units (OUT3/SCL13)."""
    return forecasts.select("id", "d", F.col(value_col).alias("forecast"),
                            safety_stock_expr(value_col, lead_days, buffer).alias("safety_stock"))


def sample_submission_template(series_ids: DataFrame) -> DataFrame:
    """Stand-in template: every id under both suffixes, validation block first.

    ``row_pos`` is an increasing position in (block, id) order: a distributed
    range sort, then ``monotonically_increasing_id`` (increasing across the
    sorted partitions), so no single task numbers all rows.
    """
    ev = series_ids.select("id").distinct()
    both = (ev.select(to_validation_id("id").alias("id"), F.lit(0).alias("block"))
            .unionByName(ev.select("id", F.lit(1).alias("block"))))
    return both.orderBy("block", "id").withColumn("row_pos", F.monotonically_increasing_id())


def read_template(spark, path: str) -> DataFrame:
    """A submission template file with its file order kept as ``row_pos``."""
    from shelfcast.sources.files import TEMPLATE_SCHEMA, read_csv
    return read_csv(spark, path, TEMPLATE_SCHEMA).select(
        "id", F.monotonically_increasing_id().alias("row_pos"))
