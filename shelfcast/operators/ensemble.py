"""Ensemble operators over long prediction tables keyed ``(id, d, model_id)``.

Model outputs are aligned by key, never by row position (B9).  Weights,
power means and the threshold sweep are aggregates with map-side partials;
the only globally ordered tables are fixed-size (stores x models, 162 bins).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.columns import clip0, day_index, occurrence
from shelfcast.operators.features import recent_occurrence
from shelfcast.operators.metrics import confusion_counts, metric_columns
from shelfcast.session import small_side

# Fixed values of the ensemble rules.
WEIGHT_EPS = 1e-6
SHRINK = 0.98
POWER = 2.0
# Targets a cut must strictly beat on all four metrics.
TARGET_ACCURACY = 0.6720
TARGET_PRECISION = 0.6510
TARGET_RECALL = 0.5840
TARGET_F1 = 0.6160
DEFAULT_CUT = 0.5


def threshold_grid(lo: float = 0.1, hi: float = 0.9, n: int = 161) -> list[float]:
    """The scanned cuts, bit-identical to ``numpy.linspace(lo, hi, n)``."""
    return [float(x) for x in np.linspace(lo, hi, n)]


# ---------------------------------------------------------------- quantity


def ensemble_weights(model_rmse: DataFrame, group: str = "store_id",
                     eps: float = WEIGHT_EPS) -> DataFrame:
    """``w = 1/(rmse + eps)`` normalised to sum 1 per store (ENS1).

    Input is the (store, model) RMSE table: stores x models rows.
    """
    raw = 1.0 / (F.col("rmse") + F.lit(eps))
    return (model_rmse.withColumn("raw_w", raw)
            .withColumn("weight", F.col("raw_w") / F.sum("raw_w").over(Window.partitionBy(group)))
            .drop("raw_w"))


def weighted_ensemble(preds: DataFrame, weights: DataFrame, shrink: float = SHRINK,
                      group: str = "store_id", out: str = "simple_avg_pred") -> DataFrame:
    """Weighted mean of clipped model predictions per row, times ``shrink`` (ENS1).

    The weight table is stores x models rows; the row-level mean is a grouped
    sum on ``(id, d)`` with partial aggregation before the shuffle.
    """
    w = small_side(weights.select(group, "model_id", "weight"), "weights")
    return (preds.join(w, [group, "model_id"], "inner")
            .groupBy("id", "d", group)
            .agg(F.first("sales").alias("sales"),
                 (F.sum(F.col("weight") * clip0("pred")) / F.sum("weight") * F.lit(shrink)).alias(out)))


# -------------------------------------------------------------- occurrence


def power_mean(probs: DataFrame, power: float = POWER, out: str = "score") -> DataFrame:
    """Mean over models of ``p ** power``, no root (ENS2)."""
    return (probs.groupBy("id", "d")
            .agg(F.first("label").alias("label"),
                 F.avg(F.pow("prob", F.lit(power))).alias(out)))


def below_all_cuts(score: str) -> Column:
    """The score, with NULL and NaN below every cut: such rows count as negative."""
    lowest = F.lit(float("-inf"))
    return F.coalesce(F.nanvl(F.col(score).cast("double"), lowest), lowest)


def _bin_counts(scored: DataFrame, cuts: list[float], score: str, label: str) -> DataFrame:
    """Label counts per bin, bin = number of cuts <= score (binary search)."""
    splits = [float("-inf")] + list(cuts) + [float("inf")]
    binned = Bucketizer(splits=splits, inputCol=score, outputCol="bin",
                        handleInvalid="keep").transform(
                            scored.select(below_all_cuts(score).alias(score), label))
    return (binned.groupBy("bin")
            .agg(F.sum(F.col(label)).cast("bigint").alias("pos"),
                 F.sum(1 - F.col(label)).cast("bigint").alias("neg")))


def threshold_sweep(scored: DataFrame, cuts: list[float] | None = None,
                    score: str = "score", label: str = "label") -> DataFrame:
    """Confusion counts and metrics at every cut, ``predicted = score >= cut`` (ENS3).

    One pass over the scored rows: each score falls in the bin of cuts below
    it, counts aggregate per bin (at most 162 rows), and reverse running sums
    over the bins give the counts at every cut, exactly as one pass per cut
    would.
    """
    cuts = cuts or threshold_grid()
    spark = scored.sparkSession
    counts = _bin_counts(scored, cuts, score, label)
    cut_tbl = spark.createDataFrame([(k, t) for k, t in enumerate(cuts)], "k int, threshold double")
    # Bins 0..len(cuts); a score >= cut k lies in a bin > k.
    bins = spark.range(len(cuts) + 1).select(F.col("id").cast("double").alias("bin"))
    full = bins.join(counts, "bin", "left").fillna(0, subset=["pos", "neg"])
    desc = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    totals = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cum = full.select(
        (F.col("bin") - 1).cast("int").alias("k"),
        F.sum("pos").over(desc).alias("tp"), F.sum("neg").over(desc).alias("fp"),
        F.sum("pos").over(totals).alias("p_all"), F.sum("neg").over(totals).alias("n_all"))
    swept = (cut_tbl.join(cum, "k", "inner")
             .select("k", "threshold", "tp", "fp",
                     (F.col("p_all") - F.col("tp")).alias("fn"),
                     (F.col("n_all") - F.col("fp")).alias("tn")))
    return swept.withColumns(metric_columns()).orderBy("k")


def best_threshold(sweep: DataFrame, targets=(TARGET_ACCURACY, TARGET_PRECISION,
                                              TARGET_RECALL, TARGET_F1),
                   default: float = DEFAULT_CUT) -> DataFrame:
    """Choose the cut (ENS4).

    Among cuts strictly beating all four targets: highest F1, lowest cut on
    ties.  Otherwise the highest F1 overall, again the lowest cut on ties; a
    sweep whose F1 is never above 0 keeps ``default``.  161 rows, one window.
    """
    ta, tp_, tr, tf = targets
    beats = ((F.col("accuracy") > ta) & (F.col("precision") > tp_)
             & (F.col("recall") > tr) & (F.col("f1") > tf)).cast("int")
    ranked = sweep.withColumn("beats", beats).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("beats").desc(), F.col("f1").desc(),
                                                   F.col("threshold").asc())))
    top = ranked.where(F.col("rank") == 1)
    return top.select(
        F.when((F.col("beats") == 1) | (F.col("f1") > 0), F.col("threshold"))
        .otherwise(F.lit(default)).alias("optimal_threshold"),
        (F.col("beats") == 1).alias("all_kill_success"))


def final_metrics(scored: DataFrame, cut: Column | float, score: str = "score",
                  label: str = "label") -> DataFrame:
    """Accuracy, precision, recall, F1 at the chosen cut, one pass (ENS5)."""
    c = cut if isinstance(cut, Column) else F.lit(cut)
    predicted = (below_all_cuts(score) >= c).cast("int")
    counts = scored.agg(*confusion_counts(F.col(label), predicted))
    return counts.withColumns(metric_columns()).withColumn("optimal_threshold", c)


# ------------------------------------------------ statistical candidates


def validation_rows(df: DataFrame, train_end, horizon: int = 28) -> DataFrame:
    t = train_end if isinstance(train_end, Column) else F.lit(train_end)
    d = F.col("d_int") if "d_int" in df.columns else day_index("d")
    return df.where((d > t) & (d <= t + horizon))


def quantity_candidates(features: DataFrame, train_end, horizon: int = 28) -> DataFrame:
    """Long table ``id, d, store_id, sales, model_id, pred`` of closed-form forecasts.

    Exact, SQL-checkable members for the weighted ensemble: last-season naive
    (lag 28), 30-row rolling mean at base lag 28, item x weekday mean, and a
    per-series hurdle (weekday occurrence rate x mean positive sale).
    """
    t = train_end if isinstance(train_end, Column) else F.lit(train_end)
    train = features.where(F.col("d_int") <= t)
    occ = (train.groupBy("id", "wday")
           .agg(F.avg(occurrence("sales").cast("double")).alias("p_occ")))
    pos = (train.where(F.col("sales") > 0).groupBy("id")
           .agg(F.avg(F.col("sales").cast("double")).alias("mean_pos")))
    val = (validation_rows(features, t, horizon)
           .join(small_side(occ, "occ-by-day"), ["id", "wday"], "left")
           .join(small_side(pos, "mean-positive"), "id", "left"))
    models = {
        "naive_lag28": F.col("sales_lag_28").cast("double"),
        "rolling_mean_30": F.col("rolling_mean_30"),
        "item_wday_mean": F.col("item_wday_mean"),
        "hurdle_stat": F.col("p_occ") * F.col("mean_pos"),
    }
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("model_id"),
                                         F.coalesce(v, F.lit(0.0)).alias("pred"))
                                for k, v in models.items()]))
    return (val.select("id", "d", "store_id", "sales", stack.alias("m"))
            .select("id", "d", "store_id", "sales", "m.model_id", clip0("m.pred").alias("pred")))


def occurrence_candidates(features: DataFrame, train_end, horizon: int = 28) -> DataFrame:
    """Long table ``id, d, store_id, label, model_id, prob`` of occurrence scores.

    Series x weekday rate, department x weekday rate, item x event rate, and
    the 28-row occurrence rate at base lag 28 (all train-only statistics or
    past rows).
    """
    t = train_end if isinstance(train_end, Column) else F.lit(train_end)
    train = features.where(F.col("d_int") <= t)
    occ = (train.groupBy("id", "wday")
           .agg(F.avg(occurrence("sales").cast("double")).alias("p_series_wday")))
    feats = features if "occ_rate_28" in features.columns else recent_occurrence(features)
    val = validation_rows(feats, t, horizon).join(small_side(occ, "occ-by-day"), ["id", "wday"], "left")
    models = {
        "series_wday_rate": F.col("p_series_wday"),
        "dept_wday_rate": F.col("dept_wday_mean"),
        "item_event_rate": F.col("item_event_mean"),
        "recent_rate": F.col("occ_rate_28"),
    }
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("model_id"),
                                         F.coalesce(v, F.lit(0.0)).alias("prob"))
                                for k, v in models.items()]))
    return (val.select("id", "d", "store_id", occurrence("sales").alias("label"), stack.alias("m"))
            .select("id", "d", "store_id", "label", "m.model_id", "m.prob"))
