"""Error and business metrics.  Each is one aggregate pass (map-side partials,
then a small merge), so a hot store or series never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.columns import day_index, occurrence, store_from_id

# Unit costs of forecast error.
HOLDING_COST_PER_UNIT = 0.50   # over-forecast unit (excess stock)
STOCKOUT_COST_PER_UNIT = 5.00  # under-forecast unit (lost sale)
OCCURRENCE_CUT = 0.5           # predicted non-zero when forecast > 0.5


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rmse(df: DataFrame, y="sales", p="simple_avg_pred", by: list[str] | None = None,
         name: str = "rmse") -> DataFrame:
    """``sqrt(mean((y - p)^2))``, global or per group (AGG6/AGG8)."""
    e = F.sqrt(F.avg(F.pow(_c(y) - _c(p), 2))).alias(name)
    return df.groupBy(*by).agg(e) if by else df.agg(e)


def rmse_by_store(preds: DataFrame, anchored: bool = True, y="sales",
                  p="simple_avg_pred") -> DataFrame:
    """RMSE per store parsed from the series id, ascending (AGG7/SRT2).

    ``anchored=False`` groups by the reference's first regex match (B1).
    """
    return (rmse(preds.withColumn("store_id", store_from_id("id", anchored)), y, p, ["store_id"])
            .orderBy("rmse", "store_id"))


def rmsse_denominator(long: DataFrame, train_end=None, key: str = "id") -> DataFrame:
    """Per series: mean squared first difference after the leading zeros (AGG10/WIN7).

    1.0 when the series never sells, has fewer than 2 active days or all
    differences are 0 (B16).  ``train_end=None`` uses every day, as the
    reference does (B2); otherwise days ``<= train_end`` only.
    """
    df = long.withColumn("d_int", day_index("d")) if "d_int" not in long.columns else long
    within = F.lit(True)
    if train_end is not None:
        within = F.col("d_int") <= (train_end if isinstance(train_end, Column) else F.lit(train_end))
    # One scan and one window: a difference counts from the day after the
    # first sale on, that is where an earlier row of the series has sold.
    ordered = Window.partitionBy(key).orderBy("d_int")
    sold = F.max(F.when(F.col("sales") > 0, 1)).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    diffs = df.select(key, F.when(within & (sold == 1), F.col("sales") - F.lag("sales").over(ordered)).alias("diff"))
    msd = F.avg(F.pow("diff", 2))
    return diffs.groupBy(key).agg(F.when(msd > 0, msd).otherwise(F.lit(1.0)).alias("denominator"))


def validation_counts(validation: DataFrame, by: str = "store_id") -> DataFrame:
    """Rows, distinct groups and sold rows of the validation days (AGG18)."""
    return validation.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(by).alias("n_stores"),
                          F.sum(occurrence("sales")).cast("bigint").alias("n_sold"))


def rmsse_by_series(preds: DataFrame, denominators: DataFrame, train_end,
                    horizon: int = 28, y="sales", p="simple_avg_pred") -> DataFrame:
    """``sqrt(mse / denominator)`` per series over validation days (AGG9/JON5/AGG11).

    A series without a denominator keeps a NULL score (B17).
    """
    t = train_end if isinstance(train_end, Column) else F.lit(train_end)
    d_int = day_index("d")
    mse = (preds.where((d_int > t) & (d_int <= t + horizon))
           .groupBy("id").agg(F.avg(F.pow(_c(y) - _c(p), 2)).alias("mse")))
    return (mse.join(denominators, "id", "left")
            .withColumn("rmsse", F.sqrt(F.col("mse") / F.col("denominator"))))


def rmsse_overall(per_series: DataFrame) -> DataFrame:
    """Unweighted mean RMSSE over series; NULL scores are skipped (AGG11, B3)."""
    return per_series.agg(F.avg("rmsse").alias("mean_rmsse"),
                          F.count("rmsse").alias("n_series"))


def confusion_matrix(df: DataFrame, y="sales", p="simple_avg_pred",
                     cut: float = OCCURRENCE_CUT) -> DataFrame:
    """2x2 counts of ``y > 0`` vs ``p > cut`` (strict), all four cells (AGG12)."""
    a = occurrence(_c(y))
    b = (_c(p) > cut).cast("int")
    cells = [(i, j) for i in (0, 1) for j in (0, 1)]
    agg = df.agg(*[F.sum(F.when((a == i) & (b == j), 1).otherwise(0)).cast("bigint").alias(f"c{i}{j}")
                   for i, j in cells])
    stack = ", ".join(f"{i}, {j}, c{i}{j}" for i, j in cells)
    return agg.selectExpr(f"stack(4, {stack}) as (actual, predicted, n)")


def confusion_counts(label: Column, predicted: Column) -> list[Column]:
    return [
        F.sum(F.when((label == 1) & (predicted == 1), 1).otherwise(0)).cast("bigint").alias("tp"),
        F.sum(F.when((label == 0) & (predicted == 1), 1).otherwise(0)).cast("bigint").alias("fp"),
        F.sum(F.when((label == 1) & (predicted == 0), 1).otherwise(0)).cast("bigint").alias("fn"),
        F.sum(F.when((label == 0) & (predicted == 0), 1).otherwise(0)).cast("bigint").alias("tn"),
    ]


def metric_columns(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, Column]:
    """Accuracy, precision (0 with no predicted positives), recall, F1 (AGG13)."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in (tp, fp, fn, tn))
    zero = F.lit(0.0)
    return {
        "accuracy": F.coalesce(F.try_divide(tp + tn, tp + fp + fn + tn), zero),
        "precision": F.coalesce(F.try_divide(tp, tp + fp), zero),
        "recall": F.coalesce(F.try_divide(tp, tp + fn), zero),
        "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero),
    }


def classification_metrics(df: DataFrame, label="label", predicted="predicted") -> DataFrame:
    """One row: tp, fp, fn, tn and the four metrics."""
    counts = df.agg(*confusion_counts(_c(label), _c(predicted)))
    return counts.withColumns(metric_columns())


def balanced_weights(df: DataFrame, by: str = "store_id", label: str = "label") -> DataFrame:
    """Balanced class weight ``n / (k * n_c)`` per group (AGG14).

    ``k`` = classes present in the group.  The count table is groups x 2 rows.
    """
    counts = df.groupBy(by, label).agg(F.count(F.lit(1)).alias("n_class"))
    g = Window.partitionBy(by)
    return (counts.withColumn("n_group", F.sum("n_class").over(g))
            .withColumn("k", F.count(F.lit(1)).over(g))
            .withColumn("weight", F.col("n_group") / (F.col("k") * F.col("n_class")))
            .drop("k"))


def financial_impact(df: DataFrame, y="sales", p="simple_avg_pred",
                     holding: float = HOLDING_COST_PER_UNIT,
                     stockout: float = STOCKOUT_COST_PER_UNIT) -> DataFrame:
    """Units over / under forecast and their costs (AGG15)."""
    over = F.sum(F.greatest(_c(p) - _c(y), F.lit(0.0)))
    under = F.sum(F.greatest(_c(y) - _c(p), F.lit(0.0)))
    return df.agg(over.alias("excess_units"), under.alias("stockout_units")).withColumns({
        "opex_loss": F.col("excess_units") * holding,
        "pnl_loss": F.col("stockout_units") * stockout,
    }).withColumn("total_loss", F.col("opex_loss") + F.col("pnl_loss"))


def savings_vs_baseline(df: DataFrame, y="sales", p="simple_avg_pred",
                        baseline: Column | None = None,
                        holding: float = HOLDING_COST_PER_UNIT,
                        stockout: float = STOCKOUT_COST_PER_UNIT) -> DataFrame:
    """Baseline loss minus model loss, three parts (AGG16).

    The baseline forecast defaults to the constant mean of the actuals, a
    scalar subquery; both losses come from one aggregate pass.
    """
    base = baseline if baseline is not None else df.select(F.avg(_c(y))).scalar()
    yy = _c(y).cast("double")
    agg = df.agg(
        F.sum(F.greatest(base - yy, F.lit(0.0))).alias("base_over"),
        F.sum(F.greatest(yy - base, F.lit(0.0))).alias("base_under"),
        F.sum(F.greatest(_c(p) - yy, F.lit(0.0))).alias("model_over"),
        F.sum(F.greatest(yy - _c(p), F.lit(0.0))).alias("model_under"),
    )
    return agg.select(
        ((F.col("base_over") - F.col("model_over")) * holding).alias("opex_savings"),
        ((F.col("base_under") - F.col("model_under")) * stockout).alias("pnl_savings"),
        ((F.col("base_over") - F.col("model_over")) * holding
         + (F.col("base_under") - F.col("model_under")) * stockout).alias("total_savings"),
        (F.col("base_over") * holding + F.col("base_under") * stockout).alias("baseline_loss"),
        (F.col("model_over") * holding + F.col("model_under") * stockout).alias("model_loss"),
    )
