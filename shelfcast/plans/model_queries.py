"""MLlib model queries (rows-only checks: model fits have no SQL twin).

Each fits on the training days of the shared feature table (all stores in one
distributed fit, store code as a feature) and returns a long prediction table
over the validation days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators import ensemble as E
from shelfcast.operators import features as FT
from shelfcast.operators import metrics as M
from shelfcast.operators import models as MD
from shelfcast.operators import newton as N
from shelfcast.operators import sequences as SQ
from shelfcast.operators.ensemble import validation_rows
from shelfcast.plans.context import ctx
from shelfcast.session import materialize, new_path

REGISTRY: dict = {}

CATEGORIES = MD.CATEGORIES
#: All model inputs: categories as codes, numeric ones scaled; no same-day sales.
SEQ_FEATURES = MD.SEQ_FEATURES
sequence_inputs = MD.sequence_inputs


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def _coded(spark: SparkSession, sf: str):
    c = ctx(spark, sf)
    train = c.coded.where(F.col("d_int") <= c.train_end)
    val = validation_rows(c.coded, c.train_end, c.horizon)
    return c, train, val


def _member(spark: SparkSession, sf: str, objective: str, features: str, seed: int, hurdle: bool = False) -> DataFrame:
    """One model of the grid, from its own fits."""
    return (ctx(spark, sf).fitted_members([MD.ModelConfig(objective, features, seed, hurdle)])
            .select("id", "d", "sales", "model_id", "pred", "store_id"))


def _weights(train: DataFrame) -> DataFrame:
    return M.balanced_weights(train.withColumn("label", (F.col("sales") > 0).cast("int")))


@query
def gbt_forecast(spark, sf):
    """MOD2: boosted regression on log1p(sales), squared loss, all features, a model per store."""
    return _member(spark, sf, "squared_error", "all", 42)


@query
def gbt_forecast_absolute(spark, sf):
    """MOD2: boosted regression on log1p(sales), absolute loss, no lag features."""
    return _member(spark, sf, "absolute_error", "no_lags", 7)


@query
def poisson_trees(spark, sf):
    """MOD3: boosted trees with Poisson loss on raw sales, a model per store."""
    return _member(spark, sf, "poisson", "all", 99)


@query
def hurdle_poisson(spark, sf):
    """MOD4: P(sales > 0) from boosted trees x Poisson trees of the sold rows."""
    return _member(spark, sf, "poisson", "all", 1, True)


@query
def poisson_forecast(spark, sf):
    """MOD3: Poisson GLM (log link) on raw sales."""
    _, tr, va = _coded(spark, sf)
    return MD.gbt_quantity(tr, va, MD.ModelConfig("poisson", "all", 99))


@query
def hurdle_forecast(spark, sf):
    """MOD4: P(sales > 0) from boosted trees x squared-loss trees of the sold rows."""
    return _member(spark, sf, "squared_error", "all", 2, True)


@query
def gbt_occurrence(spark, sf):
    """MOD5: class-weighted boosted classifier of each store, stopped early by a 10 % holdout."""
    return ctx(spark, sf).fitted_occurrence.where("model_id = 'hist_42'")


@query
def rf_occurrence(spark, sf):
    """MOD6: class-weighted random forest, 30 trees of depth 10."""
    _, tr, va = _coded(spark, sf)
    return MD.occurrence_model(tr, va, "rf", _weights(tr), seed=42, features=FT.OCCURRENCE_FEATURES)


@query
def lr_occurrence(spark, sf):
    """MOD7: class-weighted L2 logistic regression on per-store standardised features."""
    _, tr, va = _coded(spark, sf)
    return MD.occurrence_model(tr, va, "lr", _weights(tr), seed=42, features=FT.OCCURRENCE_FEATURES)


@query
def fitted_ensemble_checks(spark, sf):
    """MOD1-MOD4 + MOD9 + ENS1 over the whole fitted grid, 50 models of every
    store: per store the number of models and rows, rows of wrong value, keys
    that lack a model, the sum of weights, and whether every ensemble value is
    the weighted mean of its members."""
    preds = ctx(spark, sf).fitted_grid
    weights = E.ensemble_weights(M.rmse(preds, "sales", "pred", ["store_id", "model_id"]))
    ens = E.weighted_ensemble(preds, weights).select("id", "d", "simple_avg_pred")
    again = (preds.join(weights.select("store_id", "model_id", "weight"), ["store_id", "model_id"])
             .groupBy("id", "d").agg(F.sum(F.col("weight") * F.col("pred")).alias("mean")))
    ok = ens.join(again, ["id", "d"]).join(preds.select("id", "d", "store_id").distinct(), ["id", "d"])
    ok = ok.groupBy("store_id").agg(F.every(F.abs(F.col("simple_avg_pred") - E.SHRINK * F.col("mean"))
                                            <= 1e-9 * (1 + F.abs("mean"))).alias("is_mean"))
    sums = weights.groupBy("store_id").agg(F.round(F.sum("weight"), 6).alias("weight_sum"))
    rows = preds.groupBy("store_id").agg(F.count_distinct("model_id").alias("n_models"),
                                         F.count(F.lit(1)).alias("n_rows"),
                                         F.count_if(~(F.coalesce("pred", F.lit(-1.0)) >= 0)
                                                    | (F.col("pred") == float("inf"))).alias("n_wrong"))
    whole = (preds.groupBy("store_id", "id", "d").agg(F.count_distinct("model_id").alias("n"))
             .groupBy("store_id").agg(F.count_if(F.col("n") != len(MD.model_grid())).alias("n_lacking")))
    rows = rows.join(whole, "store_id")
    return rows.join(sums, "store_id").join(ok, "store_id")


@query
def committed_results(spark, sf):
    """SNK3: the candidate forecasts written store by store with a manifest; the
    run stops after two stores, the next one makes the others.  Per store and
    model the committed rows, their sum, and whether the manifest agrees."""
    from shelfcast.sources.committed import StoreResults, resume
    preds = ctx(spark, sf).quantity_preds.select("id", "d", "sales", "pred", "store_id", "model_id")
    results = StoreResults(spark, new_path(spark, "committed"))
    stores = [r[0] for r in preds.select("store_id").distinct().sort("store_id").collect()]
    members = [r[0] for r in preds.select("model_id").distinct().sort("model_id").collect()]

    def make(some, models):
        return preds.where(F.col("store_id").isin(some) & F.col("model_id").isin(models))

    resume(results, stores[:2], members, make)
    resume(results, stores, members, make)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in preds.schema.fields)
    found = results.read(schema).groupBy("store_id", "model_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("pred"), 3).alias("pred_sum"))
    said = results.manifest().select("store_id", "model_id", F.col("n_rows").alias("said"))
    return found.join(said, ["store_id", "model_id"]).withColumn("agrees", F.col("said") == F.col("n_rows")).drop("said")


@query
def occurrence_chain_checks(spark, sf):
    """MOD5 + MOD8 + MOD10 + ENS2-ENS5 over the fitted members, three boosted
    classifiers and the sequence model: the sweep's counts add up to the
    validation rows at each cut, every probability lies in 0..1, and the final
    counts do too."""
    probs = ctx(spark, sf).fitted_occurrence
    scored = E.power_mean(probs)
    sweep = E.threshold_sweep(scored)
    final = E.final_metrics(scored, E.best_threshold(sweep).select("optimal_threshold").scalar())
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    a = sweep.agg(F.count(F.lit(1)).alias("n_cuts"), F.min(total).alias("least"), F.max(total).alias("most"))
    b = probs.agg(F.count_distinct("model_id").alias("n_models"),
                  F.sum((~F.col("prob").between(0, 1)).cast("int")).cast("bigint").alias("n_outside"))
    one = F.lit(1).alias("one")
    return (a.select("*", one).join(b.select("*", one), "one")
            .join(final.select(total.alias("final_rows"), one), "one").drop("one"))


@query
def seq_occurrence(spark, sf):
    """MOD8 (re-aimed): random dilated convolutions over 28-day windows of all
    inputs (WIN8 + FLT2), scaled per store by the train rows (AGG19), and a
    class-weighted logistic regression of each store on what they find."""
    return ctx(spark, sf).fitted_occurrence.where("model_id = 'kernels_42'")


@query
def store_logistic(spark, sf):
    """MOD7 + MOD9: class-weighted logistic regression of every store by grouped
    Newton steps, inputs scaled per store by its train rows; per store the
    validation rows, and the weighted share of sold days it sees in the train
    rows, which class weights make one half at the optimum."""
    c, tr, va = _coded(spark, sf)
    rows, beta = MD.store_logistic(tr, va, _weights(tr))
    seen = N.predict(rows.where("is_train"), beta, ["w"]).groupBy("grp").agg(
        F.round(F.sum(F.col("w") * F.col("prob")) / F.sum("w"), 4).alias("weighted_share"))
    out = N.predict(rows.where("not is_train"), beta, ["id", "d"])
    counts = out.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.count_if(F.col("prob").between(0, 1)).alias("n_probabilities"))
    return counts.join(seen, "grp").withColumnRenamed("grp", "store_id")


@query
def occurrence_ensemble(spark, sf):
    """MOD10 + ENS2: the three boosted classifiers and the sequence model, power-averaged by key."""
    return E.power_mean(ctx(spark, sf).fitted_occurrence)


@query
def fitted_metrics(spark, sf):
    """MOD10 + ENS2-ENS5 + SNK4 over the fitted occurrence members: the sweep's
    chosen cut, the final metrics and the success flag, as the JSON record is
    read back; with the counts they must agree with."""
    from shelfcast.sources import files as SF
    c = ctx(spark, sf)
    scored = materialize(E.power_mean(c.fitted_occurrence), "fitted-scores")
    best = materialize(E.best_threshold(E.threshold_sweep(scored)), "fitted-best")
    final = E.final_metrics(scored, best.select("optimal_threshold").scalar())
    path = new_path(spark, "fitted-metrics")
    SF.write_json(SF.metrics_record(final, best), path)
    record = spark.read.json(path)
    named = [F.col(f"`{n}`").between(0, 1) for n in ("Accuracy", "Precision", "Recall", "F1-Score")]
    whole = final.select((F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_rows"), F.lit(1).alias("one"))
    return record.select(F.lit(1).alias("one"), (named[0] & named[1] & named[2] & named[3]).alias("in_range"),
                         F.col("Optimal_Threshold").between(0.1, 0.9).alias("cut_in_range")).join(whole, "one").drop("one")


def queries() -> dict:
    return dict(REGISTRY)
