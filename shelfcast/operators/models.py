"""MLlib fits that produce long prediction tables keyed ``(id, d, model_id)``.

Each fit is one distributed MLlib job over all stores, with the store code as
a feature (MOD9), instead of a driver loop of per-store fits.  Features are
filled with 0 before assembly, as the reference does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.columns import clip0, occurrence
from shelfcast.operators.boosting import Fit, boosted
from shelfcast.operators import newton
from shelfcast.operators.features import (CATEGORICAL, OCCURRENCE_FEATURES, category_codes, feature_set,
                                          standardize)
from shelfcast.operators.kernels import kernel_features
from shelfcast.operators.metrics import balanced_weights
from shelfcast.operators.sequences import scaled_inputs
from shelfcast.session import materialize, small_side

# Fixed values of the reference's model grid.
CATEGORIES = ["item_id", "dept_id", "cat_id", "event_name_1", "event_type_1"]
SEQ_FEATURES = OCCURRENCE_FEATURES
LOSSES = ["squared_error", "poisson", "absolute_error"]
SEEDS = [42, 7, 99, 123, 2023, 777, 888, 111]
FEATURE_SETS = ["all", "no_lags"]
ROUNDS = 70
LEARNING_RATE = 0.08
OCC_ROUNDS = 100
OCC_L2 = 0.1
OCC_SEEDS = [42, 43, 44]
OCC_HOLDOUT = 0.1
RF_TREES = 30
RF_DEPTH = 10


@dataclass(frozen=True)
class ModelConfig:
    objective: str
    feature_set: str
    seed: int
    is_hurdle: bool = False

    @property
    def model_id(self) -> str:
        tag = "hurdle_" if self.is_hurdle else ""
        return f"{tag}{self.objective}_{self.feature_set}_{self.seed}"


def model_grid() -> list[ModelConfig]:
    """3 losses x 2 feature sets x 8 seeds + 2 hurdle configs = 50 (MOD1)."""
    grid = [ModelConfig(o, f, s) for o in LOSSES for f in FEATURE_SETS for s in SEEDS]
    grid += [ModelConfig("poisson", "all", 1, True), ModelConfig("squared_error", "all", 2, True)]
    return grid


def model_features(df: DataFrame, names: list[str]) -> list[str]:
    """Feature names plus the store code (one fit for all stores)."""
    return [n for n in names if n in df.columns] + (["store_code"] if "store_code" in df.columns else [])


def prepare(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    filled = df.fillna(0, subset=features)
    cast = filled.withColumns({c: F.col(c).cast("double") for c in features})
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(cast)


def with_categories(df: DataFrame, names: list[str], sizes: dict[str, int]) -> DataFrame:
    """Code columns as nominal attributes, so that trees part them as sets; a
    missing category (code -1) is category 0."""
    out = {}
    for c in names:
        meta = {"ml_attr": {"type": "nominal", "name": c, "vals": [str(i) for i in range(sizes[c])]}}
        code = F.coalesce(F.col(c).cast("int"), F.lit(-1)) + 1
        out[c] = F.least(F.greatest(code, F.lit(0)), F.lit(sizes[c] - 1)).cast("double").alias(c, metadata=meta)
    return df.select(*[out.get(c, F.col(c)) for c in df.columns])


def category_sizes(train: DataFrame, val: DataFrame, names: list[str]) -> dict[str, int]:
    """Categories of each code column, the missing one included, by one aggregate."""
    both = train.select(*names).union(val.select(*names))
    r = both.agg(*[F.max(F.coalesce(F.col(c).cast("int"), F.lit(-1))).alias(c) for c in names]).first()
    return {c: max(2, (-1 if r[c] is None else r[c]) + 2) for c in names}


def _p1(col: str = "probability") -> Column:
    return vector_to_array(F.col(col)).getItem(1)


def _long(scored: DataFrame, model_id: str, value: Column, name: str, truth: str) -> DataFrame:
    truth_col = F.col("sales") if truth == "sales" else occurrence("sales").alias("label")
    return scored.select("id", "d", "store_id", truth_col, F.lit(model_id).alias("model_id"),
                         value.alias(name))


def gbt_quantity(train: DataFrame, val: DataFrame, cfg: ModelConfig,
                 rounds: int = ROUNDS, lr: float = LEARNING_RATE, max_depth: int = 5) -> DataFrame:
    """Boosted or Poisson regression forecast, optionally a hurdle (MOD2-MOD4).

    squared / absolute loss fit ``log1p(sales)`` and predict ``expm1``;
    Poisson is a GLM with log link on raw sales (MLlib trees have no Poisson
    loss).  A hurdle multiplies P(sales > 0) from a boosted classifier by the
    regression fitted on positive rows only.  Predictions are clipped at 0.
    """
    feats = model_features(train, feature_set(cfg.feature_set))
    tr = prepare(train, feats)
    va = prepare(val, feats)
    use_log = cfg.objective in ("squared_error", "absolute_error")
    tr = tr.withColumn("target", F.log1p("sales") if use_log else F.col("sales").cast("double"))

    def regressor():
        if cfg.objective == "poisson":
            return GeneralizedLinearRegression(family="poisson", link="log", maxIter=25,
                                               regParam=1e-3, labelCol="target")
        loss = "squared" if cfg.objective == "squared_error" else "absolute"
        return GBTRegressor(lossType=loss, maxIter=rounds, stepSize=lr, maxDepth=max_depth,
                            seed=cfg.seed, labelCol="target")

    if cfg.is_hurdle:
        clf = GBTClassifier(maxIter=rounds, stepSize=lr, maxDepth=max_depth, seed=cfg.seed,
                            labelCol="occ").fit(tr.withColumn("occ", occurrence("sales").cast("double")))
        reg = regressor().fit(tr.where(F.col("sales") > 0))
        scored = reg.transform(clf.transform(va).withColumnRenamed("prediction", "occ_pred")
                               .withColumnRenamed("probability", "occ_prob")
                               .drop("rawPrediction"))
        qty = F.expm1("prediction") if use_log else F.col("prediction")
        pred = qty * _p1("occ_prob")
    else:
        scored = regressor().fit(tr).transform(va)
        pred = F.expm1("prediction") if use_log else F.col("prediction")
    return _long(scored, cfg.model_id, clip0(pred), "pred", "sales")


def grid_fits(grid: list[ModelConfig]) -> dict[tuple, list[Fit]]:
    """The boosted fits behind each distinct objective, feature set and hurdle
    flag of a grid: one, or a classifier and a regression of the sold rows.

    Without row or feature sampling a fit does not depend on its seed, so one
    stands for all seeds of the grid."""
    out: dict[tuple, list[Fit]] = {}
    for g in grid:
        features = tuple(feature_set(g.feature_set))
        target = "raw" if g.objective == "poisson" else "log1p"
        loss = {"squared_error": "squared", "absolute_error": "absolute"}.get(g.objective, g.objective)
        if g.is_hurdle:
            pair = [Fit(f"sold_{g.feature_set}", "log", "occurrence", features, ROUNDS),
                    Fit(f"amount_{g.objective}_{g.feature_set}", loss, target, features, ROUNDS, positive_only=True)]
        else:
            pair = [Fit(f"{g.objective}_{g.feature_set}", loss, target, features, ROUNDS)]
        out[g.objective, g.feature_set, g.is_hurdle] = pair
    return out


def distinct_fits(grid: list[ModelConfig]) -> list[Fit]:
    """The boosted fits that a grid takes, each once."""
    return list({f.name: f for pair in grid_fits(grid).values() for f in pair}.values())


def grow_fits(train: DataFrame, val: DataFrame, fits: list[Fit], depth: int = 5) -> DataFrame:
    """``id, d, store_id, sales, fit, value`` of all ``fits``, which grow
    together, each store with its own models (MOD9), over one table of binned
    rows; categories part as sets of codes.  Squared and absolute loss predict
    ``expm1`` of their log target.  What a fit predicts does not depend on the
    others."""
    features = [f for f in feature_set("all") if any(f in fit.features for fit in fits)]
    fitted, _ = boosted(train, val, fits, features, [c for c in CATEGORICAL if c in features], LEARNING_RATE, depth)
    logs = [f.name for f in fits if f.target == "log1p"]
    value = F.when(F.col("fit").isin(logs), F.expm1("value")).otherwise(F.col("value"))
    return fitted.select("id", "d", "store_id", F.col("sales").cast("int").alias("sales"), "fit", value.alias("value"))


def fit_grid(train: DataFrame, val: DataFrame, grid: list[ModelConfig] | None = None, depth: int = 5) -> DataFrame:
    """Predictions of every config of the grid, by ``(id, d, model_id)`` (MOD1-MOD4)."""
    grid = model_grid() if grid is None else grid
    return grid_members(grow_fits(train, val, distinct_fits(grid), depth), grid)


def grid_members(fitted: DataFrame, grid: list[ModelConfig]) -> DataFrame:
    """The configs' predictions from those of their fits.  A hurdle is
    P(sales > 0) times the regression on sold rows; a store that never sold
    anything has probability 0 and so forecasts 0.  Predictions are clipped at 0.
    """
    out = None
    for key, pair in grid_fits(grid).items():
        names = F.array(*[F.lit(g.model_id) for g in grid if (g.objective, g.feature_set, g.is_hurdle) == key])
        one = fitted.where(F.col("fit") == pair[-1].name).drop("fit")
        if len(pair) == 2:
            sold = fitted.where(F.col("fit") == pair[0].name).select("id", "d", "store_id", "sales", F.col("value").alias("sold"))
            one = (sold.join(one.drop("sales", "store_id"), ["id", "d"], "left")
                   .withColumn("value", F.col("sold") * F.coalesce(F.col("value"), F.lit(0.0))))
        one = one.select("id", "d", "store_id", "sales", F.explode(names).alias("model_id"), clip0(F.col("value")).alias("pred"))
        out = one if out is None else out.unionByName(one)
    return out


def _with_weights(train: DataFrame, weights: DataFrame) -> DataFrame:
    """Attach the balanced class weight of each row's (store, label) (AGG14)."""
    w = weights.select("store_id", F.col("label").alias("occ"), "weight")
    return train.withColumn("occ", occurrence("sales")).join(
        small_side(w, "class-weights"), ["store_id", "occ"], "left")


def occurrence_model(train: DataFrame, val: DataFrame, kind: str, weights: DataFrame,
                     seed: int = 42, features: list[str] | None = None,
                     rounds: int = OCC_ROUNDS, reg_param: float = 1e-4) -> DataFrame:
    """Demand-occurrence probability (MOD5-MOD7), class-balanced weights.

    Trees part the categorical codes as sets, a missing one included.
    ``gbt``: boosted trees with a seeded 10 % early-stopping holdout;
    ``rf``: 30 trees of depth 10; ``lr``: L2 logistic regression on features
    standardised per store (train statistics); ``reg_param`` plays the role
    of ``1 / (C * n)`` in the reference's ``C``-parametrised penalty.
    """
    feats = model_features(train, features or feature_set("all", None))
    nominal = [c for c in CATEGORICAL if c in feats] if kind in ("gbt", "rf") else []
    sizes = category_sizes(train, val, nominal) if nominal else {}
    bins = max([32, *sizes.values()])
    if nominal:
        train, val = (with_categories(df, nominal, sizes) for df in (train, val))
    tr = prepare(_with_weights(train, weights).withColumn("occ", F.col("occ").cast("double")), feats)
    va = prepare(val, feats)
    if kind == "gbt":
        # By a hash of the key, so that it does not depend on partitioning.
        place = F.pmod(F.xxhash64("id", "d", F.lit(seed)), F.lit(1000))
        tr = tr.withColumn("is_holdout", place < int(1000 * OCC_HOLDOUT))
        est = GBTClassifier(maxIter=rounds, stepSize=LEARNING_RATE, seed=seed, labelCol="occ",
                            weightCol="weight", validationIndicatorCol="is_holdout", maxBins=bins)
    elif kind == "rf":
        est = RandomForestClassifier(numTrees=RF_TREES, maxDepth=RF_DEPTH, seed=seed,
                                     labelCol="occ", weightCol="weight", maxBins=bins)
    elif kind == "lr":
        from shelfcast.operators.features import standardize
        tr_s = standardize(train, feats, fit_rows=train)
        va_s = standardize(val, feats, fit_rows=train)
        tr = prepare(_with_weights(tr_s, weights).withColumn("occ", F.col("occ").cast("double")), feats)
        va = prepare(va_s, feats)
        est = LogisticRegression(maxIter=150, regParam=reg_param, elasticNetParam=0.0,
                                 labelCol="occ", weightCol="weight")
    else:
        raise ValueError(kind)
    scored = est.fit(tr).transform(va)
    return _long(scored, f"{kind}_{seed}", _p1(), "prob", "label")


def occurrence_fits() -> list[Fit]:
    """The three boosted classifiers; the seed draws the early-stopping rows (MOD5, MOD10)."""
    return [Fit(f"hist_{s}", "log", "occurrence", tuple(OCCURRENCE_FEATURES), OCC_ROUNDS, l2=OCC_L2, balanced=True,
                holdout_seed=s) for s in OCC_SEEDS]


def boosted_occurrence(train: DataFrame, val: DataFrame) -> DataFrame:
    """``id, d, store_id, label, model_id, prob`` of the three classifiers of every store."""
    fitted, _ = boosted(train, val, occurrence_fits(), OCCURRENCE_FEATURES, CATEGORICAL, LEARNING_RATE)
    return fitted.select("id", "d", "store_id", occurrence("sales").alias("label"),
                         F.col("fit").alias("model_id"), F.col("value").alias("prob"))


def store_logistic(train: DataFrame, val: DataFrame, weights: DataFrame, l2: float = 1.0,
                   features: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Rows of both frames as vectors (``is_train`` tells them apart), scaled per
    store by its train rows, and each store's coefficients (MOD7, MOD9).
    ``l2`` is 1 / C of the reference's penalty."""
    feats = features or list(OCCURRENCE_FEATURES)
    both = train.withColumn("is_train", F.lit(True)).unionByName(val.withColumn("is_train", F.lit(False)))
    rows = _with_weights(standardize(both, feats, fit_rows=train), weights)
    written = newton.vectors(rows, "store_id", feats, F.col("occ"), F.coalesce("weight", F.lit(0.0)),
                             ["id", "d", "is_train"], "logistic-vectors")
    return written, newton.fit(written.where("is_train"), l2)


def sequence_inputs(features: DataFrame, train_end: int) -> DataFrame:
    """The sequence model's input rows: category codes, scaled numbers."""
    coded = category_codes(features, CATEGORIES)
    scaled = [f for f in SEQ_FEATURES if f not in CATEGORIES and not f.startswith("snap_")]
    return scaled_inputs(coded, train_end, scaled).fillna(0, subset=SEQ_FEATURES)


def kernel_occurrence(features: DataFrame, train_end: int, seed: int = 42, n_kernels: int = 60, l2: float = 1.0) -> DataFrame:
    """Probabilities of the validation rows by convolutions over their 28-day
    windows and a class-weighted logistic regression per store (MOD8)."""
    src = sequence_inputs(features, train_end)
    made = materialize(kernel_features(src, SEQ_FEATURES, ["d", "store_id", "sales"], 28, n_kernels, seed), "kernels")
    names = [f"kernel_{i}" for i in range(2 * n_kernels + len(SEQ_FEATURES))]
    wide = made.select("id", "d", "d_int", "store_id", "sales", *[F.col("kernel")[i].alias(n) for i, n in enumerate(names)])
    train, val = wide.where(F.col("d_int") <= train_end), wide.where(F.col("d_int") > train_end)
    weights = balanced_weights(train.withColumn("label", occurrence("sales")))
    rows, beta = store_logistic(train, val, weights, l2, names)
    scored = newton.predict(rows.where("not is_train"), beta, ["id", "d", "y"])
    return scored.select("id", "d", F.col("grp").alias("store_id"), F.col("y").cast("int").alias("label"),
                         F.lit(f"kernels_{seed}").alias("model_id"), "prob")


def sequence_model(train_seqs: DataFrame, val_seqs: DataFrame, n_features: int,
                   seq_len: int = 28, hidden: int = 32, seed: int = 42,
                   max_iter: int = 50) -> DataFrame:
    """Occurrence classifier over flattened 28-step windows (MOD8, re-aimed).

    Input tables carry ``id, d, store_id, sales, seq_flat``.
    """
    def vec(df):
        return df.withColumn("features", array_to_vector("seq_flat")) \
                 .withColumn("occ", occurrence("sales").cast("double"))
    mlp = MultilayerPerceptronClassifier(layers=[n_features * seq_len, hidden, 2], seed=seed,
                                         maxIter=max_iter, labelCol="occ", blockSize=1024)
    scored = mlp.fit(vec(train_seqs)).transform(vec(val_seqs))
    return _long(scored, f"mlp_{seed}", _p1(), "prob", "label")


def with_store_code(df: DataFrame) -> DataFrame:
    """Store as a numeric feature: its rank among sorted store ids."""
    from shelfcast.operators.features import category_dictionary
    dic = category_dictionary(df, "store_id").withColumnRenamed("value", "store_id") \
        .withColumnRenamed("code", "store_code")
    return df.join(small_side(dic, "stores"), "store_id", "left")


__all__ = ["ModelConfig", "model_grid", "gbt_quantity", "occurrence_model", "sequence_model",
           "with_store_code"]
