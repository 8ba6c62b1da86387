"""Distributed boosting against a sequential one that tries every split by masks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import boosting as B
from shelfcast.operators import models as MD

FEATURES = ["a", "b", "code", "c"]
CODES = ["code"]


def frame(spark, seed=1, n=500):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        store = "S1" if i % 3 else "S2"
        a, b, code = float(rng.integers(0, 30)), float(np.round(rng.normal(), 2)), int(rng.integers(-1, 6))
        mean = np.exp(0.3 * (a > 12) + (code in (1, 4)) * 1.5 - 1.2 * (code == -1) + 0.2 * b) * (2 if store == "S1" else 1)
        rows.append((f"x{i % 25}", f"d_{i}", store, int(rng.poisson(mean)), a, b if i % 17 else None, code, 1.0))
    return spark.createDataFrame(rows, "id string, d string, store_id string, sales int, a double, b double, code int, c double")


def binned(binner, store, rows):
    x = []
    for f in FEATURES:
        v = [r[f] for r in rows]
        if f in CODES:
            x.append([0 if c is None else c + 1 for c in v])
        else:
            x.append([int(np.sum(binner.edges[store][f] < (0.0 if q is None else q))) for q in v])
    return np.array(x)


def sequential(binner, fit, store, rows, apart, rate, depth, min_leaf):
    """Scores of ``rows``, fitted on those that are not ``apart``, one split at a time."""
    x, y = binned(binner, store, rows), np.array([r["sales"] for r in rows], float)
    t = {"raw": y, "log1p": np.log1p(y), "occurrence": (y > 0) * 1.0}[fit.target]
    w = np.ones(len(y))
    if fit.positive_only:
        w = (y > 0) * 1.0
    if fit.balanced:
        w = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y <= 0).sum()))
    mean = 0.5 if fit.balanced else t[w > 0].mean()
    start = {"squared": mean, "poisson": np.log(mean), "log": np.log(mean / max(1 - mean, 1e-6)),
             "absolute": np.sort(t[w > 0])[(int((w > 0).sum()) - 1) // 2]}[fit.loss]
    score, losses = np.full(len(y), start), []
    used = (w > 0) & ~apart

    def part(rows_in, level):
        """[(rows of a leaf, fitted rows of it)]"""
        r, c = B.gradients(fit.loss, t, score)
        inside = rows_in & used
        best, found = 1e-12, None
        sums = lambda m: ((r * w)[m].sum(), (c * w)[m].sum(), m.sum())
        g, h, _ = sums(inside)
        for f, name in enumerate(FEATURES):
            if name not in fit.features:
                continue
            if name in CODES:
                def ratio(v):
                    a = sums(inside & (x[f] == v))
                    return -a[0] / (a[1] + B.CATEGORY_SMOOTHING)
                order = sorted(range(binner.bins), key=ratio)
            else:
                order = list(range(binner.bins))
            for cut in range(1, binner.bins):
                goes = np.isin(x[f], order[:cut])
                gl, hl, nl = sums(inside & goes)
                gr, hr, nr = sums(inside & ~goes)
                if min(nl, nr) < min_leaf or min(hl, hr) < B.MIN_CURVATURE:
                    continue
                gain = gl ** 2 / (hl + fit.l2) + gr ** 2 / (hr + fit.l2) - g ** 2 / (h + fit.l2)
                if gain > best * (1 + 1e-9):
                    best, found = gain, goes
        if level == depth:
            return [rows_in]
        if found is None:
            return [rows_in]
        return part(rows_in & found, level + 1) + part(rows_in & ~found, level + 1)

    for _ in range(fit.rounds):
        if fit.holdout_seed is not None:
            m = apart & (w > 0)
            losses.append((B.row_losses(fit.loss, t, score) * w)[m].sum() / w[m].sum())
            if B._no_longer_falls(losses):
                break
        r, c = B.gradients(fit.loss, t, score)
        after = score.copy()
        for leaf in part(np.ones(len(y), bool), 0):
            m = leaf & used
            if not m.any():
                continue
            if fit.loss == "absolute":
                order = np.argsort((t - score)[m])
                value = (t - score)[m][order][np.searchsorted(np.cumsum(w[m][order]), w[m].sum() / 2)]
            else:
                value = (r * w)[m].sum() / ((c * w)[m].sum() + fit.l2)
            after[leaf] += rate * value
        score = after
    return {"poisson": np.exp(score), "log": 1 / (1 + np.exp(-score))}.get(fit.loss, score)


def test_every_loss_matches_a_sequential_fit(spark):
    df = frame(spark).cache()
    every, some = tuple(FEATURES), ("b", "code", "c")
    fits = [B.Fit("squared", "squared", "log1p", every, 3), B.Fit("poisson", "poisson", "raw", every, 4),
            B.Fit("poisson_some", "poisson", "raw", some, 3), B.Fit("absolute", "absolute", "log1p", every, 3),
            B.Fit("log", "log", "occurrence", every, 3, l2=0.1, balanced=True),
            B.Fit("held", "log", "occurrence", every, 12, l2=0.1, balanced=True, holdout_seed=42),
            B.Fit("sold", "poisson", "raw", every, 3, positive_only=True)]
    out, booster = B.boosted(df, df, fits, FEATURES, CODES, 0.3, depth=3, min_leaf=15, bins=16, block_rows=60)
    hashes = {(r["id"], r["d"]): r["h"] for r in df.select("id", "d", F.xxhash64("id", "d").alias("h")).collect()}
    got = {(r["fit"], r["id"], r["d"]): r["value"] for r in out.collect()}
    rows = df.collect()
    assert len(got) == len(rows) * len(fits)
    for store in ("S1", "S2"):
        mine = [r for r in rows if r["store_id"] == store]
        h = np.array([hashes[r["id"], r["d"]] for r in mine])
        for fit in fits:
            apart = B.held(h, fit.holdout_seed) if fit.holdout_seed is not None else np.zeros(len(mine), bool)
            want = sequential(booster.binner, fit, store, mine, apart, 0.3, 3, 15)
            have = np.array([got[fit.name, r["id"], r["d"]] for r in mine])
            assert np.allclose(have, want, rtol=1e-6, atol=1e-5), (fit.name, store)


def test_blocks_and_restarts_change_nothing(spark, monkeypatch):
    df = frame(spark, 2).cache()
    fits = [B.Fit("poisson", "poisson", "raw", tuple(FEATURES), 7)]
    whole = {(r["id"], r["d"]): r["value"] for r in B.boosted(df, df, fits, FEATURES, CODES, 0.2, 3)[0].collect()}
    monkeypatch.setattr(B, "WRITE_EVERY", 2)
    parts = B.boosted(df.repartition(7), df, fits, FEATURES, CODES, 0.2, 3, block_rows=40)[0].collect()
    assert len(parts) == len(whole) and all(abs(r["value"] - whole[r["id"], r["d"]]) < 1e-9 for r in parts)


def test_trees_part_sets_of_categories(spark):
    """Sales follow no order of the codes: one split by sets finds it, one by order does not."""
    df = spark.range(800).select(
        F.concat(F.lit("x"), F.col("id")).alias("id"), F.lit("d_1").alias("d"), F.lit("S").alias("store_id"),
        (F.col("id") % 8).cast("int").alias("code"), F.when((F.col("id") % 8).isin(0, 3, 4, 7), 9).otherwise(1).alias("sales"))
    fit = [B.Fit("squared", "squared", "raw", ("code",), 1)]
    spread = lambda codes: B.boosted(df, df, fit, ["code"], codes, 1.0, depth=1)[0].agg(
        F.max(F.abs(F.col("value") - F.col("sales")))).first()[0]
    assert spread(["code"]) < 1e-9
    assert spread([]) > 1


def test_poisson_trees_beat_the_linear_model(spark):
    """Where sales depend on an interaction, their deviance is below the GLM's."""
    from pyspark.ml.regression import GeneralizedLinearRegression
    df = frame(spark, 3, 3000)
    train, val = df.where(F.pmod(F.xxhash64("d"), F.lit(4)) > 0).cache(), df.where(F.pmod(F.xxhash64("d"), F.lit(4)) == 0).cache()
    trees = B.boosted(train, val, [B.Fit("p", "poisson", "raw", tuple(FEATURES), 40)], FEATURES, CODES, 0.1, 3)[0]
    glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol="sales").fit(
        MD.prepare(train, FEATURES)).transform(MD.prepare(val, FEATURES)).select("sales", F.col("prediction").alias("value"))

    def deviance(p):
        y, m = F.col("sales"), F.col("value")
        return p.agg(F.avg(2 * (F.when(y > 0, y * F.log(F.greatest(y, F.lit(1)) / m)).otherwise(0.0) - y + m))).first()[0]
    assert deviance(trees) < 0.9 * deviance(glm)


def test_odd_inputs(spark):
    df = frame(spark, 4, 60)
    fits = [B.Fit("sold", "poisson", "raw", tuple(FEATURES), 2, positive_only=True), B.Fit("log", "log", "occurrence", tuple(FEATURES), 2)]
    never = df.withColumn("sales", F.when(F.col("store_id") == "S2", 0).otherwise(F.col("sales")))
    out = B.boosted(never, df, fits, FEATURES, CODES, 0.1, 3, min_leaf=5)[0]
    found = {(r["store_id"], r["fit"]): r["n"] for r in out.groupBy("store_id", "fit").agg(F.count("value").alias("n")).collect()}
    assert found == {("S1", "sold"): 40, ("S1", "log"): 40, ("S2", "log"): 20}
    empty = B.boosted(df.limit(0), df, fits, FEATURES, CODES, 0.1, 3)[0]
    assert empty.count() == 0
    assert B.boosted(df, df.limit(0), fits, FEATURES, CODES, 0.1, 3)[0].count() == 0
    with pytest.raises(ValueError):
        B.boosted(df.withColumn("code", F.lit(99)), df, fits, FEATURES, CODES, 0.1, 3)


def test_grid_members_share_their_fits(spark):
    df = frame(spark, 5, 200).withColumns({f: F.lit(0.0) for f in MD.feature_set("all")}).withColumns(
        {"sell_price": F.col("a"), "dept_id": F.col("code")})
    grid = [MD.ModelConfig("poisson", "no_lags", 7), MD.ModelConfig("poisson", "no_lags", 42),
            MD.ModelConfig("squared_error", "all", 2, True)]
    small = MD.ROUNDS
    try:
        MD.ROUNDS = 2
        out = MD.fit_grid(df, df, grid, depth=2)
    finally:
        MD.ROUNDS = small
    assert out.groupBy("id", "d").count().where("count != 3").count() == 0
    two = out.where("model_id like 'poisson%'").groupBy("id", "d").agg((F.max("pred") - F.min("pred")).alias("gap"))
    assert two.agg(F.max("gap")).first()[0] == 0 and out.where("pred < 0 or pred is null").count() == 0


def test_sums_in_reduce_tasks_and_on_the_driver_agree(spark, monkeypatch):
    df = frame(spark, 6).cache()
    fits = [B.Fit("absolute", "absolute", "log1p", tuple(FEATURES), 3),
            B.Fit("held", "log", "occurrence", tuple(FEATURES), 3, balanced=True, holdout_seed=7)]
    fitted = lambda: {(r["fit"], r["id"], r["d"]): r["value"] for r in B.boosted(
        df, df, fits, FEATURES, CODES, 0.2, 3, block_rows=40)[0].collect()}
    on_driver = fitted()
    monkeypatch.setattr(B, "DRIVER_BYTES", 0)
    in_tasks = fitted()
    assert len(on_driver) == 1000 and in_tasks.keys() == on_driver.keys()
    assert all(abs(in_tasks[k] - v) < 1e-9 for k, v in on_driver.items())


def test_levels_are_not_planned(spark, monkeypatch):
    """Hundreds of level jobs: rows become columns for the predictions only."""
    from pyspark.sql.classic.dataframe import DataFrame
    calls, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *a, **k: calls.append(1) or plain(self, *a, **k))
    df = frame(spark, 7, 60)
    B.boosted(df, df, [B.Fit("squared", "squared", "log1p", tuple(FEATURES), 3)], FEATURES, CODES, 0.2, 2, min_leaf=5)
    assert len(calls) == 1
