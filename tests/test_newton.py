"""Grouped logistic regression against a solve per group in NumPy."""

import numpy as np
from pyspark.sql import functions as F

from shelfcast.operators import newton as N


def frame(spark, seed=1, n=900):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        g = ["A", "A", "B", "A", "C"][i % 5]
        a, b = float(rng.normal()), float(rng.normal())
        shift = {"A": -1.0, "B": 0.5, "C": 3.0}[g]
        rows.append((g, f"k{i}", int(rng.random() < 1 / (1 + np.exp(-(shift + 1.5 * a - 0.7 * b)))), a,
                     None if i % 11 == 0 else b, 1.0 if i % 2 else 2.5))
    return spark.createDataFrame(rows, "store string, key string, y int, a double, b double, w double")


def rows_of(df, features=("a", "b")):
    return N.vectors(df, "store", list(features), F.col("y"), F.col("w"), ["key"], "newton-test")


def direct(rows, l2, steps=200):
    """Plain Newton in one process, halving steps that do not help."""
    x = np.array([[1.0, r["a"], r["b"] or 0.0] for r in rows])
    y, w = np.array([r["y"] for r in rows], float), np.array([r["w"] for r in rows])
    ridge, b = np.diag([0, l2, l2]), np.zeros(3)
    loss = lambda b: (w * (np.logaddexp(0, x @ b) - y * (x @ b))).sum() + b @ ridge @ b / 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ b)))
        step = -np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (p - y)) + ridge @ b)
        while loss(b + step) > loss(b) + 1e-12 and np.abs(step).max() > 1e-14:
            step /= 2
        b = b + step
    return b


def test_coefficients_of_every_group(spark, monkeypatch):
    df = frame(spark).cache()
    for merge, l2 in ((64, 1.0), (2, 0.05)):
        monkeypatch.setattr(N, "MERGE", merge)
        got = N.fit(rows_of(df.repartition(7)), l2)
        assert set(got) == {"A", "B", "C"}
        for g, b in got.items():
            assert np.allclose(b, direct(df.where(F.col("store") == g).collect(), l2), atol=1e-7), g


def test_predictions_follow_the_coefficients(spark):
    df = frame(spark, 2).cache()
    rows = rows_of(df)
    beta = {"A": np.array([0.1, 0.2, -0.3]), "C": np.array([1.0, 0.0, 2.0])}
    got = {r["key"]: r["prob"] for r in N.predict(rows, beta, ["key"]).collect()}
    want = {r["key"]: 1 / (1 + np.exp(-(beta[r["store"]] @ [1.0, r["a"], r["b"] or 0.0])))
            for r in df.collect() if r["store"] in beta}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_separable_constant_and_empty_groups(spark):
    rows = [("S", f"s{i}", int(i >= 10), float(i), 0.0, 1.0) for i in range(20)]      # separable
    rows += [("O", f"o{i}", 1, float(i), 0.0, 1.0) for i in range(5)]                  # one class only
    df = spark.createDataFrame(rows, frame(spark).schema)
    got = N.fit(rows_of(df), 1.0)
    assert np.allclose(got["S"], direct([r for r in df.collect() if r["store"] == "S"], 1.0), atol=1e-6)
    assert np.isfinite(got["O"]).all()
    prob = {r["key"]: r["prob"] for r in N.predict(rows_of(df), got, ["key"]).collect()}
    assert min(p for k, p in prob.items() if k[0] == "o") > 0.99
    assert N.fit(rows_of(df.limit(0))) == {}
    assert N.predict(rows_of(df.limit(0)), got, ["key"]).count() == 0
