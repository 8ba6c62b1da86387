"""Kernel features against a loop over windows; a planted shape is learnt."""

import numpy as np
from pyspark.sql import functions as F

from shelfcast.operators import kernels as K
from shelfcast.operators import newton as N


def looped(x, kernels, length):
    out = []
    for end in range(length, len(x) + 1):
        w, row = x[end - length:end], []
        for dilation, weights, bias in kernels:
            r = np.array([sum(w[t + j * dilation] @ weights[j] for j in range(K.TAPS)) + bias
                          for t in range(length - (K.TAPS - 1) * dilation)])
            row += [*r.max(0), *(r > 0).mean(0)]
        out.append([*row, *w[-1]])
    return np.array(out)


def series(spark, n_series=4, n=70, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"s{s}", 3 * t, float(rng.normal()), None if (s + t) % 13 == 0 else float(rng.normal()), s % 2)
            for s in range(n_series) for t in range(n - s)]
    return spark.createDataFrame(rows, "id string, d_int int, a double, b double, label int")


def test_windows_of_all_chunks(spark, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", 20)
    df = series(spark).cache()
    got = {(r["id"], r["d_int"]): r["kernel"] for r in K.kernel_features(df, ["a", "b"], ["label"], 18, 7, 3).collect()}
    kernels = K.random_kernels(2, 7, 3)
    for s in range(4):
        rows = sorted((r for r in df.collect() if r["id"] == f"s{s}"), key=lambda r: r["d_int"])
        want = looped(np.array([[r["a"], r["b"] or 0.0] for r in rows]), kernels, 18)
        have = np.array([got.pop((r["id"], r["d_int"])) for r in rows[17:]])
        assert have.shape == want.shape and np.allclose(have, want)
    assert not got


def test_short_and_empty_series(spark):
    df = series(spark, 2, 17)
    assert K.kernel_features(df, ["a"], [], 18).count() == 0
    assert K.kernel_features(df.limit(0), ["a"], [], 18).count() == 0


def test_a_planted_shape_is_learnt(spark):
    """Sold if a short rise lies anywhere in the window: no single day tells."""
    rng = np.random.default_rng(5)
    rows = []
    for s in range(40):
        x = rng.normal(size=120) * 0.4
        for t in rng.choice(110, 2, replace=False):
            x[t:t + 5] += [-2, -1, 0, 1, 2]
        bumps = np.array([sum(x[max(0, t - 4):t + 1] @ [-2, -1, 0, 1, 2] > 7 for t in range(max(4, e - 23), e + 1)) > 0
                          for e in range(120)])
        rows += [(f"s{s}", t, float(x[t]), int(bumps[t])) for t in range(120)]
    df = spark.createDataFrame(rows, "id string, d_int int, x double, label int")
    made = K.kernel_features(df, ["x"], ["label"], 28, 60)
    one = F.lit("all")
    made = made.select(one.alias("store"), "id", "d_int", "label", *[F.col("kernel")[i].alias(f"k{i}") for i in range(120)])
    names, is_train = [f"k{i}" for i in range(120)], F.pmod(F.xxhash64("id"), F.lit(4)) > 0
    made = made.cache()
    pack = lambda rows: N.vectors(rows, "store", names, F.col("label"), F.lit(1.0), ["label"], "kernel-test")
    prob = N.predict(pack(made.where(~is_train)), N.fit(pack(made.where(is_train)), 1.0), ["label"]).collect()
    p, y = np.array([r["prob"] for r in prob]), np.array([r["label"] for r in prob])
    ranks = np.argsort(np.argsort(p))
    auc = (ranks[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (1 - y).sum())
    assert 0.1 < y.mean() < 0.9 and auc > 0.85
