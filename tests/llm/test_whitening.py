"""Whitening against a direct computation in exact fractions and NumPy."""

import math
from collections import Counter

import numpy as np
import pytest

from shelfcast.llm import whitening as W
from shelfcast.llm.queries import op11_weighted_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, digest string, x int, n int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "d", 1, 2) for i, v in vectors], SCHEMA)


def reference(vectors, by_count=False):
    """Integers, distinct list, weights, sums, covariance: one process."""
    xs = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in vectors
          if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    counts = Counter(x for _, x in xs)
    fit = np.array(sorted(counts), dtype=object)
    w = np.array([counts[tuple(x)] if by_count else 1 for x in fit], float)
    c = (fit - np.array([sum(x) for x in (fit * w.astype(int)[:, None]).T]) / w.sum()).astype(float)
    return xs, fit, w, (c * w[:, None]).T @ c / w.sum()


def check(rows, vectors, components=16, by_count=False):
    xs, fit, w, cov = reference(vectors, by_count)
    n, d = fit.shape
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    sums = [int(sum(col)) for col in fit.T]
    deviation = {x: sum((n * v - s) ** 2 for v, s in zip(x, sums)) for _, x in xs}
    k = min(components, d)
    assert Counter((r["vec_id"], r["component"]) for r in rows) == Counter(
        (i, j + 1) for i, _ in xs for j in range(k))
    assert {r["n"] for r in rows} == {n}
    if len({i for i, _ in xs}) == len(xs):
        of = dict(xs)
        z = {}
        for r in rows:
            assert int(r["deviation"]) == deviation[of[r["vec_id"]]]
            assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-8, abs=1e-12)
            z.setdefault(of[r["vec_id"]], {})[r["component"]] = r["whitened"]
        m = np.array([[z[tuple(x)][j + 1] for j in range(k)] for x in fit], float)
        live = np.flatnonzero(~np.isnan(m).any(0))
        m = m[:, live]
        mean = (w @ m) / w.sum()
        error = np.abs(((m - mean) * w[:, None]).T @ (m - mean) / w.sum() - np.eye(len(live))).max()
        assert error < 1e-8
        assert {round(r["identity_error"], 9) for r in rows} == {round(error, 9)}
        # the components are eigenvectors: projecting back gives the covariance's action
        centred = (fit - np.array(sums) / n).astype(float) if not by_count else None
        if centred is not None:
            for j, at in enumerate(live):
                v = centred.T @ m[:, j] / n / math.sqrt(values[at])
                assert np.allclose(cov @ v, values[at] * v, rtol=1e-7, atol=1e-7 * values[0])
    return n


def vectors(seed, rows=300, dims=20):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dims, dims))
    some = (rng.normal(size=(rows // 3, dims)) @ mix).astype(np.float32)
    return [(i, some[i % len(some) if i % 2 else 0].tolist()) for i in range(rows)]


@pytest.mark.parametrize("by_count", [False, True])
def test_matches_direct_computation(spark, by_count):
    data = vectors(1) + [(1000, None), (1001, [None] * 20), (1002, [float("nan")] * 20),
                         (1003, [float("inf")] + [0.0] * 19)]
    out = W.by_component(W.whiten(frame(spark, data).repartition(7), by_count=by_count)).collect()
    check(out, data, by_count=by_count)


def test_fewer_dimensions_than_components(spark):
    data = [(i, v[:3]) for i, v in vectors(2, 60)]
    assert check(W.by_component(W.whiten(frame(spark, data))).collect(), data) > 3


def test_components_without_variance_are_null(spark):
    data = [(0, [1.0, 5.0, 2.0]), (1, [2.0, 5.0, 2.0]), (2, [4.0, 5.0, 2.0])]
    rows = W.by_component(W.whiten(frame(spark, data))).collect()
    check(rows, data)
    assert {r["component"] for r in rows if r["whitened"] is None} == {2, 3}
    same = W.by_component(W.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(4)]))).collect()
    assert len(same) == 8
    assert all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None
               and r["deviation"] == 0 and r["n"] == 1 for r in same)


def test_edge_cases(spark):
    assert W.by_component(W.whiten(frame(spark, []))).count() == 0
    assert W.by_component(W.whiten(frame(spark, [(0, []), (1, None)]))).count() == 0
    data = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (7, [3.0, 1.0]), (7, [0.0, -0.1]), (8, [1.0, 2.0, 3.0]),
            (9, [3e38, 1.0, 0.0]), (10, [0.0, 0.0, 0.0])]
    rows = W.by_component(W.whiten(frame(spark, data))).collect()
    assert Counter(r["vec_id"] for r in rows) == {None: 4, 7: 4, 8: 3, 9: 3, 10: 3}
    assert {(r["vec_id"], r["n"]) for r in rows} == {(None, 3), (7, 3), (8, 3), (9, 3), (10, 3)}


def test_deviations_are_exact_beyond_64_bits():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(999_000, 1_001_000, (50, 6)),
                        rng.integers(-(1 << 60), 1 << 60, (50, 6))]).astype(np.int64)
    for n, part in ((50, x[:50]), (50, x[50:]), (100, x), (10 ** 9, x)):
        sums = [int(v) for v in part.astype(object).sum(0) * (n // len(part))]
        assert W.deviations(part, n, sums) == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in part]


def test_partial_matrices_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(W, "MERGE", 2)
    data = vectors(4, 90, 5)
    df = frame(spark, data)
    fit = W.distinct_vectors(df, "vec_id", "embedding").select(
        "digest", "dims", "x", W.F.lit(1).cast("long").alias("weight")).repartition(9)
    sums = W.exact_sums(fit)
    n, weight, total = sums[5]
    _, ref, _, cov = reference(data)
    assert (n, weight, total) == (len(ref), len(ref), [int(sum(c)) for c in ref.T])
    assert np.allclose(W.scatter(fit, sums)[5] / n, cov, rtol=1e-12)


def test_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    source = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    data = [(r["vec_id"], r["embedding"]) for r in source.collect()]
    out = op11_weighted_whitening(spark, sf_dir)
    assert dict(out.dtypes)["deviation"] == "bigint"
    check(out.collect(), data)
