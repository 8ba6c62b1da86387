"""What op10 and the pipeline's first stage run, against a sequential estimate.

The reference keeps every row in one list: no bins, no sample, no Spark.  It
runs many random starts to the end, takes the least determinant, reweights,
widens by the median distance and cuts at the chi-square quantile.  The
operator's distances are compared, and its verdicts wherever the reference is
clear of the cutoff (the operator's concentration steps take whole bins).
"""

import math
import random

import numpy as np
import pytest
from test_quality_robust import COLUMNS, texts

from shelfcast.llm import quality_mcd as Q

P = 5


def chi2(share):
    """Quantile of the chi-square law of 5 degrees, by summing its density."""
    x = np.linspace(0, 80, 800_001)
    density = x ** 1.5 * np.exp(-x / 2) / (2 ** 2.5 * math.gamma(2.5))
    return x[np.searchsorted(np.cumsum((density + np.roll(density, 1)) / 2 * (x[1] - x[0])), share)]


def chi2_below(p, limit):
    x = np.linspace(0, limit, 200_001)[1:]
    return float((x ** (p / 2 - 1) * np.exp(-x / 2)).sum() * (x[1] - x[0]) / (2 ** (p / 2) * math.gamma(p / 2)))


def vector(row):
    """One spared line, as the query has it."""
    _, words, chars, symbols, dup, repeat, lines, upper, *_ = row
    spared = min(dup, 1)
    repeat = max(repeat - 2 * spared * words / max(lines, 1), 0.0)
    return [math.log((chars + 5) / (words + 1)), math.log(0.005 + symbols / (chars + 100)),
            math.log(0.1 + (dup - spared) / (lines + 5)), math.log(0.05 + repeat / (words + 20)),
            math.log(0.02 + upper / (chars + 100))]


def squared(x, mean, cov):
    off = x - mean
    return np.einsum("ni,ij,nj->n", off, np.linalg.inv(cov), off)


def widened(share):
    return share / chi2_below(P + 2, chi2(share))


def median_factor(d2):
    return max(1.0, np.sort(d2)[(len(d2) - 1) // 2] / chi2(0.5))


def sequential(x, seed=1, trials=150):
    """(mean, scatter) by concentration steps over all rows from many starts."""
    rng, n, eye = np.random.default_rng(seed), len(x), np.eye(P) * Q.FLOOR ** 2
    h, half = (n + P + 1) // 2, widened(0.5)
    best = (math.inf, None, None)
    mid = np.median(x, axis=0)
    starts = [(mid, np.diag(np.maximum(1.4826 * np.median(np.abs(x - mid), axis=0), Q.FLOOR) ** 2))]
    for _ in range(trials):
        some = x[rng.choice(n, P + 1, replace=False)]
        starts.append((some.mean(0), np.cov(some.T, bias=True) + eye))
    for mean, cov in starts:
        last = math.inf
        for _ in range(100):
            inner = x[np.argsort(squared(x, mean, cov), kind="stable")[:h]]
            mean, cov = inner.mean(0), half * np.cov(inner.T, bias=True) + eye
            now = np.linalg.slogdet(cov)[1]
            if now >= last - 1e-9:
                break
            last = now
        if last < best[0]:
            best = (last, mean, cov)
    _, mean, cov = best
    d2 = squared(x, mean, cov)
    inner = x[d2 <= chi2(0.975) * median_factor(d2)]
    mean, cov = inner.mean(0), widened(0.975) * np.cov(inner.T, bias=True) + eye
    return mean, cov * median_factor(squared(x, mean, cov))


def compare(spark, rows, groups):
    """The share of rows whose distance agrees within a tenth, and the clear rows' verdicts."""
    d = spark.createDataFrame(rows, COLUMNS).repartition(4)
    got = {r["doc_id"]: r for r in Q.robust_judged(d, ["lang", "source"]).collect()}
    assert len(got) == len(rows)
    good = [r for r in rows if r[1] >= 50 and 100 * r[5] <= 50 * r[1]]
    cut, near, clear = chi2(0.999), 0, 0
    every = sequential(np.array([vector(r) for r in good]))
    for group in groups:
        mine = [r for r in good if r[-1] == group]
        x = np.array([vector(r) for r in mine])
        d2 = squared(x, *(sequential(x) if len(mine) >= 60 else every))
        for row, want in zip(mine, d2):
            have = got[row[0]]
            near += abs(have["distance"] - want) <= 0.1 * want + 0.15
            if not 0.75 * cut < want < 1.35 * cut:
                clear += 1
                assert have["kept"] == bool(want <= cut), (row, want, have["distance"])
    base = {r[0] for r in rows} - {r[0] for r in good}
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in base)
    return near / len(good), clear / len(good)


def varied(n, rng, first, source, symbols=0.3, upper=0.25):
    """Texts whose rates vary together, as the rows of one source do."""
    rows = []
    for i in range(n):
        words, common = rng.randint(80, 900), rng.gauss(0, 1)
        chars = round(words * math.exp(math.log(5) + 0.12 * common + rng.gauss(0, 0.05)))
        rate = math.exp(math.log(0.01) + symbols * (0.7 * common + rng.gauss(0, 0.7)))
        high = math.exp(math.log(0.03) + upper * rng.gauss(0, 1))
        lines, dup = max(1, words // 12), rng.choice([0, 0, 0, 1, 2])
        rows.append((first + i, words, chars, round(rate * chars), dup, rng.randint(0, words // 15), lines, round(high * chars), "l", source))
    return rows


def junk(n, rng, first, source):
    return [(first + i, 200, 1000, round(rng.uniform(0.2, 0.5) * 1000), rng.randint(8, 12), 40, 16, 400, "l", source) for i in range(n)]


@pytest.mark.parametrize("share", [0.05, 0.4])
def test_distances_and_verdicts(spark, share):
    rng = random.Random(11)
    rows = (varied(260, rng, 0, "a") + junk(round(260 * share), rng, 1000, "a")
            + varied(150, rng, 2000, "b", 0.1, 0.1) + texts(90, rng, 0.3, 3000, source="c")
            + varied(20, rng, 4000, "few") + junk(3, rng, 5000, "few")
            + [(6000, 10, 50, 0, 0, 0, 1, 1, "l", "a"), (6001, 100, 500, 0, 0, 51, 5, 5, "l", "b"), (6002, 0, 0, 0, 0, 0, 0, 0, "l", "c")])
    near, clear = compare(spark, rows, ["a", "b", "c", "few"])
    assert near > 0.9 and clear > 0.9
    got = {r["doc_id"]: r["kept"] for r in Q.robust_judged(spark.createDataFrame(rows, COLUMNS), ["lang", "source"]).collect()}
    assert not any(got[i] for i in range(1000, 1000 + round(260 * share)))


def test_the_query_and_the_stage_run_this_estimate(spark, monkeypatch):
    """Both go through ``robust_estimates``; neither reads the fixed cutoff."""
    import corpus_pipeline
    from shelfcast.llm.queries import op10_quality_mcd
    calls = []
    real = Q.robust_estimates
    monkeypatch.setattr(Q, "robust_estimates", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(Q, "CUTOFF", -1.0)
    sf = "/root/testdata/sf0.001"
    kept = {r["doc_id"] for r in op10_quality_mcd(spark, sf).where("kept").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    staged = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, sf).collect()}
    assert kept == staged and len(kept) > 50 and len(calls) == 2
