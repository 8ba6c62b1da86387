"""Quality rules: base rules, then robust multivariate outliers per language and source.

Every whole text gives counts; the counts become a transformed statistic
vector; a minimum-covariance-determinant estimate per (lang, source) gives
each document a robust Mahalanobis distance, and documents beyond the cutoff
are rejected.

The estimate is found by concentration steps, each a grouped aggregation over
all rows: documents are binned by their distance, every bin keeps a count,
sums and cross products, and the bins up to the coverage ``h`` give the next
centre and scatter.  ``robust_fit`` keeps half of the rows, takes several starts
to the least determinant and reweights; ``fit`` takes four steps from the medians.  A bin is one row however many documents it holds, so a
source with a third of the corpus costs no more than another.  Groups of fewer
than ``min_group`` rows use the estimate of all documents together.

Defined results: a null or empty text has no words and fails the base rules;
null languages and sources are values like others; repeated rows count each;
an empty table gives an empty table; other input columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import if_small, map_rows, positional, saved

SYMBOLS = frozenset(b"#*$%&|<>")
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_SPACE = b" \t\n\r\x0b\x0c"
_NOT_LEAD = bytes([*range(128, 192), *_SPACE])  # continuation bytes and white space

STATS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
         "n_repeat_words long, n_lines long, n_upper long")
VECTOR = ["v_length", "v_symbols", "v_lines", "v_repeats", "v_upper"]

MIN_WORDS = 50            # base rule: fewer words fail
MAX_REPEAT_PERCENT = 50   # base rule: more repeated words fail
COVERAGE = 0.75           # share h of a group that the concentration steps keep
STEPS = 4                 # concentration steps
CUTOFF = 200.0            # fixed cutoff of ``quality_verdicts``; ``robust_verdicts`` derives its own
QUANTILE = 0.999          # share of a normal sample that ``robust_verdicts`` keeps
SAMPLE = 1000             # distinct vectors of a group, about, among which starts are sought
TRIALS = 500              # random starts
STARTS = 3                # of them, those that go on over all rows
MOST_STEPS = 50           # concentration steps, unless the determinant stops falling before
REWEIGHT = 0.975          # share of a normal sample that the reweighting step keeps
SPARE_LINES = 1           # repeated lines that it counts as chance
MIN_GROUP = 60            # rows a group needs for an estimate of its own
FLOOR = 0.15              # least standard deviation of a coordinate (logarithmic units)
BINS_PER_E = 32           # distance bins per factor e
MAX_BIN = 32 * 40


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int, int]:
    """The counts of STATS for one whole text (null: all zero)."""
    if not text:
        return (0, 0, 0, 0, 0, 0, 0)
    data = text.encode()
    words = data.split()
    n = len(words)
    seen, dup, lines = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip(_SPACE):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            twice = {w for w, c in Counter(windows).items() if c > 1}
            covered = -1  # last word counted so far
            for i, w in enumerate(windows):
                if w in twice:
                    repeat += i + 2 - max(covered, i - 1)
                    covered = i + 2
    return (n, len(data.translate(None, _NOT_LEAD)), len(data.translate(None, _NOT_SYMBOL)),
            dup, repeat, lines, len(data.translate(None, _NOT_UPPER)))


def with_stats(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and the counts of every whole text."""
    return map_rows(docs, [text], text_stats, STATS, keep)


def _vector(spare: int = 0) -> dict:
    """Transformed statistics: logs of rates over a small base rate, so that a
    few symbols or repeats do not set a long clean text apart.  ``spare``
    repeated lines, and twice as many lines' share of the repeated words, count
    as chance: in a short text one repeated line is a large rate."""
    words, chars = F.col("n_words"), F.col("word_chars")
    dup, rep = F.col("n_dup_lines"), F.col("n_repeat_words")
    if spare:
        chance = F.least(dup, F.lit(spare))
        rep = F.greatest(rep - 2 * chance * words / F.greatest("n_lines", F.lit(1)), F.lit(0.0))
        dup = dup - chance
    return {
        "v_length": F.log((chars + 5.0) / (words + 1.0)),
        "v_symbols": F.log(0.005 + F.col("n_symbols") / (chars + 100.0)),
        "v_lines": F.log(0.1 + dup / (F.col("n_lines") + 5.0)),
        "v_repeats": F.log(0.05 + rep / (words + 20.0)),
        "v_upper": F.log(0.02 + F.col("n_upper") / (chars + 100.0)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _keys(names: list[str]) -> list:
    """Null-proof group keys."""
    return [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null"))
            for c in names]


def _start(stats: DataFrame, groups: list[str]) -> DataFrame:
    """Centre and scale from medians and median deviations per coordinate,
    exact on a grid of 1/64, so that the buffers stay small."""
    grid = {v: F.round(F.col(v) * 64) / 64 for v in VECTOR}
    centre = saved(stats.groupBy(*groups).agg(
        *[F.percentile(grid[v], 0.5).alias(f"m_{v}") for v in VECTOR]), "mcd-centre")
    spread = stats.join(if_small(centre), groups).groupBy(*groups).agg(
        F.count("*").alias("n"), *[F.first(f"m_{v}").alias(f"m_{v}") for v in VECTOR],
        *[F.percentile(F.abs(grid[v] - F.col(f"m_{v}")), 0.5).alias(f"s_{v}") for v in VECTOR])
    scale = [F.greatest(1.4826 * F.col(f"s_{v}"), F.lit(FLOOR)) for v in VECTOR]
    p = len(VECTOR)
    return spread.select(
        *groups, "n", F.array(*[F.col(f"m_{v}") for v in VECTOR]).alias("centre"),
        F.array(*[1 / (scale[i] * scale[i]) if i == j else F.lit(0.0)
                  for i in range(p) for j in range(p)]).alias("inverse"))


def _distance() -> Column:
    """Squared Mahalanobis distance from ``centre`` under ``inverse``."""
    p = len(VECTOR)
    diff = [F.col(v) - F.col("centre")[i] for i, v in enumerate(VECTOR)]
    terms = [F.col("inverse")[i * p + j] * diff[i] * diff[j] * (1 if i == j else 2)
             for i in range(p) for j in range(i, p)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def chi2_below(p: int, x: float) -> float:
    """Share of a chi-square sample of odd ``p`` degrees below ``x``."""
    term, tail = 1.0, 0.0
    for k in range((p - 1) // 2):
        term *= x / (2 * k + 1) if k else 1.0
        tail += term
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * tail


def chi2_quantile(p: int, share: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(p, mid) < share else (low, mid)
    return high


def _bin() -> Column:
    return F.least(F.lit(MAX_BIN), F.floor(F.log1p(F.greatest(_distance(), F.lit(0.0))) * BINS_PER_E)).cast("int")


def _median_factor(bins: np.ndarray, n: np.ndarray) -> float:
    """Median distance over that of a normal sample, from sorted bins; at least
    1, as ``FLOOR`` keeps the distances of even texts small on purpose."""
    at = int(np.searchsorted(np.cumsum(n), n.sum() / 2))
    return max(1.0, math.expm1((bins[at] + 0.5) / BINS_PER_E) / chi2_quantile(len(VECTOR), 0.5))


def _consistency(share: float) -> float:
    """What the scatter of the innermost ``share`` of a normal sample lacks."""
    p = len(VECTOR)
    return share / chi2_below(p + 2, chi2_quantile(p, share)) if share < 1 else 1.0


def _estimate(pdf: pd.DataFrame, last: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, scatter and number of the rows of sorted bins up to ``last``."""
    p = len(VECTOR)
    n = pdf["n"].to_numpy(float)[:last + 1]
    mean = np.vstack(pdf["sums"].to_numpy()[:last + 1]).sum(axis=0) / n.sum()
    cov = np.vstack(pdf["cross"].to_numpy()[:last + 1]).sum(axis=0).reshape(p, p) / n.sum() - np.outer(mean, mean)
    return mean, cov, n.sum()


def _starts(groups: list[str]):
    """From a sample of a group's distinct vectors with their counts: the best
    ends of concentration steps from many random starts and from the medians."""
    p = len(VECTOR)
    eye = np.eye(p) * FLOOR ** 2

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(VECTOR, kind="stable")
        x, w = pdf[VECTOR].to_numpy(float), pdf["w"].to_numpy(float)
        mid = np.array([v[o][np.searchsorted(np.cumsum(w[o]), w.sum() / 2)] for v, o in ((v, np.argsort(v)) for v in x.T)])
        x = x - mid  # for exact squares below
        dev = np.array([v[o][np.searchsorted(np.cumsum(w[o]), w.sum() / 2)]
                        for v, o in ((v, np.argsort(v)) for v in np.abs(x).T)])
        squares = (x[:, :, None] * x[:, None, :]).reshape(len(x), p * p)
        least = (w.sum() + p + 1) // 2
        factor = _consistency(0.5)

        def distances(mean, inverse):
            at = np.einsum("sij,sj->si", inverse, mean)
            return inverse.reshape(-1, p * p) @ squares.T - 2 * at @ x.T + (at * mean).sum(axis=1)[:, None]

        def step(mean, inverse):
            d2 = distances(mean, inverse)
            order = np.argsort(d2, axis=1, kind="stable")
            sorted_w = w[order]
            part = np.zeros_like(d2)
            np.put_along_axis(part, order, np.where(np.cumsum(sorted_w, axis=1) - sorted_w < least, sorted_w, 0.0), axis=1)
            k = part.sum(axis=1)[:, None]
            mean = part @ x / k
            cov = (part @ squares / k).reshape(-1, p, p) - mean[:, :, None] * mean[:, None, :]
            cov = factor * cov + eye
            return mean, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

        picked = x[np.random.default_rng(20).choice(len(x), (TRIALS, p + 1), p=w / w.sum())]
        mean = picked.mean(axis=1)
        off = picked - mean[:, None]
        cov = np.einsum("ski,skj->sij", off, off) / (p + 1) + eye
        mean = np.vstack([np.zeros(p), mean])
        inverse = np.concatenate([np.diag(1 / np.maximum(1.4826 * dev, FLOOR) ** 2)[None], np.linalg.inv(cov)])
        for _ in range(2):
            mean, inverse, logdet = step(mean, inverse)
        best = np.argsort(logdet, kind="stable")[:10]
        mean, inverse, logdet = mean[best], inverse[best], logdet[best]
        for _ in range(MOST_STEPS):
            new = step(mean, inverse)
            if np.all(new[2] >= logdet - 1e-9):
                break
            mean, inverse, logdet = new
        _, first = np.unique(np.round(logdet, 6), return_index=True)
        key = pdf.iloc[0][groups].tolist()
        return pd.DataFrame([[*key, i, (mean[j] + mid).tolist(), inverse[j].ravel().tolist(), math.inf, True]
                             for i, j in enumerate(first[:STARTS])],
                            columns=[*groups, "start", "centre", "inverse", "logdet", "open"])

    return find


def _binned(stats: DataFrame, params: DataFrame, groups: list[str], by: list[str]) -> DataFrame:
    """Per ``by`` and distance bin: count, sums, cross products, and the estimate."""
    some = if_small(params.drop("n"))
    return (stats.join(some, groups).withColumn("bin", _bin())
            .groupBy(*by, "bin").agg(
                F.count("*").alias("n"),
                F.array(*[F.sum(v) for v in VECTOR]).alias("sums"),
                F.array(*[F.sum(F.col(a) * F.col(b)) for a in VECTOR for b in VECTOR]).alias("cross"))
            .join(some, by))


def _descend(groups: list[str]):
    """One concentration step on a start's bins; it stays open while the
    determinant falls."""
    p = len(VECTOR)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", kind="stable")
        n = pdf["n"].to_numpy(float)
        last = int(np.searchsorted(np.cumsum(n), min(n.sum(), (n.sum() + p + 1) // 2)))
        mean, cov, k = _estimate(pdf, last)
        # Bins are taken whole, so the share kept may pass a half.
        cov = _consistency(k / n.sum()) * (cov + cov.T) / 2 + np.eye(p) * FLOOR ** 2
        logdet, old = np.linalg.slogdet(cov)[1], pdf.iloc[0]
        key = [*old[groups], int(old["start"])]
        if logdet < old["logdet"] - 1e-6:
            row = [*key, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(logdet), True]
        else:
            row = [*key, list(old["centre"]), list(old["inverse"]), float(old["logdet"]), False]
        return pd.DataFrame([row], columns=[*groups, "start", "centre", "inverse", "logdet", "open"])

    return step


def _reweight(groups: list[str]):
    """The estimate of all rows within the law's ``REWEIGHT`` quantile."""
    p = len(VECTOR)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", kind="stable")
        n, bins = pdf["n"].to_numpy(float), pdf["bin"].to_numpy()
        limit = chi2_quantile(p, REWEIGHT) * _median_factor(bins, n)
        last = int(np.searchsorted(bins, math.floor(math.log1p(limit) * BINS_PER_E), side="right")) - 1
        mean, cov, _ = _estimate(pdf, last)
        cov = _consistency(REWEIGHT) * (cov + cov.T) / 2 + np.eye(p) * FLOOR ** 2
        return pd.DataFrame([[*pdf.iloc[0][groups], int(n.sum()), mean.tolist(), np.linalg.inv(cov).ravel().tolist()]],
                            columns=[*groups, "n", "centre", "inverse"])

    return step


def robust_fit(stats: DataFrame, groups: list[str], min_group: int = 1) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimate of each group of
    ``min_group`` rows or more, on half of its rows.  Random starts are sought
    on a sample of distinct vectors; the best, and the medians of all rows, go
    on over all rows until their determinants stop falling, and the least of
    them counts."""
    keys = ", ".join(f"{g} string" for g in groups)
    schema = keys + ", start int, centre array<double>, inverse array<double>, logdet double, open boolean"
    sizes = saved(stats.groupBy(*groups).agg(
        F.count("*").alias("__n"), F.approx_count_distinct(F.xxhash64(*VECTOR)).alias("__d"))
        .filter(F.col("__n") >= min_group).drop("__n"), "mcd-sizes")
    stats = stats.join(if_small(sizes), groups)
    share = F.pmod(F.xxhash64(*VECTOR), F.lit(1 << 30)) * F.col("__d")
    sample = stats.filter(share < F.lit(SAMPLE << 30)).groupBy(*groups, *VECTOR).agg(F.count("*").alias("w"))
    medians = _start(stats, groups).select(*groups, F.lit(-1).alias("start"), "centre", "inverse",
                                           F.lit(math.inf).alias("logdet"), F.lit(True).alias("open"))
    params = saved(sample.groupBy(*groups).applyInPandas(_starts(groups), schema).unionByName(medians), "mcd-starts")
    by, done = [*groups, "start"], []
    for _ in range(MOST_STEPS):
        bins = _binned(stats, params, groups, by)
        params = saved(bins.groupBy(*by).applyInPandas(_descend(groups), schema), "mcd-step")
        done.append(params.filter(~F.col("open")))
        params = params.filter("open")
        if params.isEmpty():
            break
    done.append(params)
    ends = done[0]
    for d in done[1:]:
        ends = ends.unionByName(d)
    best = saved(ends.groupBy(*groups).agg(F.min_by(F.struct("centre", "inverse"), F.struct("logdet", "start")).alias("e"))
                 .select(*groups, "e.*"), "mcd-best")
    bins = _binned(stats, best, groups, groups)
    return saved(bins.groupBy(*groups).applyInPandas(
        _reweight(groups), keys + ", n long, centre array<double>, inverse array<double>"), "mcd-reweighted")


def rescaled(stats: DataFrame, params: DataFrame, groups: list[str]) -> DataFrame:
    """``params`` with each group's scatter widened so that the median distance
    of its rows is that of a normal sample."""
    bins = (stats.join(if_small(params.drop("n")), groups).withColumn("bin", _bin())
            .groupBy(*groups, "bin").agg(F.count("*").alias("n")))

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", kind="stable")
        return pd.DataFrame([[*pdf.iloc[0][groups], _median_factor(pdf["bin"].to_numpy(), pdf["n"].to_numpy(float))]],
                            columns=[*groups, "factor"])

    schema = ", ".join(f"{g} string" for g in groups) + ", factor double"
    factors = saved(bins.groupBy(*groups).applyInPandas(factor, schema), "mcd-factors")
    return saved(params.join(if_small(factors), groups).select(
        *groups, "n", "centre", F.transform("inverse", lambda v: v / F.col("factor")).alias("inverse")), "mcd-scaled")


def _concentrate(groups: list[str]):
    """From a group's distance bins: the next centre and inverse scatter."""
    p = len(VECTOR)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", kind="stable")
        n = pdf["n"].to_numpy(float)
        cum = np.cumsum(n)
        total = cum[-1]
        last = int(np.searchsorted(cum, min(total, max(COVERAGE * total, p + 1))))
        last = min(last, len(n) - 1)
        keep = slice(0, last + 1)
        k = n[keep].sum()
        sums = np.vstack(pdf["sums"].to_numpy()[keep]).sum(axis=0)
        cross = np.vstack(pdf["cross"].to_numpy()[keep]).sum(axis=0).reshape(p, p)
        mean = sums / k
        cov = cross / k - np.outer(mean, mean)
        cov = (cov + cov.T) / 2
        # Coverage shrinks the scatter; the factor of a normal sample restores it.
        cov = cov / max(0.3, COVERAGE ** 1.5) + np.eye(p) * FLOOR ** 2
        inverse = np.linalg.inv(cov)
        return pd.DataFrame([[*pdf.iloc[0][groups], int(total), mean.tolist(),
                              inverse.ravel().tolist()]],
                            columns=[*groups, "n", "centre", "inverse"])

    return step


def fit(stats: DataFrame, groups: list[str], steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant estimate of each group: ``groups``, n,
    centre, inverse (row-major).  ``stats`` holds the group and vector columns."""
    params = saved(_start(stats, groups), "mcd-start")
    schema = ", ".join(f"{g} string" for g in groups) + ", n long, centre array<double>, inverse array<double>"
    for _ in range(steps):
        d2 = _distance()
        bins = (stats.join(if_small(params.drop("n")), groups)
                .withColumn("bin", F.least(F.lit(MAX_BIN), F.floor(F.log1p(F.greatest(d2, F.lit(0.0)))
                                                                   * BINS_PER_E)).cast("int"))
                .groupBy(*groups, "bin").agg(
                    F.count("*").alias("n"),
                    F.array(*[F.sum(v) for v in VECTOR]).alias("sums"),
                    F.array(*[F.sum(F.col(a) * F.col(b)) for a in VECTOR for b in VECTOR]).alias("cross")))
        params = saved(bins.groupBy(*groups).applyInPandas(_concentrate(groups), schema), "mcd-step")
    return params


def judged(stats: DataFrame, group_cols: list[str], min_group: int = MIN_GROUP,
           cutoff: float = CUTOFF, params: tuple[DataFrame, DataFrame] | None = None,
           spare: int = 0) -> DataFrame:
    """``stats`` with base_failed, distance (squared, robust) and kept."""
    own, everyone = params or estimates(stats, group_cols)
    x = stats.withColumns(_vector(spare)).withColumns(dict(zip(("__k0", "__k1"), _keys(group_cols))))
    own = own.filter(F.col("n") >= min_group).select("__k0", "__k1", "centre", "inverse")
    one = everyone.first()  # the estimate of all documents together: one row
    x = x.join(if_small(own), ["__k0", "__k1"], "left")
    for name in ("centre", "inverse"):
        other = F.array(*[F.lit(v) for v in one[name]]) if one else F.lit(None).cast("array<double>")
        x = x.withColumn(name, F.coalesce(name, other))
    x = x.withColumn("base_failed", base_failed()).withColumn("distance", _distance())
    x = x.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff))
    return x.drop("__k0", "__k1", "centre", "inverse", *VECTOR)


def _vectors(stats: DataFrame, group_cols: list[str], spare: int = 0) -> DataFrame:
    """Rows that fail the base rules take no part, as they are rejected anyway."""
    return saved(stats.filter(~base_failed()).withColumns(_vector(spare)).select(
        *[k.alias(n) for n, k in zip(("__k0", "__k1"), _keys(group_cols))],
        F.lit("all").alias("__k2"), *VECTOR), "mcd-vectors")


def estimates(stats: DataFrame, group_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Estimates per group and for all documents."""
    x = _vectors(stats, group_cols)
    return fit(x, ["__k0", "__k1"]), fit(x, ["__k2"])


def robust_estimates(stats: DataFrame, group_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """As ``estimates``, for distances that follow a chi-square law."""
    x = _vectors(stats, group_cols, SPARE_LINES)
    return tuple(rescaled(x, robust_fit(x, g, least), g)
                 for g, least in ((["__k0", "__k1"], MIN_GROUP), (["__k2"], 1)))


def robust_judged(stats: DataFrame, group_cols: list[str],
                  params: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``judged`` with a cutoff from the chi-square law of the distances."""
    return judged(stats, group_cols, cutoff=chi2_quantile(len(VECTOR), QUANTILE),
                  params=params or robust_estimates(stats, group_cols), spare=SPARE_LINES)


def robust_verdicts(docs: DataFrame, text: str = "text", group_cols: tuple[str, str] = ("lang", "source"),
                    keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As ``quality_verdicts``, by ``robust_judged``."""
    cols = list(dict.fromkeys([*keep, *group_cols]))
    return robust_judged(saved(with_stats(docs, text, cols), "quality-stats"), list(group_cols))


def filter_robust(docs: DataFrame, text: str = "text",
                  group_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The rows of ``docs`` that ``robust_judged`` keeps, with their columns."""
    stats = saved(with_stats(docs, text, list(group_cols)), "quality-stats")
    params = robust_estimates(stats, list(group_cols))
    renamed, at, back = positional(docs)
    rows = map_rows(renamed, [at[text]], text_stats, STATS, list(at.values()))
    return robust_judged(rows, [at[c] for c in group_cols], params).filter("kept").select(*back)


def quality_verdicts(docs: DataFrame, text: str = "text", group_cols: tuple[str, str] = ("lang", "source"),
                     keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep``, counts, base_failed, distance, kept."""
    cols = list(dict.fromkeys([*keep, *group_cols]))
    stats = saved(with_stats(docs, text, cols), "quality-stats")
    return judged(stats, list(group_cols))


def filter_quality(docs: DataFrame, text: str = "text",
                   group_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    stats = saved(with_stats(docs, text, list(group_cols)), "quality-stats")
    params = estimates(stats, list(group_cols))
    renamed, at, back = positional(docs)
    rows = map_rows(renamed, [at[text]], text_stats, STATS, list(at.values()))
    return judged(rows, [at[c] for c in group_cols], params=params).filter("kept").select(*back)
