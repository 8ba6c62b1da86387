"""Quality classifier: document evidence shrunk over sites by hierarchical empirical Bayes.

A logistic model over text statistics gives each document's own evidence.
Grouped aggregation counts the evidence per host and per path of a host; a
host's posterior shrinks to the global prior, a path's to its host's, each by
a strength that the moments of the counts give, so that a sparse site says
little.  A document's verdict joins its evidence with its path's posterior,
from which its own part is taken out.

The evidence model is fitted to a bounded sample of labelled rows
(``max_labelled``, by hash of the id); the site counts cover all documents.
Host and path tables join by key and are broadcast only up to a counted size.

Defined results: a null or empty text has the evidence of its zero counts;
null hosts and paths are values like others; without labels of both kinds the
evidence is the labels' share of good ones (one half if there are none);
repeated rows count each; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import if_small, saved
from shelfcast.llm.quality_mcd import with_stats

MAX_LABELLED = 50_000
THRESHOLD = 0.5
RIDGE = 1e-2
FEATURES = ["x_words", "x_length", "x_symbols", "x_lines", "x_repeats", "x_upper"]


def site_of(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL, null where it has none."""
    host = F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1), F.lit("")))
    path = F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1), F.lit(""))
    return host, path


def _features() -> dict[str, Column]:
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "x_words": F.least(F.log1p(words.cast("double")), F.lit(6.0)),
        "x_length": F.log((chars + 5.0) / (words + 1.0)),
        "x_symbols": F.log(0.01 + F.col("n_symbols") / (chars + 20.0)),
        "x_lines": F.log(0.1 + F.col("n_dup_lines") / (F.col("n_lines") + 2.0)),
        "x_repeats": F.log(0.05 + F.col("n_repeat_words") / (words + 10.0)),
        "x_upper": F.log(0.02 + F.col("n_upper") / (chars + 20.0)),
    }


def fit_evidence(x: np.ndarray, y: np.ndarray) -> tuple[float, list[float]]:
    """Bias and weights (of ``x``, then of its squares) of a logistic model, by
    Newton steps with a ridge."""
    n = len(y)
    if n == 0 or y.min() == y.max():
        share = float(y.mean()) if n else 0.5
        return float(np.log((share + 1e-3) / (1 - share + 1e-3))), [0.0] * (2 * x.shape[1])
    a = np.hstack([np.ones((n, 1)), x, x ** 2])
    w = np.zeros(a.shape[1])
    keep = np.full(a.shape[1], RIDGE)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) / n + keep * w
        h = (a * (p * (1 - p))[:, None]).T @ a / n + np.diag(keep)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:].tolist()


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _strength(n: str, s: str, centre: Column) -> Column:
    """Prior strength from the moments of group rates about their centres: the
    spread of rates beyond what counts of that size give by chance."""
    rate = F.col(s) / F.col(n)
    weight = F.sum(F.col(n))
    between = F.sum(F.col(n) * (rate - centre) * (rate - centre)) / weight
    noise = F.sum(centre * (1 - centre)) / weight  # n * m(1-m)/n, summed over groups
    inside = F.sum(F.col(n) * centre * (1 - centre)) / weight
    extra = F.greatest(between - noise, inside * 1e-3)
    return F.greatest(F.lit(1.0), F.least(F.lit(1e4), inside / extra - 1))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, use: Column | None = None,
             doc_id: str = "doc_id", text: str = "text", label: str = "quality",
             max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, evidence, host_posterior, path_posterior, score, good`` per document.

    ``host`` and ``path`` are expressions over ``docs``; ``use``, over the label
    rows, says which of them the fit may see."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
                      key(host).alias("host"), key(path).alias("path"))
    stats = saved(with_stats(src, "text", ["doc_id", "host", "path"]).select(
        "doc_id", "host", "path", *[c.alias(n) for n, c in _features().items()]), "site-stats")

    y = (labels.filter((F.lit(True) if use is None else use) & F.col(label).isNotNull()
                       & F.col(doc_id).isNotNull())
         .groupBy(F.col(doc_id).alias("doc_id")).agg(F.avg((F.col(label) > 0).cast("double")).alias("y")))
    n = y.count()
    if n > max_labelled:
        y = y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(max_labelled / n * 1_000_000))
    known = stats.join(F.broadcast(y), "doc_id").select(*FEATURES, "y").toArrow()
    x = np.column_stack([np.asarray(known[f], float) for f in FEATURES]) if known.num_rows else np.zeros((0, len(FEATURES)))
    bias, w = fit_evidence(x, np.asarray(known["y"], float))

    z = F.lit(bias)
    for f, once, squared in zip(FEATURES, w, w[len(FEATURES):]):
        z = z + F.lit(once) * F.col(f) + F.lit(squared) * F.col(f) * F.col(f)
    judged = saved(stats.select("doc_id", "host", "path", (1 / (1 + F.exp(-z))).alias("evidence")), "site-evidence")

    paths = saved(judged.groupBy("host", "path").agg(F.count("*").alias("n_path"), F.sum("evidence").alias("s_path")),
                  "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    m = hosts.agg((F.sum("s_host") / F.sum("n_host")).alias("m")).first()["m"]
    m = 0.5 if m is None else m
    k_host = hosts.agg(_strength("n_host", "s_host", F.lit(m)).alias("k")).first()["k"] or 1.0
    hosts = hosts.withColumn("host_mean", (F.col("s_host") + k_host * m) / (F.col("n_host") + k_host))
    both = paths.join(hosts, "host")
    k_path = both.agg(_strength("n_path", "s_path", F.col("host_mean")).alias("k")).first()["k"] or 1.0

    both = saved(both.select("host", "path", "n_path", "s_path", "n_host", "s_host"), "site-both")
    x = judged.join(if_small(both), ["host", "path"])
    e = F.col("evidence")
    host_post = (F.col("s_host") - e + k_host * m) / (F.col("n_host") - 1 + k_host)
    x = x.withColumn("host_posterior", host_post)
    x = x.withColumn("path_posterior", (F.col("s_path") - e + k_path * F.col("host_posterior"))
                     / (F.col("n_path") - 1 + k_path))
    score = 1 / (1 + F.exp(-(_logit(e) + _logit(F.col("path_posterior")) - _logit(F.lit(m)))))
    return x.withColumn("score", score).withColumn("good", F.col("score") >= threshold).select(
        "doc_id", "evidence", "host_posterior", "path_posterior", "score", "good")
