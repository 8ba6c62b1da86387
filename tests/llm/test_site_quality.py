"""Shrinkage and posteriors against plain formulas."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import site_quality as Q


def corpus():
    docs, labels = [], []
    good = "these are plain words of a good page number {} with many different endings {} and {}"
    for i in range(240):
        host = f"h{i % 6}"
        bad = (i % 6 == 5 and i % 4 != 0) or i % 17 == 0
        text = "### $$$ " * 12 + f"buy {i}" if bad else (good.format(i, i * 7, i * 3) + " ") * (1 + i % 3)
        docs.append((i, text, host, f"p{i % 12 // 6}"))
        if i % 2:
            labels.append((i, int(not bad)))
    docs += [(900, None, "sparse", None), (901, "", None, None), (None, good, "sparse", None), (3, docs[3][1], "h3", "p0"),
             (902, "word " * 20000, "sparse", "p")]
    return docs, labels + [(None, 1), (5, None)]


@pytest.fixture(scope="module")
def result(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, host string, evidence string").repartition(3)
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = Q.classify(d, y, F.col("host"), F.col("evidence")).collect()
    return docs, rows


def strength(groups):
    """groups: (n, s, centre)."""
    total = sum(n for n, _, _ in groups)
    between = sum(n * (s / n - m) ** 2 for n, s, m in groups) / total
    inside = sum(n * m * (1 - m) for n, _, m in groups) / total
    noise = sum(m * (1 - m) for _, _, m in groups) / total
    return max(1.0, min(1e4, inside / max(between - noise, inside * 1e-3) - 1))


def test_posteriors_equal_formulas(result):
    docs, rows = result
    evidence = {(r.doc_id): r.evidence for r in rows}
    hosts, paths = defaultdict(list), defaultdict(list)
    for i, _, h, p in docs:
        hosts[h].append(evidence[i])
        paths[h, p].append(evidence[i])
    m = sum(map(sum, hosts.values())) / len(docs)
    k = strength([(len(v), sum(v), m) for v in hosts.values()])
    mean = {h: (sum(v) + k * m) / (len(v) + k) for h, v in hosts.items()}
    kp = strength([(len(v), sum(v), mean[h]) for (h, _), v in paths.items()])
    place = {i: (h, p) for i, _, h, p in docs}
    for r in rows:
        h, p = place[r.doc_id]
        e, v, w = r.evidence, hosts[h], paths[h, p]
        host = (sum(v) - e + k * m) / (len(v) - 1 + k)
        path = (sum(w) - e + kp * host) / (len(w) - 1 + kp)
        assert r.host_posterior == pytest.approx(host, abs=1e-6)
        assert r.path_posterior == pytest.approx(path, abs=1e-6)
        logit = lambda q: math.log(min(max(q, 1e-6), 1 - 1e-6) / (1 - min(max(q, 1e-6), 1 - 1e-6)))
        assert r.score == pytest.approx(1 / (1 + math.exp(-(logit(e) + logit(path) - logit(m)))), abs=1e-6)


def test_evidence_tells_good_from_bad(result):
    docs, rows = result
    score = {r.doc_id: r.good for r in rows}
    right = sum(score[i] == ("###" not in t) for i, t, _, _ in docs if i is not None and i < 240)
    assert right >= 234


def test_sparse_sites_stay_near_the_global_mean(result):
    _, rows = result
    by = {r.doc_id: r for r in rows}
    whole = np.mean([r.evidence for r in rows])
    assert abs(by[901].path_posterior - whole) < 0.02


def test_site_of_urls(spark):
    urls = ["http://Blog.Example.com/en/35#top", "https://a.b:80", "https://a.b/", "no url", None]
    d = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = Q.site_of(F.col("url"))
    assert [tuple(r) for r in d.select(host, path).collect()] == [
        ("blog.example.com", "en"), ("a.b", None), ("a.b", None), (None, None), (None, None)]


def test_without_labels_and_empty(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, host string, path string")
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    none = Q.classify(d, y.limit(0), F.col("host"), F.col("path")).collect()
    assert {round(r.evidence, 6) for r in none} == {0.5} and len(none) == len(docs)
    assert Q.classify(d.limit(0), y, F.col("host"), F.col("path")).count() == 0
