"""The derived cutoff and the estimate of the robust quality rules, on made statistics."""

import math
import random

import numpy as np
import pytest

from shelfcast.llm import quality_mcd as Q

COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " \
          "n_lines long, n_upper long, lang string, source string"


def texts(n, rng, spread, first=0, symbols=None, source="hot"):
    """Statistics of ``n`` texts whose symbol rates vary by ``spread`` (logarithmic units)."""
    rows = []
    for i in range(n):
        chars = rng.randint(4000, 6000)
        rate = symbols if symbols is not None else math.exp(math.log(0.01) + rng.gauss(0, spread)) - 0.005
        rows.append((first + i, chars // 5, chars, max(0, round(rate * (chars + 100))), 0, 0, 20, round(0.03 * chars),
                     "l0", source))
    return rows


def kept(spark, rows):
    d = spark.createDataFrame(rows, COLUMNS).repartition(3)
    return {r.doc_id: r.kept for r in Q.robust_judged(d, ["lang", "source"]).collect()}


def test_chi_square():
    assert Q.chi2_quantile(5, 0.5) == pytest.approx(4.3515, abs=1e-3)
    assert Q.chi2_quantile(5, 0.999) == pytest.approx(20.515, abs=1e-3)
    assert Q.chi2_below(7, 14.067) == pytest.approx(0.95, abs=1e-4)


def test_symbol_junk_goes_where_clean_texts_vary(spark):
    rng = random.Random(5)
    out = kept(spark, texts(400, rng, 0.35) + texts(10, rng, 0, 1000, symbols=0.3) + texts(10, rng, 0, 2000, symbols=1.0))
    assert not any(v for i, v in out.items() if i >= 1000)
    assert np.mean([v for i, v in out.items() if i < 1000]) >= 0.98


def test_one_repeated_line_is_chance(spark):
    rng = random.Random(6)
    rows = texts(200, rng, 0.1) + [(1000, 80, 400, 2, 1, 18, 6, 12, "l0", "hot"), (1001, 80, 400, 2, 5, 38, 6, 12, "l0", "hot")]
    out = kept(spark, rows)
    assert out[1000] and not out[1001]


def test_filter_keeps_whole_rows(spark):
    from test_quality_mcd import corpus, frame
    d = frame(spark, corpus())
    want = sorted(str(r.doc_id) for r in Q.robust_verdicts(d).filter("kept").collect())
    out = Q.filter_robust(d)
    assert out.columns == d.columns and sorted(str(r.doc_id) for r in out.collect()) == want
    assert Q.robust_verdicts(d.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.3, 0.45])
def test_junk_goes_where_it_is_frequent(spark, share):
    rng = random.Random(7)
    n = 400
    out = kept(spark, texts(round(n * (1 - share)), rng, 0.1) + texts(round(n * share), rng, 0.1, 1000, symbols=0.3))
    assert not any(v for i, v in out.items() if i >= 1000)
    assert np.mean([v for i, v in out.items() if i < 1000]) >= 0.97


def test_sampled_starts_and_reruns(spark, monkeypatch):
    monkeypatch.setattr(Q, "SAMPLE", 60)
    rng = random.Random(8)
    rows = texts(300, rng, 0.2) + texts(200, rng, 0.1, 1000, symbols=0.2)
    out = kept(spark, rows)
    assert not any(v for i, v in out.items() if i >= 1000) and out == kept(spark, rows[::-1])


def test_group_of_copies_has_an_estimate(spark, monkeypatch):
    monkeypatch.setattr(Q, "SAMPLE", 40)
    rng = random.Random(9)
    same = texts(1, rng, 0.1)[0]
    out = kept(spark, [(i, *same[1:]) for i in range(300)] + texts(20, rng, 0.1, 1000, symbols=0.3))
    assert all(v == (i < 1000) for i, v in out.items())
