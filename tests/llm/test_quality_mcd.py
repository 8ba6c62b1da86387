"""Base counts against plain Python; estimates against a sequential version."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from shelfcast.llm import quality_mcd as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    t = text or ""
    words = WORD.findall(t)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i:i + 3])].append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines, seen, dup = [x for x in t.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(repeated), len(lines),
            sum("A" <= c <= "Z" for c in t))


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = ["der", "Haus", "été", "x", "longword", "Ω", "say", "tree", "<b>", "a|b"] + [f"v{i}" for i in range(400)]
    docs = []
    for i in range(420):
        words = rng.choices(vocab[10:], k=rng.randint(55, 160))
        text = " ".join(w + (".\n" if rng.random() < 0.05 else "") for w in words)
        docs.append((i, text, f"l{i % 2}", "hot" if i % 3 else f"s{i % 7}"))
    for i in range(20):  # junk
        docs.append((1000 + i, " ".join(w + "###" for w in rng.choices(vocab[10:], k=80)), "l0", "hot"))
        docs.append((1100 + i, "\n".join(["THE SAME LINE HERE"] * 40 + rng.choices(vocab, k=60)), "l1", None))
    for i in range(60):
        docs.append((2000 + i, "".join(rng.choices(["a", "b ", "\n", "A", "é", "#", " ", "aa bb cc ", "\x0b", "\x85", "\xa0"],
                                                   k=rng.randint(0, 90))), None, "s1"))
    docs += [(3000, None, "l0", "hot"), (3001, "", None, None), (None, "w " * 60, "l0", "s0"), (5, docs[5][1], "l1", "hot"),
             (3002, "long text " * 20000, "l0", "hot"), (3003, "a a a a", "l0", "x"), (3004, "a b c a b c", "l0", "x")]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, la, s, 1) for i, t, la, s in docs],
                                 "doc_id long, text string, lang string, source string, kept int").repartition(4)


@pytest.fixture(scope="module")
def verdicts(spark):
    return Q.quality_verdicts(frame(spark, corpus())).collect()


def test_counts_equal_brute_force(verdicts):
    want = sorted((str(i), *counts(t)) for i, t, _, _ in corpus())
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines,
                  r.n_upper) for r in verdicts)
    assert got == want


def vector(c):
    n, chars, sym, dup, rep, lines, upper = c
    return np.array([math.log((chars + 5) / (n + 1)), math.log(0.005 + sym / (chars + 100)),
                     math.log(0.1 + dup / (lines + 5)), math.log(0.05 + rep / (n + 20)), math.log(0.02 + upper / (chars + 100))])


def estimate(x):
    """Concentration steps over binned distances, one group in memory."""
    p = x.shape[1]
    grid = np.floor(x * 64 + 0.5) / 64
    centre = np.median(grid, axis=0)
    scale = np.maximum(1.4826 * np.median(np.abs(grid - centre), axis=0), Q.FLOOR)
    inverse = np.diag(1 / scale ** 2)
    for _ in range(Q.STEPS):
        d2 = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
        bins = np.minimum(Q.MAX_BIN, np.floor(np.log1p(np.maximum(d2, 0)) * Q.BINS_PER_E)).astype(int)
        h = min(len(x), max(Q.COVERAGE * len(x), p + 1))
        last = np.sort(bins)[int(math.ceil(h)) - 1]
        sub = x[bins <= last]
        centre = sub.mean(axis=0)
        cov = np.cov(sub.T, ddof=0) / max(0.3, Q.COVERAGE ** 1.5) + np.eye(p) * Q.FLOOR ** 2
        inverse = np.linalg.inv(cov)
    return centre, inverse


def test_distances_equal_a_sequential_estimate(verdicts):
    docs = corpus()
    fails = lambda c: c[0] < 50 or 100 * c[4] > 50 * c[0]
    groups = defaultdict(list)
    for i, t, la, s in docs:
        c = counts(t)
        if not fails(c):
            groups[la, s].append(vector(c))
            groups["all"].append(vector(c))
    models = {g: estimate(np.array(v)) for g, v in groups.items()}
    want = []
    for i, t, la, s in docs:
        c = counts(t)
        own = len(groups[la, s]) >= Q.MIN_GROUP
        centre, inverse = models[(la, s) if own else "all"]
        d = vector(c) - centre
        d2 = float(d @ inverse @ d)
        want.append((str(i), fails(c), not fails(c) and d2 <= Q.CUTOFF, round(d2, 3)))
    got = [(str(r.doc_id), r.base_failed, r.kept, round(r.distance, 3)) for r in verdicts]
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-3, abs=2e-3), (a, b)


def test_junk_goes_and_prose_stays(verdicts):
    kept = {r.doc_id: r.kept for r in verdicts}
    assert all(kept[i] for i in range(420))
    assert not any(kept[i] for i in [*range(1000, 1020), *range(1100, 1120)])


def test_filter_keeps_columns_and_whole_rows(spark):
    d = frame(spark, corpus())
    out = Q.filter_quality(d)
    assert out.columns == d.columns
    kept = sorted(str(r.doc_id) for r in Q.quality_verdicts(d).filter("kept").collect())
    rows = out.collect()
    assert sorted(str(r.doc_id) for r in rows) == kept
    texts = {i: t for i, t, _, _ in corpus()}
    assert all(texts[r.doc_id] == r.text for r in rows if r.doc_id is not None and r.doc_id != 5)


def test_empty_table(spark):
    d = frame(spark, corpus()).limit(0)
    assert Q.quality_verdicts(d).count() == 0 and Q.filter_quality(d).count() == 0
