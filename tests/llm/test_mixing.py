"""Source mixing against a sequential computation, and its SQL twin."""

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from shelfcast.llm import mixing as M

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs, weights=(5, 2, 1), cap=3):
    sizes = [len(WORD.findall(t or "")) for _, t, _ in docs]
    total = defaultdict(int)
    for (_, _, s), n in zip(docs, sizes):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes)
    while True:  # share, cap, share the excess again
        share = {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * total[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = float(cap * total[s])
            left -= cap * total[s]
        open_ -= over
        if not open_:
            break
    out = []
    for s in order:
        mine = []
        for (i, t, src), n in zip(docs, sizes):
            if src == s:
                parts = ["mix", "\\N" if i is None else str(i), "\\N" if src is None else src,
                         hashlib.md5((t or "").encode()).hexdigest()]
                mine.append((hashlib.md5("|".join(parts).encode()).hexdigest(), i, n))
        budget = int(target[s] + 0.5)
        epochs = budget // total[s] if total[s] else 0
        rest = budget - epochs * total[s]
        for _, i, n in sorted(mine):
            part = max(0, min(n, rest))
            rest -= part
            out.append((str(i), n, total[s], round(target[s], 6), epochs * n + part))
    return sorted(out)


def corpus():
    docs = [(i, "w " * (i % 17), f"s{i % 5}") for i in range(120)]
    docs += [(200 + i, "big text " * 40, "hot") for i in range(60)]
    docs += [(300, None, None), (301, "a b c", None), (302, "", "empty"), (None, "x y", "é"), (5, "dup dup", "s1"),
             (5, "dup dup", "s1"), (303, "one word two", "Z")]
    return docs


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_sequential(spark, parts):
    docs = corpus()
    d = spark.createDataFrame([(*r, 9) for r in docs], "doc_id long, text string, source string, size int")
    got = M.mix(d.repartition(parts))
    rows = sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6), r.taken) for r in got.collect())
    assert rows == brute(docs)
    assert all(r[4] <= 3 * r[1] for r in rows)


def test_equals_sql(spark):
    docs = [r for r in corpus() if r[0] is not None]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    con = duckdb.connect()
    pdf = d.toPandas()
    con.register("documents", pdf)
    want = sorted((str(r[0]), r[1], r[2], round(r[3], 6), r[4]) for r in con.execute(M.oracle()).fetchall())
    got = sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6), r.taken) for r in M.mix(d).collect())
    assert got == want


def test_ranges_smaller_than_a_source(spark, monkeypatch):
    from functools import partial
    monkeypatch.setattr(M, "running_totals", partial(M.running_totals, rows_per_bucket=4))
    docs = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6), r.taken) for r in M.mix(d).collect())
    assert rows == brute(docs)


def test_mixed_rows_hold_the_words_taken(spark):
    docs = corpus()
    d = spark.createDataFrame([(t, s, i, len(t or "")) for i, t, s in docs],
                              "text string, source string, doc_id long, n_chars int")
    out = M.mixed(d)
    assert out.columns == d.columns and out.dtypes == d.dtypes
    words, repeats = defaultdict(int), defaultdict(int)
    for r in out.collect():
        n = len(WORD.findall(r.text))
        assert n and r.n_chars == len(r.text)
        words[r.source] += n
        repeats[str(r.doc_id)] += n
    taken, per_doc = defaultdict(int), defaultdict(int)
    for r in M.mix(d).collect():
        taken[r.source] += r.taken
        per_doc[str(r.doc_id)] += r.taken
    assert dict(words) == {s: n for s, n in taken.items() if n}
    assert dict(repeats) == {i: n for i, n in per_doc.items() if n}


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
    assert M.mix(d).count() == 0 and M.mixed(d).count() == 0
