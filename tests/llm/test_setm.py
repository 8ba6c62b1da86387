"""Collocations against counting every phrase of a small corpus in one process."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfcast.llm import setm as S

SCHEMA = "doc_id long, text string, lang string, word string, block long, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "w", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA)


def direct(rows, least, longest=4, top=2000, covered=80):
    count, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, f in count.items():
        some = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in some.items():
            inside = any(len(h) > len(g) and 100 * b >= covered * a
                         and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in some.items())
            if not inside:
                cuts = [(2_000_000 * a // (f[g[:j]] + f[g[j:]]), j, f[g[:j]], f[g[j:]]) for j in range(1, len(g))]
                score, _, left, right = min(cuts)
                rows.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def found(df, **options):
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r[c] for c in cols) for r in S.collocations(df, **options).collect())


def corpus(seed, n=250):
    rng = np.random.default_rng(seed)
    words = np.array(["New", "york", "the", "THE", "of", "état", "x's", "b", "c", "Σ", "#"])
    ends = np.array([" ", " ", " ", "\t", ", ", ". ", "\n", "  ", "\r\n", "\x0b"])
    rows = []
    for _ in range(n):
        k = int(rng.integers(0, 40))
        text = "".join(w + e for w, e in zip(rng.choice(words, k, p=np.array([4, 3, 8, 1, 6, 1, 1, 3, 3, 1, 1]) / 32),
                                             rng.choice(ends, k)))
        if rng.random() < 0.3:
            text += " in the city of new york"
        rows.append((text, rng.choice(["en", "fr"])))
    return rows


@pytest.mark.parametrize("block_bytes", [1, 500, 1 << 20])
def test_matches_direct_count(spark, block_bytes):
    rows = corpus(1) + [(None, "en"), ("", "de"), ("a b", None), ("a b " * 9, None), ("a b", "und")]
    want = direct(rows, 5)
    assert {r[0] for r in want} == {"en", "fr", "und"} and len(want) > 30
    assert found(frame(spark, rows).repartition(3), least=5, block_bytes=block_bytes) == want


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_other_lengths(spark, longest):
    rows = corpus(2)
    assert found(frame(spark, rows), least=4, longest=longest) == direct(rows, 4, longest)


def test_overlaps_copies_and_no_phrase_over_a_piece(spark):
    rows = [("no no no no no no", "en")] * 12 + [("left, right", "en")] * 40 + [("Left\x0cright; left! right", "en")] * 5
    got = found(frame(spark, rows), least=30)
    assert got == direct(rows, 30)
    assert {r[2] for r in got} == {"no no no", "no no no no"}   # 48 of 60 covers, 36 of 48 does not


def test_phrases_that_a_longer_one_covers(spark):
    rows = [("alpha beta gamma", "en")] * 32 + [("alpha beta", "en")] * 8 + [("beta gamma", "en")] * 9
    got = found(frame(spark, rows), least=30)
    assert got == direct(rows, 30)
    assert {r[2] for r in got} == {"alpha beta gamma", "beta gamma"}   # 32 of 40 covers, 32 of 41 does not


def test_first_of_each_language_in_rounds(spark, monkeypatch):
    rows = corpus(3, 400)
    monkeypatch.setattr(S, "TOP_ROWS", 12)
    assert found(frame(spark, rows), least=3, top=10) == direct(rows, 3, top=10)


def test_ties_go_to_the_shortest_first_part(spark):
    rows = [("p q r", "en")] * 30
    got = found(frame(spark, rows), least=30)
    assert got == [("en", 1, "p q r", 30, 30, 30, 90, 1_000_000)] == direct(rows, 30)


def test_scores_are_exact_beyond_64_bits(spark):
    a, both = 9_000_000_000_000_000, 18_000_000_000_000_001
    got = spark.range(1).select(S._score(S.F.lit(a), S.F.lit(both)).alias("s")).first()["s"]
    assert got == 2_000_000 * a // both == 999_999


def test_empty_and_nothing_frequent(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(None, None), ("", "en"), (" . ", "en")])) == []
    assert found(frame(spark, [("one two three", "en")])) == []


def test_long_text_and_long_words(spark):
    rows = [("tick tock " * 30_000, "en"), ("w" * 100_000 + " z", "en")]
    assert found(frame(spark, rows), least=30) == direct(rows, 30)
