"""Distributed automaton scores against an explicit one over all n-grams."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import lm_automaton as L

START, END = "<s>", "</s>"


class Automaton:
    """States are the contexts seen; every arc and failure arc is explicit."""

    def __init__(self, texts, order, strengths):
        grams = defaultdict(Counter)
        for words in texts:
            seq = [START, *words, END]
            for n in range(1, order + 1):
                for i in range(len(seq) - n + 1):
                    grams[n][tuple(seq[i:i + n])] += 1
        words = Counter({g: c for g, c in grams[1].items() if g != (START,)})
        self.words, self.total, self.order = words, sum(words.values()), order
        self.vocabulary = len(words)
        self.arcs, self.fail = defaultdict(dict), {}
        for n in range(2, order + 1):
            for g, c in grams[n].items():
                self.arcs[g[:-1]].setdefault(g[-1], c)
        self.count = {g: c for n in range(1, order) for g, c in grams[n].items()}
        self.strengths = strengths
        self.states = {()} | set(self.count)

    def base(self, w):
        return (self.words[(w,)] + 0.5) / (self.total + 0.5 * (self.vocabulary + 1))

    def p(self, state, w):
        if not state:
            return self.base(w)
        s, n = self.strengths[len(state) + 1], self.count[state]
        return (self.arcs[state].get(w, 0) + s * self.p(state[1:] if state[1:] in self.states else (), w)) / (n + s)

    def score(self, words):
        state, total = self.longest((START,)), 0.0
        history = (START,)
        for w in [*words, END]:
            while state and w not in self.arcs[state]:
                s = self.strengths[len(state) + 1]
                total += math.log10(s / (self.count[state] + s))
                state = state[1:]
            total += math.log10(self.p(state, w))
            history = (*history, w)
            state = self.longest(history)
        return total

    def longest(self, history):
        for n in range(self.order - 1, 0, -1):
            if len(history) >= n and history[-n:] in self.states:
                return history[-n:]
        return ()


def corpus():
    rng = random.Random(2)
    vocab = ["the", "a", "Of", "house", "tree", "ÄB", "x1", "—"]
    docs = [(i, " ".join(rng.choices(vocab, weights=[9, 7, 5, 3, 2, 1, 1, 1], k=rng.randint(0, 40))))
            for i in range(60)]
    docs += [(60, None), (61, ""), (62, "unseen words only here"), (63, docs[3][1]), (63, docs[3][1]),
             (None, "a house tree"), (64, "the " * 3000)]
    return docs


@pytest.mark.parametrize("order,block", [(2, 1 << 20), (2, 60), (3, 200), (3, 30), (4, 90)])
def test_equals_explicit_automaton(spark, order, block):
    docs = corpus()
    held = {i for i, _ in docs if i is not None and i % 5 == 2}
    d = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double").repartition(3)
    got = L.train_and_score(d, F.coalesce(F.pmod("doc_id", F.lit(5)) == 2, F.lit(False)), order=order,
                            strengths={2: 3.0, 3: 1.5, 4: 2.0}, block_bytes=block)
    words = [(i, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split(" "))
             for i, t in docs]
    words = [(i, [w for w in ws if w]) for i, ws in words]
    model = Automaton([w for i, w in words if i not in held], order, {2: 3.0, 3: 1.5, 4: 2.0})
    want = sorted((str(i), i in held, len(w) + 1, sum(model.words[(x,)] > 0 for x in [*w, END]), model.total,
                   round(sum(math.log10(model.base(x)) for x in [*w, END]), 6), round(model.score(w), 6))
                  for i, w in words)
    rows = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                   round(r.base_score, 6), round(r.score, 6)) for r in got.collect())
    assert rows == want


def test_probabilities_sum_to_one():
    docs = [["a", "b", "a"], ["b", "b"], []]
    model = Automaton(docs, 3, {2: 3.0, 3: 1.5})
    for state in (s for s in model.states if END not in s):
        known = sum(model.p(state, w) for (w,) in model.words)
        assert known + model.p(state, "new") == pytest.approx(1.0)


def test_no_training_rows_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = L.train_and_score(d, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens, r.score, r.base_score) for r in rows} == {(0, 0, 0.0, 0.0)}
    assert L.train_and_score(d.limit(0), F.lit(False)).count() == 0


def test_only_what_may_occur_elsewhere_is_asked(spark):
    """A block asks for a trigram only if both its bigrams stand in another block too."""
    texts = ["a b c d", "a b x c d", "q r s t u", "b c a b", "q r s t u"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    blocks = L.blocks_of(d, "doc_id", "text", F.lit(False), 1)
    replies = L.answers(L.requests(blocks, 3, 1)).drop("distinct_words")
    asked = {r["block"]: len(L.unpack_keys(r["keys"])) for r in L.further_requests(blocks, replies, 3, 1).collect()}
    grams = [list(zip(*[["<s>", *t.split(), "</s>"][i:] for i in range(3)])) for t in texts]
    pairs = [{p for g in gs for p in (g[:2], g[1:])} for gs in grams]
    want = {i: len({g for g in gs if all(any(p in o for j, o in enumerate(pairs) if j != i) for p in (g[:2], g[1:]))})
            for i, gs in enumerate(grams)}
    assert sum(want.values()) < sum(len(set(gs)) for gs in grams)
    assert asked == {i: n for i, n in want.items() if n}
