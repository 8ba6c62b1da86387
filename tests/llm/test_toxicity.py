"""Held-out accuracy, the effect of the counterfactual penalty, and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import toxicity as T

STEMS = ["grumbl", "stinkor", "véldi"]


def corpus(seed=3, n=900):
    """Toxic texts hold inflected stems; "women" stands in most toxic texts and
    in few others, so a plain fit blames the word."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = rng.choices(vocab, k=rng.randint(5, 80))
        if toxic:
            words += [rng.choice(STEMS) + rng.choice(["e", "en", "ung", "a"]) for _ in range(2)]
        if rng.random() < (0.8 if toxic else 0.05):
            words.append("women")
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(5000, None), (5001, ""), (5002, "the women of the town"), (5003, "the town"), (None, "x"),
             (5004, "Grumblix!"), (5005, "w1 " * 40000)]
    labels += [(None, 1), (7, None), (8, 1), (8, 0), (99999, 1)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(i, t, "s", 0.5) for i, t in docs], "doc_id long, text string, source string, score double")
    return d.repartition(3), spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, tables):
    d, y = tables
    model = T.fit(d, y, F.pmod("doc_id", F.lit(5)) != 2)
    rows = {r.doc_id: r.score for r in T.score(d, model).collect()}
    truth = {i: t for i, t in corpus()[1] if i is not None and t is not None and i < 900 and i % 5 == 2}
    right = sum((rows[i] >= T.THRESHOLD) == bool(t) for i, t in truth.items())
    assert right >= 0.97 * len(truth)
    assert all(0 <= s <= 1 for s in rows.values())
    assert rows[5000] == rows[5001] and rows[5004] > 0.3 > rows[5005]


def test_swaps_pull_identity_terms_apart_from_the_label(spark, tables):
    d, y = tables
    plain = T.fit(d, y, swap_weight=0.0)
    fair = T.fit(d, y, swap_weight=20.0)
    gap = []
    for model in (plain, fair):
        rows = {r.doc_id: r.score for r in T.score(d, model).collect()}
        gap.append(rows[5002] - rows[5003])
    assert gap[0] > 0.02 and abs(gap[1]) < gap[0] / 4


def test_the_default_penalty_acts_and_costs_no_accuracy(spark, tables):
    """At the query's own weight: the term's effect falls to a tenth, and both
    terms of a pair score alike, while held-out texts are told apart as before."""
    d, y = tables
    use = F.pmod("doc_id", F.lit(5)) != 2
    extra = d.sparkSession.createDataFrame([(6000, "the men of the town", "s", 0.5)], d.schema)
    truth = {i: t for i, t in corpus()[1] if i is not None and t is not None and i < 900 and i % 5 == 2}
    gaps, pairs, right = [], [], []
    for model in (T.fit(d, y, use, swap_weight=0.0), T.fit(d, y, use)):
        rows = {r.doc_id: r.score for r in T.score(d.union(extra), model).collect()}
        gaps.append(rows[5002] - rows[5003])
        pairs.append(abs(rows[5002] - rows[6000]))
        right.append(sum((rows[i] >= T.THRESHOLD) == bool(t) for i, t in truth.items()))
    assert gaps[0] > 0.02 and abs(gaps[1]) < gaps[0] / 10
    assert pairs[1] < pairs[0] / 10
    assert right[1] >= right[0] - 0.02 * len(truth)


def test_rerun_and_labels_of_other_kind(spark, tables):
    d, y = tables
    assert T.fit(d, y) == T.fit(d.repartition(2), y.repartition(5))
    none = T.fit(d, y.limit(0))
    assert none.weights == {} and T.score(d.limit(0), none).count() == 0
    same = T.fit(d, y.filter("toxic = 1"))
    assert {round(r.score, 3) for r in T.score(d, same).collect()} == {1.0}


def test_sample_is_bounded(spark, tables):
    _, y = tables
    n = T.sampled_labels(y, F.lit(True), "doc_id", "toxic", 100).count()
    assert 60 <= n <= 150


def test_swaps_stay_in_their_kind():
    other = T.swaps()
    assert other[b"women"] == b"men" and other[b"men"] == b"women"
    kind = {w.encode(): i for i, k in enumerate(T.IDENTITY_TERMS) for w in k}
    assert all(kind[a] == kind[b] and a != b for a, b in other.items())


def test_rare_words_of_toxic_texts_only_have_weight(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocab, k=30) + (["grumble"] if i < 82 else ["zorp"] if i < 90 else [])))
            for i in range(900)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i < 90)) for i in range(900)], "doc_id long, toxic int")
    model = T.fit(d, y)
    assert all(f in model.weights for f in T.word_features(b"zorp"))
    new = spark.createDataFrame([(1, "the zorp of the town"), (2, "the town")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in T.score(new, model).collect()}
    assert scores[1] >= T.THRESHOLD > scores[2]
