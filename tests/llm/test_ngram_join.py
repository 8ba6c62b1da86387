"""Prefix-tree join against brute-force Jaccard components."""

import random

import pytest

from shelfcast.llm import ngram_join as J


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)])


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= 90 * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    out = []
    for i, (doc_id, _) in enumerate(docs):
        ids = [d for j, (d, _) in enumerate(docs) if top(j) == top(i) and d is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids and sets[i] else doc_id))
    return sorted(out, key=str)


def corpus(seed, n_base=12, copies=14, tail=40):
    """Families around the threshold: copies with a few words changed, chains
    of such copies, exact repeats in other case, and unrelated texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    docs = [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one TWO"), (905, "x"), (905, "x"),
            (None, "only words without an id here"), (None, None)]
    for b in range(n_base):
        words = rng.choices(vocab, k=rng.choice([3, 9, 12, 20, 21, 60, 150, 400]))
        for c in range(copies):
            if c % 4 == 3:  # chain: change the last copy further
                words = list(words)
            edited = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(edited) + 1)
                edited[at:at + rng.choice([0, 1, 1, 2])] = rng.choices(vocab, k=rng.choice([0, 1, 1, 2]))
            if c % 4 == 3:
                words = edited
            text = " ".join(edited)
            docs.append((b * 100 + c + 1000, text.upper() if c % 5 == 0 else text.replace(" ", "\n", 3)))
    docs += [(5000 + i, " ".join(rng.choices(vocab, k=rng.randint(1, 300)))) for i in range(tail)]
    docs += [(6000, docs[20][1]), (7, docs[20][1])]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,block,text_block", [(1, 1_500_000, 1 << 22), (2, 1_500_000, 2000), (3, 400, 4000),
                                                   (4, 150, 1 << 22)])
def test_components_equal_brute_force(spark, seed, block, text_block):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, "n") for i, t in docs], "doc_id long, text string, node string").repartition(3)
    got = J.linked_components(df, block_shingles=block, block_bytes=text_block)
    assert got.columns[:3] == ["doc_id", "n_shingles", "component_id"]
    rows = sorted([(r[0], r[1], r[2]) for r in got.collect()], key=str)
    assert rows == brute(docs)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.linked_components(df).count() == 0
    assert J.deduplicate(df).count() == 0


def test_one_document_of_each_component_stays(spark):
    docs = corpus(6, n_base=4)
    df = spark.createDataFrame([(t, i, i) for i, t in docs], "text string, doc_id long, n_shingles long")
    kept = J.deduplicate(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    want = brute(docs)
    sized = {c for _, n, c in want if n}
    assert sorted(r.doc_id for r in rows if shingles(r.text)
                  and r.doc_id is not None) == sorted(c for c in sized if c is not None)
    assert sum(not shingles(r.text) for r in rows) == sum(not n for _, n, _ in want)


def test_prefixes_of_linked_sets_share_an_element():
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randint(1, 60)
        s = set(rng.sample(range(100), n))
        t = (s - set(rng.sample(sorted(s), rng.randint(0, min(n, 8))))) | set(rng.sample(range(100), rng.randint(0, 8)))
        for percent in (80, 90):
            if t and 100 * len(s & t) >= percent * len(s | t):
                heads = [set(sorted(x)[:J.prefix_length(len(x), percent)]) for x in (s, t)]
                assert heads[0] & heads[1]


@pytest.mark.parametrize("slab_nodes", [1, 10 ** 9])
@pytest.mark.parametrize("percent", [60, 80, 90])
def test_prefix_tree_finds_what_a_scan_finds(slab_nodes, percent, monkeypatch):
    import numpy as np
    monkeypatch.setattr(J, "SLAB_NODES", slab_nodes)
    rng = np.random.default_rng(5)
    sets = []
    for base in (np.arange(60), np.arange(30, 130), np.arange(200, 206)):
        for _ in range(70):
            keep = base[rng.random(len(base)) > rng.choice([0.0, 0.03, 0.06, 0.2])]
            more = rng.integers(300, 330, rng.integers(0, 5))
            sets.append(np.unique(np.concatenate([keep, more])).astype(np.uint64))
    sets = [s for s in sets if len(s)] + [np.arange(100000, dtype=np.uint64) + np.uint64(1000)]
    order = J.ranked(sets)
    tree = J.PrefixTree(order, percent)
    want = [[j for j in range(len(sets)) if 100 * len(np.intersect1d(s, sets[j])) >= percent * len(np.union1d(s, sets[j]))]
            for s in sets]
    assert [sorted(tree.find(s)) for s in order] == want
    closed = np.zeros(len(sets), bool)
    for i in range(0, len(sets), 3):
        closed[i] = True
        tree.close(i)
    assert [sorted(tree.find(s, closed)) for s in order] == [[j for j in w if not closed[j]] for w in want]
    some = J.PrefixTree(order[:50], percent)  # looked up with sets that the tree does not hold
    assert [sorted(some.find(s)) for s in order] == [[j for j in w if j < 50] for w in want]
