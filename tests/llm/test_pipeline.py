"""Every pipeline stage against a brute-force version of it, on its own input."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import test_decontaminate as D
import test_mixing as M
import test_quality_mcd as Q

import corpus_pipeline as P
from shelfcast.llm import quality_mcd
from shelfcast.llm.common import saved


def corpus():
    rng = random.Random(12)
    vocab = [f"word{i}" for i in range(500)] + ["der", "el", "été"]
    bench = [(i, " ".join(rng.choices(vocab, k=rng.choice([6, 14, 30])))) for i in range(8)]
    docs, n = [], 0
    for i in range(130):
        words = rng.choices(vocab, k=rng.randint(60, 200))
        if i % 13 == 0:
            words[10:10] = bench[i % 8][1].split()
        family = [words]
        for _ in range(rng.choice([0, 0, 0, 1, 3])):
            near = list(rng.choice(family))
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            family.append(near)
        for w in family:
            docs.append((n, " ".join(w), f"l{i % 2}", f"s{i % 4}" if i % 9 else None, 0))
            n += 1
    docs += [(n + i, " ".join(w + "$$$" for w in rng.choices(vocab, k=90)), "l0", "s0", 0) for i in range(12)]
    docs += [(9000, None, "l0", "s0", 0), (9001, "", None, None, 0), (9002, "too short", "l1", "s1", 0),
             (None, " ".join(rng.choices(vocab, k=80)), "l1", "s1", 0), (3, docs[3][1], "l0", "s3", 0)]
    return [(i, t, la, s, len(t or "")) for i, t, la, s, _ in docs], bench


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, bench = corpus()
    sf = str(tmp_path_factory.mktemp("pipeline-tables"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out, df = [docs], spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        columns = df.columns
        df = saved(stage(spark, df, sf), f"test-{name}")
        assert df.columns == columns or k == len(P.STAGES) - 1
        out.append([tuple(r) for r in df.collect()])
    return out, bench, sf


def test_order():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination",
                                        "source_mix", "shards"]


def test_quality(steps):
    before, after = steps[0][0], steps[0][1]
    groups = defaultdict(list)
    fails = lambda c: c[0] < 50 or 100 * c[4] > 50 * c[0]
    for _, t, la, s, _ in before:
        if not fails(Q.counts(t)):
            groups[la, s].append(Q.vector(Q.counts(t)))
            groups["all"].append(Q.vector(Q.counts(t)))
    models = {g: Q.estimate(np.array(v)) for g, v in groups.items()}
    want = []
    for row in before:
        c = Q.counts(row[1])
        centre, inverse = models[(row[2], row[3]) if len(groups[row[2], row[3]]) >= quality_mcd.MIN_GROUP else "all"]
        d = Q.vector(c) - centre
        if not fails(c) and float(d @ inverse @ d) <= quality_mcd.CUTOFF:
            want.append(row)
    assert Counter(after) == Counter(want)
    assert not any("$$$" in r[1] for r in after) and len(after) > 0.8 * len(before)


def test_near_duplicates(steps):
    before, after = steps[0][1], steps[0][2]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(r[1]) for r in before]
    top = list(range(len(before)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(before):
        groups[find(i)].append(r)
    want = Counter(min(g, key=lambda r: (r[0] is None, r[0]))[0] for g in groups.values())
    assert Counter(r[0] for r in after) == want
    assert set(after) <= set(before)


def test_decontamination(steps):
    out, bench, _ = steps
    hit = {r[0] for r in D.brute([(r[0], r[1]) for r in out[2]], bench) if r[2]}
    assert Counter(out[3]) == Counter(r for r in out[2] if r[0] not in hit)
    assert hit


def test_mix(steps):
    before, after = steps[0][3], steps[0][4]
    want = {(i): taken for i, _, _, _, taken in M.brute([(r[0], r[1], r[3]) for r in before]) if taken}
    got = Counter()
    for r in after:
        got[str(r[0])] += len(r[1].split())
    assert got == want
    assert {r[0] for r in after} <= {r[0] for r in before}


def test_shards(steps):
    before, after = steps[0][4], steps[0][5]
    assert Counter(r[:5] for r in after) == Counter(before)
    home, fill = defaultdict(set), Counter()
    for r in after:
        home[r[1]].add(r[5])
        fill[r[5]] += len(r[1].encode()) + 8
    assert all(len(s) == 1 for s in home.values()) and set(fill) <= set(range(24))
    biggest = max(sum(len(r[1].encode()) + 8 for r in after if r[1] == t) for t in home)
    assert max(fill.values()) <= sum(fill.values()) / 24 + biggest


def test_run_applies_the_stages(spark, steps):
    out, _, sf = steps
    assert Counter(map(tuple, P.run(spark, sf).collect())) == Counter(out[5])
