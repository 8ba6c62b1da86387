"""Components and running totals against sequential versions."""

import hashlib
import random
from collections import defaultdict

from shelfcast.llm.common import hash_fraction, running_totals
from shelfcast.llm.components import components


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 40)]                             # a chain
    edges += [(100, 100 + i) for i in range(1, 60)]                         # a star
    edges += [(rng.randint(200, 320), rng.randint(200, 320)) for _ in range(70)]
    edges += [(5, 5), (-3, -9), (-9, 100)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges for x in e if find(x) != x}
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(5), "test")
    assert {r.node: r.root for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_running_totals(spark):
    rows = [(i, None if i % 11 == 0 else f"g{i % 3}", i % 5) for i in range(500)]
    rows = [(hashlib.md5(str(i).encode()).hexdigest(), g, v) for i, g, v in rows]
    df = spark.createDataFrame(rows, "k string, g string, v long")
    df = df.withColumn("f", hash_fraction(df.k)).repartition(6)
    got = running_totals(df, ["g"], ["f", "k"], "f", "v", "before", rows_per_bucket=16).collect()
    groups = defaultdict(list)
    for k, g, v in rows:
        groups[g].append((k, v))
    want = {}
    for g, items in groups.items():
        total = 0
        for k, v in sorted(items):
            want[k] = total
            total += v
    assert {r.k: r.before for r in got} == want
    assert set(got[0].asDict()) == {"k", "g", "v", "f", "before"}
