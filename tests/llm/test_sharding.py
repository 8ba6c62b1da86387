"""Best-fit-decreasing shards against a group-by-group packing."""

import random
import zlib
from collections import Counter, defaultdict

from shelfcast.llm import sharding as S


def one_by_one(sizes, capacity, n_shards):
    """Shard fills when every group is placed singly; None if one does not fit."""
    left = [capacity] * (n_shards or 0)
    for size in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= size]
        if not fits:
            if n_shards is not None:
                return None
            left.append(max(capacity, size))
            fits = [(left[-1], len(left) - 1)]
        left[min(fits)[1]] -= size
    return left


def fills(runs):
    out = Counter()
    for size, _, n, shard in runs:
        out[shard] += size * n
    return out


def test_runs_equal_single_placement():
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.choice([3, 5, 8, 13, 40, rng.randint(1, 90)]) for _ in range(rng.randint(1, 80))]
        classes = sorted(Counter(sizes).items(), reverse=True)
        for capacity, n in ((100, None), (sum(sizes) // 3 + 20, 4), (130, 9)):
            runs = S.best_fit(classes, capacity, n)
            left = one_by_one(sizes, capacity, n)
            assert (runs is None) == (left is None)
            if runs is not None:
                got = fills(runs)
                assert [capacity - r if r >= 0 else 0 for r in left if r <= capacity] and \
                    sorted(got.values()) == sorted(v for v in (max(capacity, capacity) - r for r in left) if v)
                place = defaultdict(int)
                for size, start, k, _ in runs:
                    assert start == place[size]
                    place[size] += k
                assert place == Counter(sizes)


def test_free_space_tree():
    rng = random.Random(1)
    tree, held = S.FreeSpace(), []
    for i in range(500):
        if held and rng.random() < 0.5:
            size = rng.randint(0, 100)
            want = min((x for x in held if x[0] >= size), default=None)
            assert tree.take_tightest(size) == want
            if want:
                held.remove(want)
        else:
            held.append((rng.randint(0, 90), i))
            tree.add(*held[-1])


def test_pack_keeps_an_oversize_group_alone_and_the_rest_even():
    runs = S.pack([(10_000, 1), (900, 2), (7, 3000), (3, 100)], 8)
    got = fills(runs)
    big = [s for size, _, _, s in runs if size == 10_000]
    assert got[big[0]] == 10_000
    rest = [v for s, v in got.items() if s != big[0]]
    assert len(rest) == 7 and max(rest) - min(rest) <= 7


def docs():
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("abcdé ", k=rng.randint(0, 400)))) for i in range(700)]
    rows += [(1000 + i, "copy of one text") for i in range(150)]
    rows += [(None, None), (2, None), (2, ""), (3, "same"), (3, "same")]
    return rows


def test_shards(spark):
    rows = docs()
    d = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, shard string").repartition(5)
    out = S.shard(d).collect()
    assert len(out) == len(rows)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    home, slots, fill = defaultdict(set), defaultdict(list), Counter()
    for r in out:
        home[r.digest].add(r.shard)
        slots[r.shard].append(r.slot)
        fill[r.shard] += r["size"]
    assert all(len(s) == 1 for s in home.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(fill) == set(range(24))
    assert max(fill.values()) - min(fill.values()) <= 60
    again = S.shard(d.repartition(2)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def test_capacity_opens_as_few_shards_as_best_fit(spark):
    rows = docs()
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = S.shard(d, n_shards=None, capacity=5000).collect()
    fill = Counter()
    for r in out:
        fill[r.shard] += r["size"]
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 8
    left = one_by_one(groups.values(), 5000, None)
    assert sorted(fill.values()) == sorted(5000 - x for x in left)


def test_sharded_keeps_rows_and_clashing_names(spark):
    rows = docs()
    d = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, shard string")
    out = S.sharded(d)
    assert out.columns == ["doc_id", "text", "shard"]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(rows)
    assert S.sharded(d.limit(0)).count() == 0 and S.shard(d.limit(0)).count() == 0
