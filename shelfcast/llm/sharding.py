"""Sharding by best-fit-decreasing bin packing.

Documents with equal texts form an indivisible group.  Groups, largest first,
enter the shard with the least remaining capacity that still holds them; a
balanced search tree over the remaining capacities finds it.

Groups of equal size are interchangeable, so the packing works on size
classes: (size, how many groups).  Their number is at most the square root of
twice the bytes, which is what the one packing task reads; the groups
themselves stay distributed.  A class's groups get places in hash order from
distributed running counts, and a run of places belongs to a shard.

With a given number of shards, a group larger than an even share has a shard
to itself, and the capacity of the others is the least that a search finds to
hold the rest.  With a given capacity, shards open as they are needed.

Defined results: a null text is an empty one (size ``overhead``, crc 0); equal
texts share a shard; rows repeated in full take slots of their own; an empty
table gives an empty table.  Reruns agree.  Other input columns are not read.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import hash_fraction, positional, running_totals, saved

N_SHARDS = 24
OVERHEAD = 8
SEARCH_STEPS = 14


class _Node:
    __slots__ = ("key", "priority", "left", "right")

    def __init__(self, key, priority):
        self.key, self.priority, self.left, self.right = key, priority, None, None


class FreeSpace:
    """Balanced tree (treap) of (remaining capacity, shard)."""

    def __init__(self):
        self.root, self._random = None, random.Random(7)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node.key < key:
            node.right, more = self._split(node.right, key)
            return node, more
        less, node.left = self._split(node.left, key)
        return less, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a.priority > b.priority:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def add(self, remaining: int, shard: int) -> None:
        less, more = self._split(self.root, (remaining, shard))
        node = _Node((remaining, shard), self._random.random())
        self.root = self._merge(self._merge(less, node), more)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least remaining capacity that holds ``size``."""
        less, more = self._split(self.root, (size, -1))
        if more is None:
            self.root = less
            return None
        parent, node = None, more
        while node.left is not None:
            parent, node = node, node.left
        if parent is None:
            more = node.right
        else:
            parent.left = node.right
        self.root = self._merge(less, more)
        return node.key


def best_fit(classes: list[tuple[int, int]], capacity: int, n_shards: int | None,
             first: int = 0) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, first place in the class, groups, shard) for ``classes`` of
    (size, groups), largest first; None if ``n_shards`` do not suffice."""
    space, runs = FreeSpace(), []
    opened = n_shards or 0
    for shard in range(opened):
        space.add(capacity, first + shard)
    for size, groups in classes:
        place = 0
        while place < groups:
            spot = space.take_tightest(size)
            if spot is None:
                if n_shards is not None:
                    return None
                spot, opened = (max(capacity, size), first + opened), opened + 1
            remaining, shard = spot
            # The shard stays the tightest while equal groups still fit.
            n = min(groups - place, remaining // size)
            runs.append((size, place, n, shard))
            place += n
            space.add(remaining - n * size, shard)
    return runs


def pack(classes: list[tuple[int, int]], n_shards: int | None = N_SHARDS,
         capacity: int | None = None) -> list[tuple[int, int, int, int]]:
    """Best-fit-decreasing runs for a fixed capacity or a fixed number of shards."""
    classes = sorted(classes, reverse=True)
    if capacity is not None:
        return best_fit(classes, capacity, None)
    total, runs, used = sum(s * n for s, n in classes), [], 0
    at, place = 0, 0  # groups larger than an even share of what is left
    while at < len(classes) and n_shards - used > 1 and classes[at][0] * (n_shards - used) > total:
        size, groups = classes[at]
        runs.append((size, place, 1, used))
        total, used, place = total - size, used + 1, place + 1
        if place == groups:
            at, place = at + 1, 0
    rest = [(classes[at][0], classes[at][1] - place), *classes[at + 1:]] if at < len(classes) else []
    shift = {rest[0][0]: place} if rest else {}
    low = -(-total // (n_shards - used))
    high, found = low, None
    step = max(1, low // 4096)
    while found is None:  # a capacity that holds all
        found, good = best_fit(rest, high, n_shards - used, used), high
        if found is None:
            low, high, step = high, high + step, step * 2
    for _ in range(SEARCH_STEPS):
        middle = (low + good) // 2
        if middle in (low, good):
            break
        better = best_fit(rest, middle, n_shards - used, used)
        if better is None:
            low = middle
        else:
            found, good = better, middle
    return runs + [(size, start + shift.get(size, 0), n, shard) for size, start, n, shard in found]


def place_groups(groups: DataFrame, n_shards: int | None = N_SHARDS,
                 capacity: int | None = None) -> DataFrame:
    """``digest, shard`` for ``digest`` (hex), ``group_size`` rows."""

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = pack(list(zip(pdf["group_size"].tolist(), pdf["n"].tolist())), n_shards, capacity)
        return pd.DataFrame(runs, columns=["group_size", "start", "n", "shard"])

    classes = groups.groupBy("group_size").agg(F.count("*").alias("n"))
    runs = (classes.groupBy(F.lit(0).alias("one")).applyInPandas(
        packed, "group_size long, start long, n long, shard int"))
    # A class has at most a run per shard, if their number is given.
    by_class = saved(runs.groupBy("group_size").agg(F.array_sort(F.collect_list(
        F.struct("start", "shard"))).alias("runs")), "shard-runs")
    placed = running_totals(groups.select("digest", "group_size", F.lit(1).cast("long").alias("one"),
                                          hash_fraction(F.col("digest")).alias("f")),
                            ["group_size"], ["f", "digest"], "f", "one", "place")
    x = placed.join(by_class, "group_size")
    mine = F.filter("runs", lambda r: r["start"] <= F.col("place"))
    return x.select("digest", F.element_at(mine, -1)["shard"].alias("shard"))


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_shards: int | None = N_SHARDS,
          capacity: int | None = None, overhead: int = OVERHEAD) -> DataFrame:
    """``doc_id, size, text_crc32, digest, shard, slot`` per document."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    base = saved(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(body) + overhead).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.sha2(body, 256).alias("digest")), "shard-sizes")
    groups = saved(base.groupBy("digest").agg(F.sum("size").alias("group_size")), "shard-groups")
    x = base.join(place_groups(groups, n_shards, capacity), "digest")
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("\\N")), "digest")
                .cast("binary"))
    x = saved(x.withColumn("key", key).withColumn("f", hash_fraction(F.col("key")))
              .withColumn("one", F.lit(1).cast("long")), "shard-placed")
    return running_totals(x, ["shard"], ["f", "key"], "f", "one", "slot").select(
        "doc_id", "size", "text_crc32", "digest", "shard", "slot")


def sharded(docs: DataFrame, text: str = "text", n_shards: int | None = N_SHARDS, capacity: int | None = None,
            overhead: int = OVERHEAD, shard_name: str = "shard") -> DataFrame:
    """The columns of ``docs`` and ``shard_name`` (which replaces a column of that name)."""
    digest = F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"), 256)
    sizes = docs.select(digest.alias("digest"), (F.octet_length(F.coalesce(
        F.col(f"`{text}`").cast("string"), F.lit(""))) + overhead).cast("long").alias("size"))
    groups = saved(sizes.groupBy("digest").agg(F.sum("size").alias("group_size")), "shard-groups")
    renamed, at, back = positional(docs.drop(shard_name))
    x = renamed.withColumn("digest", F.sha2(F.coalesce(
        F.col(at[text]).cast("string"), F.lit("")).cast("binary"), 256))
    return x.join(place_groups(groups, n_shards, capacity), "digest").select(
        *back, F.col("shard").alias(shard_name))
