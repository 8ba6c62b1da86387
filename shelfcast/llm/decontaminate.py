"""Benchmark decontamination by suffix arrays of the training texts.

The documents are cut into shards of bounded size.  A shard's words become
numbers, its suffixes are sorted by prefix doubling, and every suffix of every
benchmark item is looked up in that suffix array by binary search; the entries
between the two bounds are the verbatim occurrences.  Occurrences on one
diagonal join into maximal matches: which item, from which of its words, from
which word of the document, and how long.

Only suffixes that can match enter the array: a word that no item has ends a
suffix, and a run of known words shorter than the shortest window matches
nothing.  This drops no match.

The benchmark's texts are broadcast in blocks of about ``block_bytes``; a task
builds one block's index at a time and merges the matches of all blocks, so a
large benchmark works without a shuffle of the documents.

Defined results: a null or empty text has no words, matches nothing and is
clean; null or empty items have no window; an item's id counts once however
often it is repeated; a null item id is the string "null".  Repeated documents
are each reported.  Without items no document matches; without documents the
result is empty.  Other input columns are not read, or passed through.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import map_batches, positional

WINDOW = 10
BLOCK_BYTES = 4 << 20   # benchmark text per broadcast block
SHARD_BYTES = 8 << 20    # document text per suffix array (one document at least)

#: After lower-casing A-Z, a word byte is 0-9, a-z or part of a non-ASCII letter.
_TO_SPACE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

MATCHES = ("n_words long, n_hit long, items array<string>, "
           "matches array<struct<item_id:string,item_start:int,doc_start:int,n_words:int>>")


def alnum_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text, A-Z lower-cased."""
    return text.encode().lower().translate(_TO_SPACE).split() if text else []


class ItemIndex:
    """One block of benchmark items: their vocabulary and their windows."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.widths: list[int] = []  # words in an item's windows
        self.ids: list[str] = []
        self.shortest, self.longest = window, 1
        found: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            words = alnum_words(text)
            if not words:
                continue
            at = len(self.ids)
            self.ids.append(item_id)
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            data = np.array(numbers, ">i4").tobytes()
            width = min(window, len(words))
            self.widths.append(width)
            self.shortest = min(self.shortest, width)
            self.longest = max(self.longest, width)
            for start in range(len(words) - width + 1):
                found[data[4 * start:4 * (start + width)]].append((at, start))
        #: Each distinct window with the items and places that have it, in order.
        self.windows = sorted(found.items())


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places of the words other than 0 in the order of their suffixes.

    A 0 ends a suffix and sorts before every word.  Suffixes equal in
    ``depth`` words keep the order of their places.
    """
    n = len(words)
    ends = np.flatnonzero(words == 0)
    end = ends[np.searchsorted(ends, np.arange(n))] if len(ends) else np.zeros(0, np.int64)
    rank, k = words.astype(np.int64), 1
    while k < depth:
        ahead = np.minimum(np.arange(n) + k, end)
        key = rank * (int(rank.max()) + 1) + rank[ahead]
        distinct, rank = np.unique(key, return_inverse=True)
        rank = rank + 1
        rank[ends] = 0
        k *= 2
        if len(distinct) == n - len(ends) + 1:
            break
    order = np.argsort(rank, kind="stable")
    return order[len(ends):]


def find_in_shard(index: ItemIndex, shard: list[list[bytes]]) -> Iterator[tuple[int, int, int, int]]:
    """(document, its word, item, its word) of every window occurrence."""
    get = index.vocabulary.get
    lengths = np.fromiter(map(len, shard), np.int64, len(shard))
    total = int(lengths.sum()) + len(shard)
    numbers = np.zeros(total, np.int32)  # a 0 after every document
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    for i, words in enumerate(shard):
        numbers[starts[i]:starts[i] + len(words)] = np.fromiter(
            map(get, words, repeat(0)), np.int32, len(words))
    gaps = np.flatnonzero(numbers == 0)
    run = np.diff(np.concatenate([[-1], gaps])) - 1          # known words before each 0
    long_runs = np.flatnonzero(run >= index.shortest)
    if not len(long_runs):
        return
    pieces = [np.arange(gaps[r] - run[r], gaps[r] + 1) for r in long_runs]
    place = np.concatenate(pieces)                            # where the kept words stand
    words = numbers[place]
    order = suffix_array(words, index.longest).tolist()
    data = words.astype(">i4").tobytes()
    for window, owners in index.windows:
        size = len(window)
        low = bisect_left(order, window, key=lambda p: data[4 * p:4 * p + size])
        if low == len(order) or data[4 * order[low]:4 * order[low] + size] != window:
            continue
        high = bisect_right(order, window, lo=low, key=lambda p: data[4 * p:4 * p + size])
        spots = place[order[low:high]]
        docs = np.searchsorted(starts, spots, side="right") - 1
        for doc, word in zip(docs.tolist(), (spots - starts[docs]).tolist()):
            for item, start in owners:
                yield doc, word, item, start


def maximal(found: list[tuple[int, int, int]], window: int) -> list[tuple]:
    """Join one document's occurrences (word, item, item word) that follow each
    other on a diagonal into maximal matches (item, item start, start, length)."""
    out, last, begin = [], None, None
    for word, item, start in sorted(found, key=lambda o: (o[1], o[0] - o[2], o[0])):
        if last and (item, word - start) == (last[1], last[0] - last[2]) and word == last[0] + 1:
            last = (word, item, start)
            continue
        if last:
            out.append((begin, last))
        begin = last = (word, item, start)
    if last:
        out.append((begin, last))
    return [(item, i0, w0, w1 - w0 + window) for (w0, item, i0), (w1, _, _) in out]


def match_texts(texts: list[str | None], blocks: list, window: int = WINDOW) -> list[tuple]:
    """Per text the fields of MATCHES; ``blocks``: broadcasts of (item id, text) lists.

    One block's index is held at a time."""
    matches, shards, shard, size = [[] for _ in texts], [], [], 0
    for i, text in enumerate(texts):
        shard.append(i)
        size += len(text or "")
        if size >= SHARD_BYTES:
            shards.append(shard)
            shard, size = [], 0
    if shard:
        shards.append(shard)
    counts = [0] * len(texts)
    for block in blocks:
        index = ItemIndex(block.value, window)
        for shard in shards:
            words = [alnum_words(texts[i]) for i in shard]
            for i, w in zip(shard, words):
                counts[i] = len(w)
            per_doc = defaultdict(lambda: defaultdict(list))
            for doc, word, item, start in find_in_shard(index, words):
                per_doc[doc][index.widths[item]].append((word, item, start))
            for doc, by_width in per_doc.items():
                for width, found in by_width.items():
                    matches[shard[doc]] += [(index.ids[item], *rest)
                                            for item, *rest in maximal(found, width)]
    out = []
    for n, found in zip(counts, matches):
        hit, reach = 0, 0
        for _, _, start, length in sorted(found, key=lambda m: m[2]):
            hit += max(0, start + length - max(start, reach))
            reach = max(reach, start + length)
        found = sorted(set(found))
        out.append((n, hit, sorted({m[0] for m in found}),
                    [dict(zip(("item_id", "item_start", "doc_start", "n_words"), m)) for m in found]))
    return out


def item_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list:
    """The benchmark's items as broadcasts of bounded size, one at least."""
    sc = benchmark.sparkSession.sparkContext
    blocks, items, size = [], [], 0
    rows = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")),
                            F.col(f"`{text}`")).toLocalIterator()
    for item_id, body in rows:
        items.append((item_id, body))
        size += len((body or "").encode())
        if size >= block_bytes:
            blocks.append(sc.broadcast(items))
            items, size = [], 0
    if items or not blocks:
        blocks.append(sc.broadcast(items))
    return blocks


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
            item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns and MATCHES per document."""
    handles = item_blocks(benchmark, item, item_text, block_bytes)

    def many(texts: list[str | None]) -> list[tuple]:
        return match_texts(texts, handles, window)

    return map_batches(docs, [text], many, MATCHES, keep)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without any benchmark window, with their columns."""
    renamed, at, back = positional(docs)
    return matches(renamed, benchmark, at[text], keep=list(at.values())).filter("n_hit = 0").select(*back)
