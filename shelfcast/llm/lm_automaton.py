"""Language-model scoring with a weighted backoff automaton.

Model.  n-gram counts of the training texts, smoothed by hierarchical
Dirichlet priors: the word probability after a context mixes the context's
counts with ``strength`` pseudo-counts of the next shorter context; below the
shortest one stands the add-one-half unigram estimate.  As an automaton: a
state is a context seen in training; an arc leaves it for each n-gram seen,
weighing the log of the smoothed probability; its failure arc leads to the
next shorter context and weighs log(strength / (count + strength)).  A word is
read by following failure arcs until an arc for it exists; the next state is
the longest suffix of what was read that is a state.

The automaton grows with the corpus and is never in one place.  Texts are
packed into blocks of bounded size, written once in buckets.  Each block asks for the
totals of its distinct n-grams, in hash ranges; the owner of a range adds up
the blocks' own counts and answers every block.  Orders above 2 are asked for
one after the other, and only those n-grams whose two parts of one word less
both stand in another block too: the block's own count is the total of any
other, so nothing is lost by not asking.  With the answers a block
holds exactly the states and arcs that its texts can reach, and one
left-to-right traversal per text carries the state and sums the weights.
A block counts before it asks, so a frequent n-gram is one number per block.

n-grams are 64-bit hashes: two of a corpus's n-grams coincide with a chance of
about their number squared over 4e19.

Defined results: a null or empty text is the end token alone; words unknown to
the training texts have the unigram estimate for count 0; without training
texts every token's probability is 1; null ids are trained on; repeated rows
count and score each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfcast.llm.common import lower_words_of, saved
from shelfcast.session import materialize_by_key
from shelfcast.llm.packing import (ODD_A, ODD_C, mixed_hash, pack_keys, pack_numbers, unpack_keys,
                                   unpack_numbers)

ORDER = 3
STRENGTHS = {2: 200.0, 3: 20.0, 4: 10.0, 5: 10.0}
BLOCK_BYTES = 4 << 20       # text per block (one text at least)
BLOCKS_PER_RANGE = 4        # blocks' worth of n-grams that one hash range holds
_START, _END = xxhash.xxh64_intdigest(b"  "), xxhash.xxh64_intdigest(b" ")

BLOCKS = ("block long, doc_ids array<{id}>, held array<boolean>, n_docs int, train_docs long, "
          "train_tokens long, lengths binary, words binary, tokens binary")
SCORES = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _block_row(number: int, ids: pa.Array, texts: list, held: list[bool]) -> tuple:
    numbers: dict[bytes, int] = {}
    tokens, lengths = [], []
    for t in texts:
        words = lower_words_of(t)
        tokens.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint32, len(words)))
        lengths.append(len(words))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)
    # Frequent words get small numbers, which compress well.
    order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    train = [n + 1 for n, h in zip(lengths, held) if not h]
    return (number, ids.to_pylist(), held, len(texts), len(train), sum(train),
            pack_numbers(np.array(lengths, np.uint32)), hashes[order].tobytes(), pack_numbers(rank[flat]))


def blocks_of(docs: DataFrame, doc_id: str, text: str, held: Column, block_bytes: int) -> DataFrame:
    """The texts in blocks, written to the shared checkpoint folder."""
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
                      held.alias("held"))
    schema = StructType.fromDDL(BLOCKS.format(id=src.schema["doc_id"].dataType.simpleString()))
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            texts, marks = b.column(1).to_pylist(), b.column(2).to_pylist()
            first, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= block_bytes or i + 1 == len(texts):
                    row = _block_row(number, b.column(0).slice(first, i + 1 - first),
                                     texts[first:i + 1], marks[first:i + 1])
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, row))], schema=arrow)
                    number, first, size = number + 1, i + 1, 0

    # In buckets, so that the rounds below read them where they stand.
    return materialize_by_key(src.mapInArrow(pack, schema), "llm-lm-blocks", "block", "n_docs")


class BlockGrams:
    """A block's token sequence and the keys of its n-grams, per order.

    Each text stands as START, its words, END; ``keys[n]`` are the block's
    distinct n-grams of order n, sorted, ``at[n]`` the place in them of the
    n-gram that ends at each position (-1: reaches over the text's start).
    Order 1 covers START too, which is only ever a context."""

    def __init__(self, lengths: bytes, words: bytes, tokens: bytes, held: list[bool], order: int):
        self.lengths = unpack_numbers(lengths, np.uint32).astype(np.int64) + 1  # with END
        n_docs = len(self.lengths)
        first = np.concatenate([[0], np.cumsum(self.lengths + 1)])   # place of each START
        self.first, total = first[:-1], int(first[-1])
        table = np.frombuffer(words, np.uint64)
        hashes = np.empty(total, np.uint64)
        plain = np.ones(total, bool)
        plain[self.first] = False
        plain[first[1:] - 1] = False
        hashes[plain] = table[unpack_numbers(tokens, np.uint32)]
        hashes[self.first], hashes[first[1:] - 1] = np.uint64(_START), np.uint64(_END)
        depth = np.arange(total) - np.repeat(self.first, self.lengths + 1)
        held = np.repeat(np.array(held, bool), self.lengths + 1) if n_docs else np.zeros(0, bool)
        self.keys, self.at, self.counts, self.parts = {}, {}, {}, {}
        key = mixed_hash(hashes + ODD_A)
        for n in range(1, order + 1):
            if n > 1:  # the context's key, moved on by one, and this word
                before = np.concatenate([[np.uint64(0)], key[:-1]])
                key = mixed_hash(before * ODD_A + hashes * ODD_C + np.uint64(n))
            whole = np.flatnonzero(depth >= n - 1)
            distinct, inverse = np.unique(key[whole], return_inverse=True)
            place = np.full(total, -1, np.int64)
            place[whole] = inverse
            seen = np.bincount(inverse[~held[whole]], minlength=len(distinct))
            self.keys[n], self.at[n], self.counts[n] = distinct, place, seen.astype(np.uint32)
            if n > 2:  # an occurrence of each n-gram gives its two parts
                ends = np.empty(len(distinct), np.int64)
                ends[inverse] = whole
                self.parts[n] = self.at[n - 1][ends - 1], self.at[n - 1][ends]

    def asked(self, n: int, shared: np.ndarray | None) -> np.ndarray:
        """Which n-grams other blocks may hold: those whose parts both are
        ``shared``, held by another block."""
        if n <= 2:
            return np.ones(len(self.keys[n]), bool)
        return shared[self.parts[n][0]] & shared[self.parts[n][1]]

    def totals(self, replies: dict[int, tuple[np.ndarray, np.ndarray]], order: int) -> tuple[dict, np.ndarray | None]:
        """Totals of all orders from the answers to what was asked, and which
        n-grams of the last one are shared."""
        out, shared = {}, None
        for n in range(1, order + 1):
            ask = self.asked(n, shared)
            total, held_too = replies.get(n, (np.zeros(0, np.uint64), np.zeros(0, bool)))
            out[n], shared = self.counts[n].astype(np.uint64), np.zeros(len(ask), bool)
            out[n][ask], shared[ask] = total, held_too
        return out, shared


def _bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal hash ranges begins in sorted keys, and the end."""
    width = (1 << 64) // ranges + 1
    cuts = np.array([i * width for i in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])


REQUESTS = "gram int, bucket int, block long, keys binary, counts binary"


def _asking(grams: BlockGrams, block: int, n: int, ask: np.ndarray, ranges: int) -> list[tuple]:
    """A request per hash range with asked n-grams: keys and own counts."""
    keys, counts = grams.keys[n][ask], grams.counts[n][ask]
    cut = _bounds(keys, ranges)
    return [(n, i, block, pack_keys(keys[cut[i]:cut[i + 1]]), pack_numbers(counts[cut[i]:cut[i + 1]]))
            for i in np.flatnonzero(np.diff(cut)).tolist()]


def requests(blocks: DataFrame, order: int, ranges: int) -> DataFrame:
    """What every block asks for orders 1 and 2."""
    arrow = to_arrow_schema(StructType.fromDDL(REQUESTS))

    def ask(batches):
        for b in batches:
            for r in b.to_pylist():
                grams = BlockGrams(r["lengths"], r["words"], r["tokens"], r["held"], min(order, 2))
                rows = [row for n in range(1, min(order, 2) + 1)
                        for row in _asking(grams, r["block"], n, grams.asked(n, None), ranges)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    return blocks.select("block", "held", "lengths", "words", "tokens").mapInArrow(ask, REQUESTS)


def _replies(reply: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Answers to a block by order, in the order of its keys."""
    rows = sorted(zip(*(reply[c].to_pylist() for c in ("gram", "bucket", "totals", "shared"))), key=lambda r: r[:2])
    out = {}
    for n in {r[0] for r in rows}:
        totals = [unpack_numbers(t, np.uint64) for g, _, t, _ in rows if g == n]
        bits = [unpack_numbers(s, np.uint8) for g, _, _, s in rows if g == n]
        out[n] = (np.concatenate(totals), np.concatenate([np.unpackbits(s, count=len(t)).astype(bool)
                                                          for t, s in zip(totals, bits)]))
    return out


def further_requests(blocks: DataFrame, replies: DataFrame, n: int, ranges: int) -> DataFrame:
    """What every block asks for order ``n``, given the answers to the orders below."""
    arrow = to_arrow_schema(StructType.fromDDL(REQUESTS))

    def ask(block: pa.Table, reply: pa.Table) -> pa.Table:
        r = block.to_pylist()[0]
        grams = BlockGrams(r["lengths"], r["words"], r["tokens"], r["held"], n)
        known = _replies(reply)
        # Of order 2 every n-gram was asked for, so its answers stand alone.
        shared = known[2][1] if n == 3 else grams.totals(known, n - 1)[1]
        rows = _asking(grams, r["block"], n, grams.asked(n, shared), ranges)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, arrow.types)], schema=arrow)

    needed = replies.filter("gram = 2") if n == 3 else replies
    return (blocks.select("block", "held", "lengths", "words", "tokens").groupBy("block")
            .cogroup(needed.groupBy("block")).applyInArrow(ask, REQUESTS))


def answers(asked: DataFrame) -> DataFrame:
    """Per request the totals over all blocks, a bit per key for those that
    another block holds too, and the range's distinct unigrams seen in training
    (0 for other orders)."""
    schema = "gram int, bucket int, block long, totals binary, shared binary, distinct_words long"

    def add(group: pa.Table) -> pa.Table:
        keys = [unpack_keys(k) for k in group["keys"].to_pylist()]
        sizes = np.cumsum([len(k) for k in keys])[:-1]
        counts = np.concatenate([unpack_numbers(c, np.uint32) for c in group["counts"].to_pylist()])
        flat = np.concatenate(keys)
        del keys
        distinct, inverse = np.unique(flat, return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.uint64)
        gram = group["gram"][0].as_py()
        words = int(np.count_nonzero(total[distinct != mixed_hash(np.array([_START], np.uint64) + ODD_A)[0]])) if gram == 1 else 0
        mine = np.split(total[inverse], sizes)
        shared = np.split((np.bincount(inverse) > 1)[inverse], sizes)   # a block asks for a key once
        return pa.table({"gram": group["gram"], "bucket": group["bucket"], "block": group["block"],
                         "totals": pa.array([pack_numbers(m) for m in mine], pa.binary()),
                         "shared": pa.array([pack_numbers(np.packbits(s)) for s in shared], pa.binary()),
                         "distinct_words": pa.array([words] * len(mine), pa.int64())})

    return asked.groupBy("gram", "bucket").applyInArrow(add, schema)


def traverse(arcs: list[list], fails: list[list], reach: list[int], state: int) -> float:
    """One left-to-right pass over a text from a state of ``state`` words.

    ``arcs[k][i]``: weight of the arc for token i from the state of the k words
    before it (None: no such arc); ``fails[k][i]``: weight of that state's
    failure arc; ``reach[i]``: words of the longest state that ends at token i.
    """
    total = 0.0
    for i, longest in enumerate(reach):
        k = state
        weight = arcs[k][i]
        while weight is None:
            total += fails[k][i]
            k -= 1
            weight = arcs[k][i]
        total += weight
        state = longest
    return total


def _traverse_bigram(arc0: list, arc1: list, fail1: list, reach: list, state: int) -> float:
    """``traverse`` for order 2."""
    total = 0.0
    for low, high, fail, longest in zip(arc0, arc1, fail1, reach):
        if not state:
            total += low
        elif high is None:
            total += fail + low
        else:
            total += high
        state = longest
    return total


def score_block(grams: BlockGrams, totals: dict[int, np.ndarray], held: list[bool], order: int,
                strengths: dict[int, float], train_tokens: int, vocabulary: int) -> list[tuple]:
    """The fields of SCORES for each text of a block."""
    def count(n):
        c = np.append(totals[n], 0)  # place -1: no such n-gram
        return c[grams.at[n]].astype(float)

    size = count(1)
    p = (size + 0.5) / (train_tokens + 0.5 * (vocabulary + 1))
    base = np.log10(p)
    # START as a context was seen once per training text, a word as often as it stands.
    context, arcs, fails = size, [base.tolist()], [[]]
    reach = np.zeros(len(size), np.int64)
    for n in range(2, order + 1):
        s, c = strengths[n], count(n)
        before = np.concatenate([[0.0], context[:-1]])
        before[grams.first] = 0
        p = np.where(before > 0, (c + s * p) / (before + s), p)
        arc = np.log10(p).astype(object)
        arc[c <= 0] = None
        arcs.append(arc.tolist())
        fails.append(np.log10(s / (before + s)).tolist())
        reach = np.where(context > 0, n - 1, reach)
        context = c
    reach = reach.tolist()
    out = []
    for first, length, h in zip(grams.first.tolist(), grams.lengths.tolist(), held):
        part = slice(first + 1, first + 1 + length)
        if order == 2:
            score = _traverse_bigram(arcs[0][part], arcs[1][part], fails[1][part], reach[part], reach[first])
        else:
            score = traverse([a[part] for a in arcs], [f[part] if f else f for f in fails],
                             reach[part], reach[first])
        out.append((h, length, int(np.count_nonzero(size[part])), train_tokens,
                    float(base[part].sum()), float(score)))
    return out


def train_and_score(docs: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text",
                    order: int = ORDER, strengths: dict[int, float] | None = None,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Train on the rows for which ``held`` is false and score every row:
    ``doc_id`` and SCORES."""
    strengths = STRENGTHS | (strengths or {})
    blocks = blocks_of(docs, doc_id, text, held, block_bytes)
    seen = blocks.agg(F.count("*").alias("n"), F.sum("train_tokens").alias("tokens")).first()
    ranges = max(1, -(-seen["n"] // BLOCKS_PER_RANGE))
    replies = saved(answers(requests(blocks, order, ranges)), "lm-answers")
    for n in range(3, order + 1):
        more = saved(answers(further_requests(blocks, replies.drop("distinct_words"), n, ranges)), f"lm-answers-{n}")
        replies = replies.unionByName(more)
    per_range = replies.filter("gram = 1").groupBy("bucket").agg(F.max("distinct_words").alias("v"))
    vocabulary, train_tokens = per_range.agg(F.sum("v")).first()[0] or 0, seen["tokens"] or 0
    id_type = blocks.schema["doc_ids"].dataType.elementType
    schema = StructType().add("doc_id", id_type)
    for f in StructType.fromDDL(SCORES).fields:
        schema = schema.add(f)
    arrow = to_arrow_schema(schema)

    def score(block: pa.Table, reply: pa.Table) -> pa.Table:
        r = block.to_pylist()[0]
        grams = BlockGrams(r["lengths"], r["words"], r["tokens"], r["held"], order)
        totals = grams.totals(_replies(reply), order)[0]
        rows = score_block(grams, totals, r["held"], order, strengths, train_tokens, vocabulary)
        made = [r["doc_ids"], *zip(*rows)]
        return pa.table([pa.array(c, t) for c, t in zip(made, arrow.types)], schema=arrow)

    return (blocks.groupBy("block").cogroup(replies.drop("distinct_words").groupBy("block"))
            .applyInArrow(score, schema))
