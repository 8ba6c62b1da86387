"""n-gram Jaccard join by prefix trees.

A text's set holds the hashes of its distinct word n-grams.  Two texts link
when their sets' Jaccard similarity reaches ``percent``.

1. Texts with equal word sequences collapse into one node.
2. Blocking that loses no link (prefix filter): in one global order of the
   n-grams, rarest first, two sets that link share an n-gram among the first
   ``n - ceil(t n) + 1`` of each.  Texts are packed into blocks of bounded size;
   a block asks the owners of hash ranges in how many texts its n-grams stand,
   and the answers order its sets.  An n-gram of one text only is shared with
   nobody, so a text that is mostly its own has no signature at all, and common
   passages are none unless a text consists of them.  A block sends each
   signature once, with one text, so a frequent one costs a number per block.
3. Nodes that share a signature, directly or through others, form a family.
   A family's sets, in one global order (most frequent n-gram first), go into
   a prefix tree.  A set is looked up by walking down the tree: the overlap
   with a path is shared by all sets below it, and a subtree is left when even
   the longest possible rest cannot reach the threshold.
4. Links unite into components.  Looking up a set only has to find sets that
   are not yet in its component; subtrees without any are left too.

A family too large for one task is cut into blocks by hash.  Each block is
joined together with the family's first set; whatever that does not reach
(strays) is then looked up in the other blocks, in portions.  No link is lost.

Nodes and n-grams are 64-bit hashes: two of N different ones coincide with a
chance of about N*N/4e19.

Equal sets of different word sequences link like any others.

Defined results: a null text or one without words has an empty set, links with
nothing and is its own component; fewer words than n make one n-gram; null ids
take part, and a component's id is its least non-null id (null if there is
none); repeated rows share a node; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfcast.llm.common import lower_words_of, positional, saved
from shelfcast.llm.components import components
from shelfcast.llm.packing import ODD_A, mixed_hash, pack_keys, pack_numbers, unpack_keys, unpack_numbers

WIDTH = 3
PERCENT = 90
BLOCK_BYTES = 4 << 20          # text per block (one text at least)
BLOCKS_PER_RANGE = 4           # blocks' worth of n-grams that one hash range holds
BLOCK_SHINGLES = 1_500_000     # n-grams of the sets that one join task holds, about


def shingle_sets(texts: list[list[bytes]], width: int = WIDTH) -> list[np.ndarray]:
    """The sets of texts given as words: sorted distinct 64-bit n-gram hashes."""
    numbers: dict[bytes, int] = {}
    flat = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
            for words in texts]
    table = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
    out = []
    for words in flat:
        h = table[words]
        w = min(width, len(h))
        key = np.full(len(h) - w + 1 if w else 0, w, np.uint64)
        for i in range(w):
            key = mixed_hash(key * ODD_A + h[i:i + len(key)])
        out.append(np.unique(key))
    return out


def prefix_length(n: int, percent: int) -> int:
    """How many of a set's first n-grams hold one of every set it links with."""
    return n - -(-percent * n // 100) + 1


TEXTS = ("kind int, uid long, doc_id {id}, text_hash long, node long, first boolean, "
         "block long, rows binary, body binary")


def prepare(docs: DataFrame, doc_id: str, text: str, block_bytes: int) -> DataFrame:
    """One pass over the texts, written to the shared checkpoint folder: rows of
    kind 0 are the documents, ``first`` where a batch has their word sequence
    for the first time; rows of kind 1 are blocks of such texts, as words joined
    by spaces, with their places counted from the block's number, a uid."""
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
                      F.xxhash64(F.col(f"`{text}`").cast("string")).alias("text_hash"))
    schema = StructType.fromDDL(TEXTS.format(id=src.schema["doc_id"].dataType.simpleString()))
    arrow = to_arrow_schema(schema)

    def pass_over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            nodes, first, bodies, rows, size, blocks = [], [], [], [], 0, []
            known: set[int] = set()
            for i, t in enumerate(batch.column(1).to_pylist()):
                body = b" ".join(lower_words_of(t))
                node = xxhash.xxh3_64_intdigest(body) - (1 << 63) if body else None
                nodes.append(node)
                first.append(node is not None and node not in known)
                if first[-1]:
                    known.add(node)
                    rows.append(i)
                    bodies.append(body)
                    size += len(body)
                if bodies and (size >= block_bytes or i + 1 == batch.num_rows):
                    blocks.append((uid + rows[0], pack_numbers(np.array(rows, np.uint32) - np.uint32(rows[0])),
                                   zstandard.ZstdCompressor(level=1).compress(b"\n".join(bodies))))
                    bodies, rows, size = [], [], 0
            n = batch.num_rows
            if bodies:
                blocks.append((uid + rows[0], pack_numbers(np.array(rows, np.uint32) - np.uint32(rows[0])),
                               zstandard.ZstdCompressor(level=1).compress(b"\n".join(bodies))))
            yield _table(arrow, n, kind=[0] * n, uid=range(uid, uid + n), doc_id=batch.column(0),
                         text_hash=batch.column(2), node=nodes, first=first)
            for block, places, body in blocks:
                yield _table(arrow, 1, kind=[1], block=[block], rows=[places], body=[body])
            uid += n

    return saved(src.mapInArrow(pass_over, schema), "join-texts")


def _table(schema: pa.Schema, n_rows: int, /, **columns) -> pa.RecordBatch:
    """A batch of ``n_rows``; fields without a column are null."""
    return pa.RecordBatch.from_arrays(
        [columns[f.name].cast(f.type) if isinstance(columns.get(f.name), pa.Array)
         else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n_rows, f.type)
         for f in schema], schema=schema)


class BlockSets:
    """A block's sets and their distinct n-grams: ``keys``, sorted, ``texts``, in
    how many of its texts each stands, ``at``, each set's places in ``keys``."""

    def __init__(self, rows: bytes, body: bytes, width: int):
        self.rows = unpack_numbers(rows, np.uint32)
        self.bodies = zstandard.ZstdDecompressor().decompress(body).split(b"\n")
        self.sets = shingle_sets([b.split(b" ") for b in self.bodies], width)
        self.keys, at, self.texts = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        self.at = np.split(at, np.cumsum([len(x) for x in self.sets])[:-1])


def _range_cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal hash ranges begins in sorted keys, and the end."""
    span = (1 << 64) // ranges + 1
    inner = np.searchsorted(keys, np.array([x * span for x in range(1, ranges)], np.uint64))
    return np.concatenate([[0], inner, [len(keys)]])


def text_counts(blocks: DataFrame, width: int, ranges: int) -> DataFrame:
    """``block, bucket, totals``: in how many texts of all blocks the block's
    n-grams of a hash range stand."""
    schema = StructType.fromDDL("bucket int, block long, keys binary, texts binary")
    arrow = to_arrow_schema(schema)

    def ask(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = BlockSets(r["rows"], r["body"], width)
                cut = _range_cuts(b.keys, ranges)
                some = [i for i in range(ranges) if cut[i] < cut[i + 1]]
                yield _table(arrow, len(some), bucket=some, block=[r["block"]] * len(some),
                             keys=[pack_keys(b.keys[cut[i]:cut[i + 1]]) for i in some],
                             texts=[pack_numbers(b.texts[cut[i]:cut[i + 1]].astype(np.uint32)) for i in some])

    def add(group: pa.Table) -> pa.Table:
        keys = [unpack_keys(k) for k in group["keys"].to_pylist()]
        sizes = np.cumsum([len(k) for k in keys])[:-1]
        texts = np.concatenate([unpack_numbers(c, np.uint32) for c in group["texts"].to_pylist()])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=texts, minlength=len(distinct)).astype(np.uint32)
        return pa.table({"bucket": group["bucket"], "block": group["block"], "totals": pa.array(
            [pack_numbers(t) for t in np.split(total[inverse], sizes)], pa.binary())})

    asked = blocks.select("block", "rows", "body").mapInArrow(ask, schema)
    return saved(asked.groupBy("bucket").applyInArrow(add, "bucket int, block long, totals binary"), "join-counts")


SIGNED = "kind int, uid long, n long, body binary, bucket int, signs binary, rows binary, a long, b long"


def signed(blocks: DataFrame, counts: DataFrame, width: int, percent: int, ranges: int) -> DataFrame:
    """Rows of kind 0: the blocks' texts, their set size and, if they have a
    signature, the text; of kind 1: signatures by bucket with the rows they are
    from, counted from ``uid``; of kind 2: edges between rows of a block that
    share a signature."""
    arrow = to_arrow_schema(StructType.fromDDL(SIGNED))

    def sign(block: pa.Table, reply: pa.Table) -> pa.Table:
        r = block.to_pylist()[0]
        b, base = BlockSets(r["rows"], r["body"], width), r["block"]
        parts = sorted(zip(reply["bucket"].to_pylist(), reply["totals"].to_pylist()))
        totals = np.concatenate([unpack_numbers(t, np.uint32) for _, t in parts])
        signs, owners, bodies = [], [], []
        for row, s, at, body in zip(b.rows, b.sets, b.at, b.bodies):
            texts = totals[at]
            p = prefix_length(len(s), percent)
            own = int(np.count_nonzero(texts == 1))
            if own >= p:
                bodies.append(None)
                continue
            order = np.lexsort((s, texts))[own:p]  # beyond those of this text only
            signs.append(s[order])
            owners.append(np.full(len(order), row, np.uint32))
            bodies.append(zstandard.ZstdCompressor(level=1).compress(body))
        out = [_table(arrow, len(bodies), kind=[0] * len(bodies), uid=base + b.rows.astype(np.int64),
                      n=[len(s) for s in b.sets], body=bodies)]
        if signs:
            a, c, sign_, row = shared(np.concatenate(signs), np.concatenate(owners))
            if len(a):
                out.append(_table(arrow, len(a), kind=[2] * len(a), a=base + a.astype(np.int64),
                                  b=base + c.astype(np.int64)))
            cut = _range_cuts(sign_, ranges)
            some = [i for i in range(ranges) if cut[i] < cut[i + 1]]
            out.append(_table(arrow, len(some), kind=[1] * len(some), uid=[base] * len(some), bucket=some,
                              signs=[pack_keys(sign_[cut[i]:cut[i + 1]]) for i in some],
                              rows=[pack_numbers(row[cut[i]:cut[i + 1]]) for i in some]))
        return pa.Table.from_batches(out)

    joined = (blocks.select("block", "rows", "body").groupBy("block").cogroup(counts.groupBy("block"))
              .applyInArrow(sign, SIGNED))
    return saved(joined, "join-signed")


def shared(sign: np.ndarray, row: np.ndarray) -> tuple:
    """Edges (a, b) between each signature's rows and the least of them, once
    each, and the signatures, sorted, each with that least row."""
    order = np.lexsort((row, sign))
    sign, row = sign[order], row[order]
    new = np.ones(len(sign), bool)
    new[1:] = sign[1:] != sign[:-1]
    least = row[new][np.cumsum(new) - 1]
    differs = row != least
    pairs = np.unique(np.stack([row[differs], least[differs]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1], sign[new], row[new]


def candidate_edges(signs: DataFrame, node: DataFrame) -> DataFrame:
    """``a, b``: edges that connect all nodes with a common signature; ``node``
    has ``uid, node`` of the signed rows."""

    def meet(group: pa.Table) -> pa.Table:
        found = [unpack_keys(x) for x in group["signs"].to_pylist()]
        rows = [unpack_numbers(x, np.uint32).astype(np.int64) + base
                for x, base in zip(group["rows"].to_pylist(), group["uid"].to_pylist())]
        a, b, _, _ = shared(np.concatenate(found), np.concatenate(rows))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    across = (signs.filter("kind = 1").select("bucket", "uid", "signs", "rows")
              .groupBy("bucket").applyInArrow(meet, "a long, b long"))
    rows = signs.filter("kind = 2").select("a", "b").union(across).distinct()
    return (rows.join(node.select(F.col("uid").alias("a"), F.col("node").alias("na")), "a")
            .join(node.select(F.col("uid").alias("b"), F.col("node").alias("nb")), "b")
            .select(F.col("na").alias("a"), F.col("nb").alias("b")).filter("a != b"))


class PrefixTree:
    """Path-compressed prefix tree of sets given as sorted arrays of ranks."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.ranks = int(max((int(s[-1]) for s in sets), default=-1)) + 1
        self.tokens: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.last, self.depth, self.parent = [-1], [0], [-1]
        self.children: list[list[int]] = [[]]
        self.ends: list[list[int]] = [[]]
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i4").tobytes())
        path, before = [0], np.zeros(0, np.int32)
        for i in order:
            s = sets[i]
            m = min(len(s), len(before))
            unequal = np.flatnonzero(s[:m] != before[:m])
            common = int(unequal[0]) if len(unequal) else m
            while self.depth[path[-1]] > common:
                leaf = path.pop()
                if self.depth[path[-1]] < common:  # cut the edge in two
                    path.append(self._cut(leaf, common))
            node = path[-1]
            if common < len(s):
                node = self._new(node, s[common:])
                path.append(node)
            self.ends[node].append(i)
            before = s
        self._number()
        self.mark = np.zeros(self.ranks, bool)

    def _number(self) -> None:
        """Number the nodes in preorder, sum up what lies below each, and deal
        them to slabs by the depth at which their edges begin."""
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(reversed(self.children[node]))
        new = np.empty(len(order), np.int64)
        new[order] = np.arange(len(order))
        self.children = [[int(new[c]) for c in self.children[x]] for x in order]
        self.ends = [self.ends[x] for x in order]
        self.parent = [int(new[self.parent[x]]) if x else -1 for x in order]
        self.tokens = [self.tokens[x] for x in order]
        self.last = np.array([self.last[x] for x in order])
        self.depth = np.array([self.depth[x] for x in order])
        n = len(order)
        self.least, self.most = np.full(n, 1 << 60), np.zeros(n, np.int64)
        self.open, self.end = np.zeros(n, np.int64), np.arange(1, n + 1)
        self.home = {}
        for node in range(n - 1, -1, -1):  # children come after their parent
            for i in self.ends[node]:
                self.home[i] = node
            if self.ends[node]:
                self.least[node] = min(self.least[node], self.depth[node])
                self.most[node] = max(self.most[node], self.depth[node])
                self.open[node] += len(self.ends[node])
            up = self.parent[node]
            if up >= 0:
                self.least[up] = min(self.least[up], self.least[node])
                self.most[up] = max(self.most[up], self.most[node])
                self.open[up] += self.open[node]
                self.end[up] = max(self.end[up], self.end[node])
        self.slabs = [_Slab(self, x) for x in self._dealt()] if n >= SLAB_NODES else None

    def _dealt(self) -> list[np.ndarray]:
        begin = self.depth - np.array([len(t) for t in self.tokens])
        slab = np.searchsorted(int(self.depth.max()) * np.array(SLABS), begin, side="right")
        slab[0] = -1  # the root has no edge
        self.slab_of = slab
        return [x for x in (np.flatnonzero(slab == k) for k in range(len(SLABS) + 1)) if len(x)]

    def _new(self, parent: int, tokens: np.ndarray) -> int:
        node = len(self.tokens)
        self.tokens.append(tokens)
        self.last.append(int(tokens[-1]))
        self.depth.append(self.depth[parent] + len(tokens))
        self.parent.append(parent)
        self.children.append([])
        self.ends.append([])
        self.children[parent].append(node)
        return node

    def _cut(self, node: int, depth: int) -> int:
        """A new node at ``depth`` on the edge into ``node``."""
        parent = self.parent[node]
        head = depth - self.depth[parent]
        self.children[parent].remove(node)
        upper = self._new(parent, self.tokens[node][:head])
        self.tokens[node] = self.tokens[node][head:]
        self.parent[node] = upper
        self.children[upper].append(node)
        return upper

    def close(self, i: int) -> None:
        """Set ``i`` need not be found any more."""
        node = self.home[i]
        while node >= 0:
            self.open[node] -= 1
            node = self.parent[node]

    def find(self, s: np.ndarray, closed: np.ndarray | None = None) -> list[int]:
        """The sets that link with ``s`` (ranks), without the closed ones."""
        if closed is not None and not self.open[0]:
            return []
        inside = s[s < self.ranks]
        self.mark[inside] = True
        found = self._walk(s, closed) if self.slabs is None else self._sweep(s, closed)
        self.mark[inside] = False
        return found

    def _walk(self, s: np.ndarray, closed: np.ndarray | None) -> list[int]:
        """Down the tree node by node."""
        t, size, found = self.percent, len(s), []
        stack = [(c, 0) for c in self.children[0]]
        while stack:
            node, overlap = stack.pop()
            if closed is not None and not self.open[node]:
                continue
            overlap += int(np.count_nonzero(self.mark[self.tokens[node]]))
            depth = int(self.depth[node])
            # Of the sets below, the likeliest is as long as the rest of s allows.
            rest = size - int(np.searchsorted(s, self.last[node], side="right"))
            n = min(max(depth + rest, int(self.least[node])), int(self.most[node]))
            if (100 + t) * (overlap + min(rest, n - depth)) < t * (size + n):
                continue
            if (100 + t) * overlap >= t * (size + depth):
                found += [i for i in self.ends[node] if closed is None or not closed[i]]
            stack.extend((c, overlap) for c in self.children[node])
        return found

    def _sweep(self, s: np.ndarray, closed: np.ndarray | None) -> list[int]:
        """The same for a large tree: all living nodes of a slab at once, from
        the root's slab down; subtrees beyond the bound die before the next."""
        t, size, found = self.percent, len(s), []
        alive = np.ones(len(self.parent), bool) if closed is None else self.open > 0
        path = np.zeros(len(self.parent), np.int64)  # overlap with the path to each node
        for slab in self.slabs:
            living = alive[slab.nodes]
            if not living.any():
                continue
            path[slab.nodes] = path[slab.base] + slab.path_hits(self.mark, living)
            nodes = slab.nodes[living]
            depth, overlap = self.depth[nodes], path[nodes]
            rest = size - np.searchsorted(s, self.last[nodes], side="right")
            n = np.minimum(np.maximum(depth + rest, self.least[nodes]), self.most[nodes])
            dies = (100 + t) * (overlap + np.minimum(rest, n - depth)) < t * (size + n)
            for node in nodes[~dies & slab.has_ends[living] & ((100 + t) * overlap >= t * (size + depth))]:
                found += [i for i in self.ends[node] if closed is None or not closed[i]]
            if dies.any():
                step = np.zeros(len(alive) + 1, np.int64)
                step[nodes[dies]] += 1
                np.subtract.at(step, self.end[nodes[dies]], 1)
                alive &= np.cumsum(step[:-1]) == 0
        return found


SLAB_NODES = 64              # nodes from which a tree is swept by slabs
SLABS = (0.05, 0.15, 0.35, 0.65)  # where slabs begin, as shares of the greatest depth


class _Slab:
    """The nodes of a tree whose edges begin in one range of depths."""

    def __init__(self, tree: PrefixTree, nodes: np.ndarray):
        self.nodes = nodes
        self.has_ends = np.array([bool(tree.ends[x]) for x in nodes])
        number = tree.slab_of[nodes[0]]
        base = {}
        for x in nodes.tolist():  # the nearest node above that is in an earlier slab
            up = tree.parent[x]
            base[x] = up if tree.slab_of[up] < number else base[up]
        self.base = np.array([base[x] for x in nodes.tolist()])
        self.tokens = np.concatenate([tree.tokens[x] for x in nodes])
        self.lengths = np.array([len(tree.tokens[x]) for x in nodes])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        # A walk around the slab's part of the tree: into a node, out of it
        # after all below it.  Running sums of what is entered and left are the
        # sums along paths.
        n = len(nodes)
        walk = np.argsort(np.concatenate([2 * nodes, 2 * tree.end[nodes] - 1]), kind="stable")
        self.who, self.sign = walk % n, np.where(walk < n, 1, -1)
        self.enters = np.empty(n, np.int64)
        into = np.flatnonzero(walk < n)
        self.enters[walk[into]] = into

    def path_hits(self, mark: np.ndarray, living: np.ndarray) -> np.ndarray:
        """Per node the marked tokens on its path inside the slab, dead nodes
        counting none."""
        if living.mean() > 0.3:
            hits = np.add.reduceat(mark[self.tokens].astype(np.int64), self.starts)
        else:
            lengths, starts = self.lengths[living], self.starts[living]
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            at = np.repeat(starts - begin, lengths) + np.arange(int(lengths.sum()))
            hits = np.zeros(len(living), np.int64)
            hits[living] = np.add.reduceat(mark[self.tokens[at]].astype(np.int64), begin)
        return np.cumsum(self.sign * hits[self.who])[self.enters]


def ranked(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets over one global order: most frequent element first, then by hash."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    distinct, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((distinct, -counts))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(x) for x in np.split(rank[inverse], cuts)]


def link_components(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each of the hash sets the least index of its component."""
    order = ranked(sets)
    tree = PrefixTree(order, percent)
    closed, root = np.zeros(len(sets), bool), list(range(len(sets)))
    for i in range(len(sets)):
        if closed[i]:
            continue
        closed[i] = True
        tree.close(i)
        todo = [i]
        while todo:
            for j in tree.find(order[todo.pop()], closed):
                closed[j], root[j] = True, i
                tree.close(j)
                todo.append(j)
    return root


def _sets_of(bodies: list[bytes], width: int) -> list[np.ndarray]:
    grow = zstandard.ZstdDecompressor().decompress
    return shingle_sets([grow(b).split(b" ") for b in bodies], width)


def linked_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                      percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document; ``component``, the
    component's node (null: empty set), and ``text_hash``, a hash of the text."""
    texts = prepare(docs, doc_id, text, block_bytes)
    nodes = texts.filter("kind = 0").select("uid", "doc_id", "text_hash", "node", "first")
    packed = texts.filter("kind = 1")
    ranges = max(1, -(-packed.count() // BLOCKS_PER_RANGE))
    signs = signed(packed, text_counts(packed, width, ranges), width, percent, ranges)
    first = nodes.filter("first").select("uid", "node")
    family = components(candidate_edges(signs, first), "join-candidates")
    # The least node of a family is its name; it has no row of its own there.
    member = family.select("node", F.col("root").alias("family")).union(
        family.select("root", "root").distinct())
    own = signs.filter("kind = 0").select("uid", "n", "body")
    sizes = saved(first.join(own.select("uid", "n"), "uid").groupBy("node").agg(
        F.min("uid").alias("uid"), F.max("n").alias("n")), "join-sizes")
    member = saved(member.join(sizes, "node"), "join-members")
    blocks = member.groupBy("family").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    member = member.join(blocks, "family").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    member = saved(member.join(own.select("uid", "body").filter("body is not null"), "uid").select(
        "family", "blocks", "block", "node", "body"), "join-bodies")

    # The family's first set joins every block, where there are several.
    hubs = (member.filter("blocks > 1 and node = family")
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    every = member.filter("not (blocks > 1 and node = family)").unionByName(hubs)

    def join_block(group: pa.Table) -> pa.Table:
        name, several = group["family"][0].as_py(), group["blocks"][0].as_py() > 1
        rows = sorted(zip(group["node"].to_pylist(), group["body"].to_pylist()))
        ids = [r[0] for r in rows]
        root = link_components(_sets_of([r[1] for r in rows], width), percent)
        reached = root[ids.index(name)] if several else None
        return pa.table({
            "family": pa.array([name] * len(ids), pa.int64()),
            "block": pa.array([group["block"][0].as_py()] * len(ids), pa.int32()),
            "node": pa.array(ids, pa.int64()), "root": pa.array([ids[r] for r in root], pa.int64()),
            "stray": pa.array([several and r != reached for r in root])})

    local = saved(every.groupBy("family", "block").applyInArrow(
        join_block, "family long, block int, node long, root long, stray boolean"), "join-local")
    links = local.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if local.filter("stray").limit(1).count():
        links = links.union(_stray_links(local, member, width, percent, block_shingles))
    roots = components(links, "join-links")

    least = nodes.groupBy("node").agg(F.min("doc_id").alias("least")).filter("node is not null")
    least = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = saved(least, "join-least")
    named = named.select("node", "root").join(
        named.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    named = named.join(sizes.select("node", "n"), "node")
    return nodes.join(named, "node", "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("root").alias("component"), "text_hash")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One document of each component, with the columns of ``docs``: the one
    with the least non-null id, and of several rows with that id any one of
    those whose text hashes least.  Documents with empty sets all stay."""
    judged = linked_components(docs, doc_id, text, **settings).filter("n_shingles > 0")
    chosen = judged.groupBy("component").agg(
        F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash")).alias("c"))
    key = lambda c: F.coalesce(c.cast("string"), F.lit("\\N"))
    chosen = chosen.select(key(F.col("c.doc_id")).alias("__id"), F.col("c.text_hash").alias("__hash"))
    renamed, at, back = positional(docs)
    body = F.col(at[text]).cast("string")
    has_words = F.coalesce(body.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rest = (renamed.filter(has_words).withColumn("__id", key(F.col(at[doc_id])))
            .withColumn("__hash", F.xxhash64(body)).dropDuplicates(["__id", "__hash"]))
    kept = rest.join(chosen, ["__id", "__hash"], "left_semi").select(*back)
    return kept.unionByName(renamed.filter(~has_words).select(*back))


def _stray_links(local: DataFrame, member: DataFrame, width: int, percent: int, block_shingles: int) -> DataFrame:
    """Links of strays with sets of their family's other blocks, one per stray
    and component of a block."""
    strays = local.filter("stray").select("family", F.col("block").alias("from"), "node")
    asking = strays.join(member.select("family", "node", "blocks", "body"), ["family", "node"])
    portions = F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("body")) / block_shingles)).cast("int")
    asking = asking.join(asking.groupBy("family").agg(portions.alias("portions")), "family")
    asking = (asking.withColumn("portion", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("portions")).cast("int"))
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .filter("block != from"))
    keys = asking.select("family", "block", "portion").distinct()
    asked = member.select("family", "block", "node", "body").join(keys, ["family", "block"])
    asked = saved(asked.join(local.select("family", "node", "block", "root"), ["family", "node", "block"]),
                  "join-asked")

    def look_up(asking: pa.Table, asked: pa.Table) -> pa.Table:
        n = asking.num_rows
        order = ranked(_sets_of(asking["body"].to_pylist() + asked["body"].to_pylist(), width))
        tree = PrefixTree(order[n:], percent)
        names, roots = asking["node"].to_pylist(), asked["root"].to_pylist()
        pairs = {(names[i], roots[j]) for i in range(n) for j in tree.find(order[i])}
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()),
                         "b": pa.array([p[1] for p in pairs], pa.int64())})

    by = ["family", "block", "portion"]
    return (asking.select(*by, "node", "body").groupBy(*by)
            .cogroup(asked.select(*by, "root", "body").groupBy(*by)).applyInArrow(look_up, "a long, b long"))
