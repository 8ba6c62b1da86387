"""Phrase collocation mining by set-oriented relational mining (SETM).

The relation of length k holds each occurrence of a frequent k-word phrase:
the place it begins at and the phrase.  Places number the words of a block of
texts in order with one place left free after each piece, so that the relation
is sorted by piece and position and two places one apart lie in one piece.
For every length the persisted relation is merge-joined with itself one
position on, which gives the occurrences of phrases one word longer whose two
halves are frequent; their groups are counted; and the joined relation is
semi-joined with the frequent groups before the next length.

Relations stand in blocks of bounded text, packed as sorted arrays; a piece
never leaves its block, so the merge join moves nothing.  What is shuffled is
one row per block and distinct phrase, with the block's own count: the rows of
a phrase that a third of all occurrences share are as many as there are blocks.
A phrase is known by the number of its first occurrence in a block's list, and
a longer one by the numbers of its two halves: no hashes, so counts are exact.

Every part of a frequent phrase is at least as frequent as it, so the frequent
phrases of the lengths below have all the counts that cuts need: phrase tables
carry, for each cut, the counts of what stands before and behind it.  For the
same reason a phrase lies in a longer candidate of a given share of its count
if and only if it does so in one that is one word longer.

Defined results: null texts are empty; a null language is ``und``, as is that
name itself; repeated rows count each; a language without candidates has no
rows; an empty table gives an empty one.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import dropped, saved
from shelfcast.llm.packing import pack_keys, pack_numbers, unpack_keys, unpack_numbers

LEAST, LONGEST, TOP = 30, 4, 2000
COVERED = 80                 # percent of a phrase's count in a longer one that drops it
FACTOR = 2_000_000
BLOCK_BYTES = 16 << 20       # text per block (one text at least); doubles every 1,024 blocks of a task
TOP_ROWS = 100_000           # rows of a language that one task ranks
_BLOCK_BITS, _LOCAL_BITS = 12, 31

#: A-Z to a-z, and the bytes that end a piece to line ends.
_TABLE = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))

FIRST = ("block long, places binary, grams binary, langs array<string>, lang_of array<int>, "
         "words array<string>, counts array<long>")
RELATION = "block long, places binary, grams binary, numbers binary"


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class _Block:
    """Occurrences of words, language by language numbered."""

    def __init__(self):
        self.words: dict[str, _Numbers] = {}
        self.runs: dict[str, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        self.next, self.bytes = 0, 0

    def add(self, lang: str, text: str) -> None:
        raw = text.encode("utf-8", "surrogatepass").translate(_TABLE)
        pieces = [p.split() for p in raw.split(b"\n")]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sizes = sizes[sizes > 0]
        total = int(sizes.sum())
        number = self.words.setdefault(lang, _Numbers()).__getitem__
        words = np.fromiter(map(number, chain.from_iterable(pieces)), np.int64, total)
        places = self.next + np.arange(total) + np.repeat(np.arange(len(sizes)), sizes)
        self.next += total + len(sizes)
        self.runs.setdefault(lang, []).append((places, words))
        self.bytes += len(raw)

    def row(self, block: int) -> tuple:
        langs, lang_of, words, counts, places, grams, before = list(self.words), [], [], [], [], [], 0
        for i, lang in enumerate(langs):
            p, w = (np.concatenate(c) for c in zip(*self.runs[lang]))
            lang_of += [i] * len(self.words[lang])
            words += self.words[lang]
            counts += np.bincount(w, minlength=len(self.words[lang])).tolist()
            places.append(p)
            grams.append(w + before)
            before = len(words)
        places, grams = np.concatenate(places), np.concatenate(grams)
        order = np.argsort(places, kind="stable")
        return (block, pack_keys(places[order].astype(np.uint64)), pack_numbers(grams[order].astype(np.uint32)),
                langs, lang_of, words, counts)


def first_relation(docs: DataFrame, text: str = "text", lang: str = "lang",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The relation of words, with each block's distinct words and counts, written."""
    src = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                      F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def batch(block: _Block, number: int) -> pa.RecordBatch:
        b, places, grams, langs, lang_of, words, counts = block.row(number)
        words = pa.array(words, pa.binary()).cast(pa.string())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in
                 (pa.array(langs, pa.string()), pa.array(lang_of, pa.int32()), words, pa.array(counts, pa.int64()))]
        return pa.RecordBatch.from_arrays(
            [pa.array([b], pa.int64()), pa.array([places], pa.binary()), pa.array([grams], pa.binary()), *lists],
            ["block", "places", "grams", "langs", "lang_of", "words", "counts"])

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, block = TaskContext.get().partitionId(), 0, _Block()
        for b in batches:
            for one, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                block.add(one, t)
                if block.bytes >= block_bytes << (made >> 10):
                    yield batch(block, (task << _BLOCK_BITS) | made)
                    made, block = made + 1, _Block()
        if block.words:
            yield batch(block, (task << _BLOCK_BITS) | made)

    return saved(src.mapInArrow(split, FIRST), "setm-words")


def merge_join(places: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a row of the sorted relation has another one place on: the place
    and the numbers of both."""
    met = np.flatnonzero(places[1:] - places[:-1] == 1)
    return places[met], grams[met], grams[met + 1]


def _extended(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined relation of a block: places, each row's place in the distinct
    groups, and the groups' halves (as the block numbers them) and counts; then
    the block's numbers."""
    numbers = unpack_numbers(row["numbers"], np.uint64)
    places, first, second = merge_join(unpack_keys(row["places"]), unpack_numbers(row["grams"], np.uint32))
    keys = first.astype(np.int64) * max(1, len(numbers)) + second
    groups, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return places, which, groups // max(1, len(numbers)), groups % max(1, len(numbers)), counts, numbers


def _gram(block: Column, local: Column) -> Column:
    """A number that only this place of this block's list has."""
    return F.shiftleft(block, _LOCAL_BITS) + local


def groups(relation: DataFrame) -> DataFrame:
    """``gram, first, second, n``: the distinct groups of every block one word
    longer than the relation's."""

    def count(batches):
        for b in batches:
            for row in b.to_pylist():
                _, _, first, second, counts, numbers = _extended(row)
                grams = (row["block"] << _LOCAL_BITS) + np.arange(len(counts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (grams, numbers[first].astype(np.int64),
                                                       numbers[second].astype(np.int64), counts)],
                    ["gram", "first", "second", "n"])

    return relation.mapInArrow(count, "gram long, first long, second long, n long")


def frequent(rows: DataFrame, keys: list[str], least: int, name: str) -> DataFrame:
    """The rows of groups that occur ``least`` times or more over all blocks,
    written: ``gram`` and the group's ``number``, the least of its rows' grams;
    the row of that gram also has the keys and the group's count ``f``."""
    group = Window.partitionBy(*keys)
    marked = rows.withColumns({"f": F.sum("n").over(group), "number": F.min("gram").over(group)})
    owner = F.col("gram") == F.col("number")
    return saved(marked.filter(F.col("f") >= least).select(
        "gram", "number", *[F.when(owner, F.col(c)).alias(c) for c in [*keys, "f"]]), name)


def semi_join(relation: DataFrame, found: DataFrame, first: bool, name: str) -> DataFrame:
    """The occurrences of frequent groups, written: of the words themselves if
    ``first``, else of the relation joined with itself."""

    def keep(blocks: pa.Table, found: pa.Table) -> pa.Table:
        rows = blocks.to_pylist()
        if not rows or not found.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in (
                "places", "grams", "numbers")}})
        local = found["gram"].to_numpy() & ((1 << _LOCAL_BITS) - 1)
        order = np.argsort(local)
        local, numbers = local[order], found["number"].to_numpy()[order]
        if first:
            places, which = unpack_keys(rows[0]["places"]), unpack_numbers(rows[0]["grams"], np.uint32).astype(np.int64)
        else:
            places, which = _extended(rows[0])[:2]
        at = np.searchsorted(local, which)
        at[at == len(local)] = 0
        kept = local[at] == which
        return pa.table({"block": pa.array([rows[0]["block"]], pa.int64()),
                         "places": pa.array([pack_keys(places[kept])], pa.binary()),
                         "grams": pa.array([pack_numbers(at[kept].astype(np.uint32))], pa.binary()),
                         "numbers": pa.array([pack_numbers(numbers.astype(np.uint64))], pa.binary())})

    columns = ["block", "places", "grams"] + ([] if first else ["numbers"])
    answers = found.select(F.shiftrightunsigned("gram", _LOCAL_BITS).alias("block"), "gram", "number")
    return saved(relation.select(*columns).groupBy("block").cogroup(answers.groupBy("block"))
                 .applyInArrow(keep, RELATION), name)


def _owners(found: DataFrame) -> DataFrame:
    return found.filter("gram = number")


def phrase_tables(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST,
                  longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """Per length the frequent phrases, ``number, lang, phrase, last, f, heads,
    tails`` (``heads[j]`` and ``tails[j]``: counts of the first j + 1 words and
    of the others) and, from length 2 on, the numbers ``first, second`` of the
    phrases that lack the last and the first word; and ``lang, n``."""
    relation = first_relation(docs, text, lang, block_bytes)
    zipped = F.posexplode(F.arrays_zip("words", "lang_of", "counts")).alias("local", "w")
    rows = relation.select("block", "langs", zipped).select(
        _gram(F.col("block"), F.col("local")).alias("gram"), F.element_at("langs", F.col("w.lang_of") + 1).alias("lang"),
        F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    totals = saved(rows.groupBy("lang").agg(F.sum("n").alias("n")), "setm-totals")
    found = frequent(rows, ["lang", "word"], least, "setm-frequent-1")
    none = F.array().cast("array<bigint>")
    tables = [saved(_owners(found).select(
        "number", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f",
        none.alias("heads"), none.alias("tails")), "setm-phrases-1")]
    for k in range(2, longest + 1):
        used, relation = (relation, found), semi_join(relation, found, k == 2, f"setm-relation-{k - 1}")
        dropped(*used)
        found = frequent(groups(relation), ["first", "second"], least, f"setm-frequent-{k}")
        below = tables[-1]
        head = below.select(F.col("number").alias("first"), "lang", F.col("phrase").alias("stem"),
                            F.col("f").alias("f1"), F.col("heads").alias("h"))
        tail = below.select(F.col("number").alias("second"), "last", F.col("f").alias("f2"), F.col("tails").alias("t"))
        tables.append(saved(
            _owners(found).select("number", "first", "second", "f").join(head, "first").join(tail, "second").select(
                "number", "first", "second", "lang", F.concat_ws(" ", "stem", "last").alias("phrase"), "last", "f",
                F.concat("h", F.array("f1")).alias("heads"), F.concat(F.array("f2"), "t").alias("tails")),
            f"setm-phrases-{k}"))
    dropped(relation, found)
    return tables, totals


def candidates(tables: list[DataFrame], covered: int = COVERED) -> DataFrame:
    """Phrases of two words and more that no longer candidate covers, with the
    lowest-scoring cut: ``lang, phrase, a, l, r, score``."""
    out = None
    for k, table in enumerate(tables[1:], 1):
        kept = table
        if k + 1 < len(tables):
            longer = tables[k + 1]
            around = (longer.select(F.col("first").alias("number"), "f").union(longer.select("second", "f"))
                      .groupBy("number").agg(F.max("f").alias("most")))
            kept = table.join(around, "number", "left").filter(
                F.coalesce(F.col("most") * 100 < F.col("f") * covered, F.lit(True)))
        # The first of the least scores: structs compare score, then cut.
        cuts = F.transform(F.arrays_zip("heads", "tails"), lambda c, j: F.struct(
            _score(F.col("f"), c["heads"] + c["tails"]).alias("score"), j.alias("cut"),
            c["heads"].alias("l"), c["tails"].alias("r")))
        one = kept.select("lang", "phrase", F.col("f").alias("a"), F.array_min(cuts).alias("cut")).select(
            "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        out = one if out is None else out.unionByName(one)
    return out


def _score(a: Column, both: Column) -> Column:
    """floor(FACTOR * a / both), exact: the product has up to 28 digits.  The
    remainder is taken off first, so that the division is without rest."""
    product = a.cast("decimal(20,0)") * F.lit(FACTOR).cast("decimal(8,0)")
    whole = product - product % both.cast("decimal(20,0)")
    return F.round(whole / both.cast("decimal(20,0)"), 0).cast("long")


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language, ``rank`` from 1.  While a language
    has many rows, each task ranks a share of them by hash and all but a
    share's first go; then one task per language ranks what is left."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = saved(found, "setm-candidates")
    while True:
        most = found.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
        shares = -(-most // TOP_ROWS)
        if shares <= 1:
            break
        share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
        w = Window.partitionBy("lang", "share").orderBy(*order)
        found = saved(found.withColumn("share", share).withColumn("at", F.row_number().over(w))
                      .filter(F.col("at") <= top).drop("share", "at"), "setm-best")
        if shares * top >= most:
            break
    w = Window.partitionBy("lang").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
                 top: int = TOP, covered: int = COVERED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases of each language."""
    tables, totals = phrase_tables(docs, text, lang, least, longest, block_bytes)
    return best(candidates(tables, covered), top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, w[i:i+{k - 1}] AS g FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i "
        f"FROM words WHERE len(w) >= {k})" for k in range(1, LONGEST + 1))
    return f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM texts),
words AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
f AS (SELECT lang, k, g, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT c.lang, c.k, c.g, c.a, j, x.a AS l, y.a AS r,
         (({FACTOR}::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.j]
  JOIN f y ON y.lang = c.lang AND y.g = c.g[c.j + 1:c.k]),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inner_parts AS (
  SELECT lang, a, g[i:i + m - 1] AS part FROM (
    SELECT *, unnest(range(1, k - m + 2)) AS i FROM (
      SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2))),
around AS (SELECT lang, part, max(a) AS most FROM inner_parts GROUP BY lang, part),
kept AS (
  SELECT c.lang, array_to_string(c.g, ' ') AS phrase, c.a, c.l, c.r, c.score
  FROM least c LEFT JOIN around o ON o.lang = c.lang AND o.part = c.g
  WHERE o.most IS NULL OR 100 * o.most < {COVERED} * c.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank,
       k.phrase, k.a, k.l, k.r, t.n, k.score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= {TOP}
"""
