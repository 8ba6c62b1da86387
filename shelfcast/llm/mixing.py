"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key.  Within its source, documents are
sorted by that key in ranges of equal width; a range's running word counts plus
the totals of the ranges before it are the distributed prefix sums.  A source
takes whole epochs of all its documents while its budget allows, then the
documents in key order up to exactly its budget, the last of them in part.

Targets: the sources, in code point order with null last, weigh by
``weights`` in turn and share the whole corpus; a source's target stops at
``max_repeats`` times its size, and the excess goes to the others by weight.
With the sources ordered by (cap / weight), those before some place are capped
and the rest share what is left, so one pass of running sums finds the targets.
That pass sorts one row per source.

Defined results: a null or empty text has size 0 and takes nothing; a null
source is a source; rows repeated in full take their places one after the
other; an empty table gives an empty table.  Reruns agree: keys depend on
``seed``, the id, the source and the text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import WORD, hash_fraction, positional, running_totals, saved

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows."""
    big = "decimal(38,0)"  # exact where a long would overflow
    x = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    x = x.withColumn("__place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    turn = (F.col("__place") % len(weights) + 1).cast("int")
    x = x.withColumn("__w", F.element_at(F.array(*[F.lit(w) for w in weights]), turn).cast(big))
    x = x.withColumn("__cap", (F.col("source_size") * max_repeats).cast(big))
    x = x.withColumn("__ratio", F.col("__cap").cast("double") / F.col("__w").cast("double"))
    whole = Window.orderBy("__ratio", "__place")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    onwards = whole.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = (x.withColumn("__left", F.sum("source_size").over(everything).cast(big)
                      - F.coalesce(F.sum("__cap").over(before), F.lit(0)).cast(big))
         .withColumn("__sharing", F.sum("__w").over(onwards).cast(big))
         .withColumn("__n", F.row_number().over(whole)))
    free = F.col("__left") * F.col("__w") <= F.col("__cap") * F.col("__sharing")
    # The first source under its cap fixes what it and each later one get.
    first = F.min(F.when(free, F.struct("__n", "__left", "__sharing"))).over(everything)
    x = x.withColumn("__first", first)
    share = (F.col("__first.__left").cast("double") * F.col("__w").cast("double")
             / F.col("__first.__sharing").cast("double"))
    target = F.when(F.col("__n") >= F.col("__first.__n"), share).otherwise(F.col("__cap").cast("double"))
    return x.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        seed: str = SEED, weights: tuple[int, ...] = WEIGHTS,
        max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken`` and ``mix_key`` per document."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = saved(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
        mix_key(doc_id, text, source, seed).alias("mix_key")), "mix-sizes")
    targets = source_targets(base, weights, max_repeats)
    placed = running_totals(base.withColumn("__f", hash_fraction(F.col("mix_key"))), ["source"],
                            ["__f", "mix_key"], "__f", "size", "__before").drop("__f")
    t = targets.select(F.col("source").alias("__s"), "source_size", "target")
    x = placed.join(t, placed["source"].eqNullSafe(t["__s"])).drop("__s")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    x = x.withColumn("__e", epochs.cast("long")).withColumn(
        "__rest", budget - F.col("__e") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - F.col("__before")))
    return x.withColumn("taken", (F.col("__e") * F.col("size") + part).cast("long")).select(
        "doc_id", "size", "source", "source_size", "target", "taken", "mix_key")


def mix_key(doc_id: str, text: str, source: str, seed: str) -> Column:
    """Hash-random key of a document: md5 of seed, id, source and the text's md5."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in (doc_id, source)]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return F.md5(F.concat_ws("|", F.lit(seed), *parts, F.md5(body.cast("binary"))).cast("binary"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          n_chars: str = "n_chars", seed: str = SEED, **settings) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document once per whole
    repeat that the mix takes, and once more with its first words, joined by
    single spaces, where the budget ends inside it.  ``n_chars``, if there is
    such a column, follows the text.

    Rows with the same id, source and text are one document here, whose words
    add up; of their other columns, those of any one of them stay."""
    taken = (mix(docs, doc_id, text, source, seed, **settings).groupBy("mix_key")
             .agg(F.max("size").alias("__size"), F.sum("taken").alias("__taken"))
             .filter("__taken > 0"))
    renamed, at, back = positional(docs)
    x = renamed.withColumn("mix_key", mix_key(at[doc_id], at[text], at[source], seed))
    x = x.dropDuplicates(["mix_key"]).join(taken, "mix_key")
    whole = F.floor(F.col("__taken") / F.col("__size"))
    rest = F.col("__taken") - whole * F.col("__size")
    x = x.withColumn("__copy", F.explode(F.sequence(F.lit(1), whole + F.when(rest > 0, 1).otherwise(0))))
    body = F.col(at[text])
    cut = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), 1, rest.cast("int")), " ")
    x = x.withColumn(at[text], F.when(F.col("__copy") <= whole, body).otherwise(cut))
    if n_chars in at:
        kind = dict(docs.dtypes)[n_chars]
        x = x.withColumn(at[n_chars], F.char_length(at[text]).cast(kind))
    return x.select(*back)


def oracle(doc_table: str = "documents") -> str:
    """DuckDB SQL for ``doc_id, size, source_size, target, taken`` of ``mix``."""
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '\\N') || '|' || coalesce(source, '\\N') || '|'
             || md5(coalesce(text, ''))) AS k
  FROM {doc_table}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CASE place % {len(WEIGHTS)} {weights} END AS w, {MAX_REPEATS} * source_size AS cap FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / w, place) AS n,
             CAST(sum(source_size) OVER () AS HUGEINT) AS total FROM w),
c AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
             sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing FROM o),
f AS (SELECT n AS n0, remains AS r0, sharing AS s0 FROM c WHERE remains * w <= cap * sharing ORDER BY n LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN n >= n0 THEN CAST(r0 AS DOUBLE) * CAST(w AS DOUBLE) / CAST(s0 AS DOUBLE)
             ELSE CAST(cap AS DOUBLE) END AS target FROM c LEFT JOIN f ON true),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
x AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM x"""
