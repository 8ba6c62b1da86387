"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfcast.session import materialize

#: White space of the words `[^\x20\x09-\x0D]+`: what bytes.split() splits on.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts lineage."""
    return materialize(df, f"llm-{name}")


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` gave, once all that reads them is written."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


BROADCAST_ROWS = 100_000


def if_small(df: DataFrame) -> DataFrame:
    """Mark a saved table for broadcast if it counts few rows; the join
    shuffles otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def id_fold(doc_id: Column, n: int) -> Column:
    """crc32(id as text) mod n; null ids have no fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def held_out(doc_id: Column, n: int, remainder: int) -> Column:
    return F.coalesce(id_fold(doc_id, n) == remainder, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """White-space words as UTF-8 bytes, letters as they are."""
    return text.encode().split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """As ``words_of``, A-Z lower-cased (bytes.lower leaves other letters alone)."""
    return text.encode().lower().split() if text else []


def map_batches(df: DataFrame, cols: list[str], make: Callable[..., list[tuple]], schema: str,
                keep: list[str] | None = None) -> DataFrame:
    """Per Arrow batch, ``make(*lists)`` gives a tuple for the fields of
    ``schema`` per row, in order.

    ``keep`` columns pass through unchanged, before the new ones; new names
    must differ from kept ones.
    """
    keep = keep or []
    src = df.select(*[F.col(f"`{c}`") for c in keep],
                    *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(cols)])
    full = StructType(src.schema.fields[:len(keep)] + StructType.fromDDL(schema).fields)
    n_keep, n_cols = len(keep), len(cols)
    arrow = to_arrow_schema(full)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = make(*[b.column(n_keep + i).to_pylist() for i in range(n_cols)])
            made = list(zip(*rows)) if rows else [[] for _ in range(len(full.fields) - n_keep)]
            arrays = [b.column(i).cast(arrow.field(i).type) for i in range(n_keep)]
            arrays += [pa.array(c, type=arrow.field(n_keep + j).type) for j, c in enumerate(made)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return src.mapInArrow(run, full)


def map_rows(df: DataFrame, cols: list[str], make: Callable[..., tuple], schema: str,
             keep: list[str] | None = None) -> DataFrame:
    """As ``map_batches``, ``make`` taking one row's values."""
    return map_batches(df, cols, lambda *lists: [make(*r) for r in zip(*lists)], schema, keep)


def positional(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """``docs`` under names that clash with nothing, the new name of each
    column, and the expressions that restore the old names."""
    names = docs.columns
    at = {c: f"__d{i}" for i, c in enumerate(names)}
    return (docs.select(*[F.col(f"`{c}`").alias(at[c]) for c in names]), at,
            [F.col(at[c]).alias(c) for c in names])


def running_totals(df: DataFrame, keys: list[str], order: list[str], fraction: str,
                   value: str, out: str, rows_per_bucket: int = 4096) -> DataFrame:
    """Exclusive running sum of ``value`` per group of ``keys`` in ``order``.

    ``fraction`` is the first order column: uniform hash values in [0, 1), so
    equal-width ranges of it hold about equally many rows.  Each group is cut
    into ``ceil(rows / rows_per_bucket)`` ranges; one window sorts a range, a
    second one over the ranges' totals gives their offsets.  No task ever holds
    more than a range (or, for the offsets, one row per range).

    Null keys form a group of their own.  Rows with equal order values get
    their places in any order, each place once.
    """
    null_safe = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    mark = [F.col(k).isNull() for k in keys]
    g = [f"__g{i}" for i in range(2 * len(keys))]
    df = df.withColumns(dict(zip(g, [*null_safe, *mark])))
    sizes = saved(df.groupBy(*g).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / rows_per_bucket))
                                     .alias("__nb")), "range-counts")
    df = df.join(if_small(sizes), g)
    df = df.withColumn("__b", F.least(F.floor(F.col(fraction) * F.col("__nb")), F.col("__nb") - 1))
    df = df.repartition(*g, "__b")  # by range, not by group: a group may be hot
    inside = Window.partitionBy(*g, "__b").orderBy(*order)
    df = df.withColumn("__in", F.sum(value).over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value))
    totals = df.groupBy(*g, "__b").agg(F.sum(value).alias("__t"))
    before = Window.partitionBy(*g).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*g, "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__off"))
    return (df.join(offsets, [*g, "__b"])
            .withColumn(out, F.col("__off") + F.col("__in"))
            .drop(*g, "__nb", "__b", "__in", "__off"))


def hash_fraction(md5_hex: Column) -> Column:
    """First 13 hex digits of a digest as a number in [0, 1)."""
    return F.conv(F.substring(md5_hex, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))
