"""Fixed-length history windows per series (WIN8, WIN9).

A window is the ``seq_len`` consecutive rows of one series ending at (WIN8)
or right before (WIN9) the labelled row; windows never cross series.  A series
is stored as arrays, one row per chunk of ``CHUNK`` rows with the ends of the
chunk before it, and windows are slices of them: no frame gathers the rows of
each window anew, and no row grows with a series.  A window still holds its
``seq_len`` steps: select only the needed columns and restrict to the lookback
period first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.columns import occurrence
from shelfcast.operators.features import standardize

SEQ_LEN = 28


CHUNK = 1024


def series_chunks(df: DataFrame, values: dict[str, Column], overlap: int, key: str = "id", order: str = "d_int",
                  chunk: int | None = None) -> DataFrame:
    """``key`` and ``rows``: the rows of a series in order, as arrays of structs
    of ``order`` and ``values``, one array per chunk.  The last ``overlap`` rows
    of a chunk come again at the head of the next one."""
    size = chunk or CHUNK
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    rows = df.select(key, F.struct(F.col(order), *[v.alias(n) for n, v in values.items()]).alias("row"), place.alias("place"))
    chunks = F.array_distinct(F.array(F.floor(F.col("place") / size), F.floor((F.col("place") + overlap) / size)))
    rows = rows.withColumn("chunk", F.explode(chunks))
    return (rows.groupBy(key, "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "row"))).alias("rows"))
            .select(key, F.col("rows.row").alias("rows")))


def _windows(df: DataFrame, features: list[str], seq_len: int, gap: int, key: str, order: str) -> DataFrame:
    """Windows of ``seq_len`` steps that end ``gap`` rows before the labelled one."""
    step = F.struct(*[F.col(c).cast("double").alias(c) for c in features])
    chunks = series_chunks(df, {"label": occurrence("sales"), "step": step}, seq_len - 1 + gap, key, order)
    ends = F.when(F.size("rows") >= seq_len + gap, F.sequence(F.lit(seq_len + gap), F.size("rows")))
    cut = chunks.select(key, "rows", F.explode(ends).alias("end"))
    labelled = F.element_at("rows", F.col("end"))
    return cut.select(key, labelled[order].alias(order), labelled["label"].alias("label"),
                      F.slice("rows", F.col("end") - (seq_len + gap - 1), F.lit(seq_len))["step"].alias("seq"))


def scaled_inputs(features: DataFrame, train_end: int, cols: list[str], lookback: int = 365,
                  horizon: int = 28, by: str = "store_id") -> DataFrame:
    """The rows of the lookback year and the horizon with ``cols`` scaled per
    group by the statistics of the train rows (AGG19); ``sales`` stays as it is
    and is not among the inputs."""
    t = train_end
    rows = features.where((F.col("d_int") >= t + 1 - lookback) & (F.col("d_int") <= t + horizon))
    return standardize(rows, cols, by=by, fit_rows=rows.where(F.col("d_int") <= t))


def sequence_windows(df: DataFrame, features: list[str], seq_len: int = SEQ_LEN,
                     key: str = "id", order: str = "d_int") -> DataFrame:
    """Rows ``i-seq_len+1 .. i``, label = occurrence at row ``i`` (WIN8).

    A series of ``n`` rows yields ``max(0, n - seq_len + 1)`` windows.
    """
    return _windows(df, features, seq_len, 0, key, order)


def sequence_windows_next(df: DataFrame, features: list[str], seq_len: int = SEQ_LEN,
                          key: str = "id", order: str = "d_int") -> DataFrame:
    """Rows ``i-seq_len .. i-1``, label = occurrence at row ``i`` (next step, WIN9).

    Meant for the dense grid, where row ``i`` is day ``i``.
    """
    return _windows(df, features, seq_len, 1, key, order)


def flatten_sequence(seqs: DataFrame, features: list[str], seq_len: int = SEQ_LEN) -> DataFrame:
    """``seq`` (array of structs) -> one ``seq_flat`` array, step-major, for MLlib."""
    flat = F.flatten(F.transform("seq", lambda s: F.array(*[s[c] for c in features])))
    return seqs.withColumn("seq_flat", flat)
