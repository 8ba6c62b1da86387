"""Embedding whitening by a covariance weighted with multiplicities.

Each vector becomes integers, ``floor(scale * c) + offset`` per entry, and
identical integer vectors are one row of the table of distinct vectors, with
the number of rows that hold it.  The fit weighs a distinct vector by that
count or by one.  Sums are exact integers; the covariance is a weighted product
of vectors that were centred first, added up over partial matrices of tasks.
Eigenvectors are computed once, each distinct vector is whitened once, and the
result is joined back to the rows by the vectors' SHA-256.

What is one place's work: the covariance and its eigenvectors, whose size is
the square of the vectors' length whatever the number of rows.  A vector that
more than one in ``HOT_SHARE`` rows holds is joined by broadcast (there are
fewer than ``HOT_SHARE`` of those by that definition), all others by a shuffle,
so that no join key is hot.

Defined results: rows whose vector is null or holds null, infinite or NaN
entries are left out; vectors of different lengths are fitted apart, each
length a population of its own; a vector without entries has no components and
so no rows.  Entries beyond the range of a long are taken as its ends.  Where a
component's variance is zero (fewer distinct vectors than components, or
constant entries) ``whitened`` is null, and ``identity_error`` is over the other
components; it is null if there are none, as is ``explained`` if no entry
varies.  A ``deviation`` beyond 38 digits is null.  Repeated rows and equal ids
each have their rows; null ids stay; an empty table gives an empty one.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import saved

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
HOT_SHARE = 1024
MERGE = 64            # partial matrices that one task adds up
SMALL = 1 << 24       # entries whose squares and products stay exact in 64 bits
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1025   # the ends of a long as doubles


def integer_vectors(batch: pa.Array, scale: float, offset: int) -> tuple[list[int], list[np.ndarray]]:
    """The places of the usable vectors of a list array, and their integers."""
    lists = batch.cast(pa.list_(pa.float64()))
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.clip(np.nan_to_num(np.floor(values * scale), nan=0.0), _LOW, _HIGH - offset).astype(np.int64) + offset
    places, out = [], []
    for i, (n, end) in enumerate(zip(lengths.tolist(), ends.tolist())):
        if n >= 0 and bad[end] == bad[end - n]:
            places.append(i)
            out.append(x[end - n:end])
    return places, out


def _keyed(df: DataFrame, id_col: str, vector: str, scale: float, offset: int, ids: bool) -> DataFrame:
    """``digest, dims`` and, per row, its id or the vector's bytes."""
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    id_type = src.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, digest binary, dims int" if ids else "digest binary, dims int, x binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, xs = integer_vectors(b.column(1), scale, offset)
            raw = [v.astype("<i8").tobytes() for v in xs]
            digests = pa.array([hashlib.sha256(r).digest() for r in raw], pa.binary())
            dims = pa.array([len(v) for v in xs], pa.int32())
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(places, pa.int64())), digests, dims], ["id", "digest", "dims"])
            else:
                yield pa.RecordBatch.from_arrays([digests, dims, pa.array(raw, pa.binary())],
                                                 ["digest", "dims", "x"])

    return src.mapInArrow(run, schema)


def distinct_vectors(df: DataFrame, id_col: str, vector: str, scale: float = SCALE,
                     offset: int = OFFSET) -> DataFrame:
    """``digest, dims, x, n_rows``: each distinct integer vector once, written.
    A vector that many rows share is added up per task before it moves."""
    keyed = _keyed(df, id_col, vector, scale, offset, ids=False).filter("dims > 0")
    return saved(keyed.groupBy("digest").agg(F.first("dims").alias("dims"), F.first("x").alias("x"),
                                             F.count(F.lit(1)).alias("n_rows")), "white-distinct")


def _matrix(rows: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), dims)


def _by_length(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
    """Batches of ``digest, dims, x, weight`` apart by length: (length,
    vectors, weights, digests)."""
    for b in batches:
        dims = b.column("dims").to_numpy()
        raw, weight = b.column("x").to_pylist(), b.column("weight").to_numpy()
        digests = b.column("digest").to_pylist()
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            yield d, _matrix([raw[i] for i in at], d), weight[at], [digests[i] for i in at]


def exact_sums(fit: DataFrame) -> dict[int, tuple[int, int, list[int]]]:
    """Per length: number of fit vectors, total weight, weighted sum per
    dimension, all exact.  One row per dimension comes to the driver."""

    def run(batches):
        sums: dict[int, list] = {}
        for d, x, w, _ in _by_length(batches):
            s = sums.setdefault(d, [0, 0, np.zeros(d, object), np.zeros(d, object)])
            s[0] += len(x)
            s[1] += int(w.sum())
            # 32-bit halves, so that no product of a sum passes 64 bits
            for half, part in ((2, x >> 32), (3, x & 0xFFFFFFFF)):
                if int(w.max()) * len(x) < 1 << 31:
                    s[half] = s[half] + (part * w[:, None]).sum(0).astype(object)
                else:
                    s[half] = s[half] + (part.astype(object) * w.astype(object)[:, None]).sum(0)
        for d, (n, weight, high, low) in sums.items():
            total = [Decimal((int(h) << 32) + int(v)) for h, v in zip(high, low)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
                 pa.array([weight] * d, pa.int64()), pa.array(total, pa.decimal128(38, 0))],
                ["dims", "i", "n", "weight", "s"])

    parts = fit.mapInArrow(run, "dims int, i int, n long, weight long, s decimal(38,0)")
    rows = parts.groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"),
                                          F.sum("s").alias("s")).collect()
    out: dict[int, tuple] = {}
    for r in sorted(rows, key=lambda r: (r["dims"], r["i"])):
        out.setdefault(r["dims"], (r["n"], r["weight"], []))[2].append(int(r["s"]))
    return out


def centred(x: np.ndarray, weight: int, sums: list[int]) -> np.ndarray:
    """``x - sums / weight`` in double precision: the whole part of the mean is
    taken off the integers, its fraction off what is left."""
    whole = np.array([s // weight for s in sums], np.int64)
    rest = np.array([(s % weight) / weight for s in sums])
    if x.size and (int(x.max()) - int(whole.min()) > _HIGH or int(x.min()) - int(whole.max()) < _LOW):
        return x.astype(float) - whole.astype(float) - rest
    return (x - whole).astype(float) - rest


def _added(parts: DataFrame) -> DataFrame:
    """Rows ``dims, i, part, row`` (a matrix row as bytes of doubles) added up
    over ``part``, MERGE of them at a time."""

    def add(group: pa.Table) -> pa.Table:
        rows = sum(np.frombuffer(r, "<f8") for r in group["row"].to_pylist())
        return pa.table({"dims": group["dims"][:1], "i": group["i"][:1],
                         "part": pa.array([group["part"][0].as_py() // MERGE], pa.int32()),
                         "row": pa.array([rows.tobytes()], pa.binary())})

    return (parts.groupBy("dims", "i", F.floor(F.col("part") / MERGE).alias("g"))
            .applyInArrow(lambda key, group: add(group), "dims int, i int, part int, row binary"))


def scatter(fit: DataFrame, sums: dict[int, tuple[int, int, list[int]]]) -> dict[int, np.ndarray]:
    """Per length the weighted sum of outer products of the centred vectors."""

    def run(batches):
        grams: dict[int, np.ndarray] = {}
        for d, x, w, _ in _by_length(batches):
            c = centred(x, sums[d][1], sums[d][2])
            grams[d] = grams.get(d, 0.0) + (c * w[:, None]).T @ c
        part = TaskContext.get().partitionId()
        for d, g in grams.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([part] * d, pa.int32()),
                 pa.array([row.astype("<f8").tobytes() for row in g], pa.binary())], ["dims", "i", "part", "row"])

    parts = saved(_added(fit.mapInArrow(run, "dims int, i int, part int, row binary")), "white-matrix")
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        parts = saved(_added(parts), "white-matrix")
    out: dict[int, np.ndarray] = {}
    for r in parts.collect():
        out.setdefault(r["dims"], np.zeros((r["dims"], r["dims"])))[r["i"]] = np.frombuffer(r["row"], "<f8")
    return {d: (g + g.T) / 2 for d, g in out.items()}


class Basis:
    """Eigenvectors of a covariance, strongest first, with what whitening needs."""

    def __init__(self, gram: np.ndarray, weight: int, sums: list[int], components: int):
        cov = gram / weight
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")[:components]
        values, vectors = values[order], vectors[:, order]
        signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
        trace = float(np.trace(cov))
        floor = max(float(values[0]), 0.0) * len(cov) * np.finfo(float).eps * 4 if len(values) else 0.0
        self.weight, self.sums = weight, sums
        self.vectors = vectors * np.where(signs == 0, 1, signs)
        self.live = values > floor
        self.scale = np.where(self.live, 1 / np.sqrt(np.where(self.live, values, 1)), np.nan)
        self.explained = [float(v / trace) if trace > 0 else None for v in np.maximum(values, 0)]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (centred(x, self.weight, self.sums) @ self.vectors) * self.scale


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Per vector the exact sum over dimensions of ``(n * x - sums)`` squared."""
    whole, rest = [s // n for s in sums], [s % n for s in sums]
    out = []
    q = np.array(whole, np.int64)
    r_high, r_low = np.array([r >> 20 for r in rest], object), np.array([r & 0xFFFFF for r in rest], np.int64)
    easy = x.shape[1] < 1 << 12 and n < 1 << 40
    near = (np.abs(x // 2 - q // 2).max(1) < SMALL // 4) if easy and len(x) else np.zeros(len(x), bool)
    c = sum(r * r for r in rest)
    if near.any():
        y = x[near] - q
        a = (y * y).sum(1)
        b_high, b_low = (y * r_high.astype(np.int64)).sum(1), (y * r_low).sum(1)
        fast = iter([n * n * p - 2 * n * ((h << 20) + v) + c
                     for p, h, v in zip(a.tolist(), b_high.tolist(), b_low.tolist())])
    for i, plain in enumerate(near.tolist()):
        out.append(next(fast) if plain else sum((n * v - s) ** 2 for v, s in zip(x[i].tolist(), sums)))
    return out


def _whitened(fit: DataFrame, sums: dict, bases: dict[int, Basis]) -> DataFrame:
    """``digest, dims, n_rows, deviation, whitened`` per distinct vector."""

    def run(batches):
        for d, x, rows, digests in _by_length(batches):
            n, _, _ = sums[d]
            dev = [Decimal(v) if v < 10 ** 38 else None for v in deviations(x, n, plain[d])]
            white = bases[d].whiten(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array([d] * len(x), pa.int32()), pa.array(rows, pa.int64()),
                 pa.array(dev, pa.decimal128(38, 0)),
                 pa.array([[None if np.isnan(v) else v for v in row] for row in white.tolist()],
                          pa.list_(pa.float64()))],
                ["digest", "dims", "n_rows", "deviation", "whitened"])

    plain = {d: s for d, (_, _, s) in sums.items()}
    return fit.mapInArrow(run, "digest binary, dims int, n_rows long, deviation decimal(38,0), "
                               "whitened array<double>")


def _moments(white: DataFrame, weights: str, bases: dict[int, Basis]) -> dict[int, float | None]:
    """Per length the largest absolute entry of the whitened vectors'
    covariance minus the identity, over components with variance."""

    def run(batches):
        found: dict[int, tuple] = {}
        for b in batches:
            dims, w = b.column(0).to_numpy(), b.column(1).to_numpy().astype(float)
            rows = b.column(2).to_pylist()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                live = np.flatnonzero(bases[d].live)
                z = np.array([[rows[i][j] for j in live] for i in at]).reshape(len(at), len(live))
                n = w[at].sum()
                mean = (w[at] @ z) / n
                m2 = ((z - mean) * w[at][:, None]).T @ (z - mean)
                found[d] = _pooled(found[d], (n, mean, m2)) if d in found else (n, mean, m2)
        for d, (n, mean, m2) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int32()), pa.array([n], pa.float64()), pa.array([mean.tolist()], pa.list_(pa.float64())),
                 pa.array([m2.ravel().tolist()], pa.list_(pa.float64()))], ["dims", "n", "mean", "m2"])

    parts = white.select("dims", weights, "whitened").mapInArrow(
        run, "dims int, n double, mean array<double>, m2 array<double>")
    # A row of COMPONENTS squared numbers per task and length, pooled as they come.
    pooled: dict[int, tuple] = {}
    for r in parts.toLocalIterator():
        k = len(r["mean"])
        one = (r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(k, k))
        pooled[r["dims"]] = _pooled(pooled[r["dims"]], one) if r["dims"] in pooled else one
    return {d: float(np.abs(m2 / n - np.eye(len(mean))).max()) if len(mean) else None
            for d, (n, mean, m2) in pooled.items()}


def _pooled(a: tuple, b: tuple) -> tuple:
    """Weight, mean and centred second moments of two groups taken together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           scale: float = SCALE, offset: int = OFFSET, by_count: bool = False) -> DataFrame:
    """Per usable row its id, ``dims, n, deviation, whitened`` (an array),
    ``explained`` (an array) and ``identity_error``.

    ``by_count`` weighs a distinct vector by its rows; otherwise by one, and
    ``n`` is the number of distinct vectors.  ``deviation`` is against the
    unweighted sums in either case."""
    spark: SparkSession = df.sparkSession
    distinct = distinct_vectors(df, id_col, vector, scale, offset)
    weight = F.col("n_rows") if by_count else F.lit(1).cast("long")
    fit = distinct.select("digest", "dims", "x", weight.alias("weight"))
    sums = exact_sums(fit)
    grams = scatter(fit, sums)
    bases = {d: Basis(grams[d], sums[d][1], sums[d][2], components) for d in sums}
    plain = exact_sums(distinct.select("digest", "dims", "x", F.lit(1).cast("long").alias("weight"))) if by_count else sums
    white = saved(_whitened(distinct.select("digest", "dims", "x", F.col("n_rows").alias("weight")),
                            plain, bases), "white-vectors")
    errors = _moments(white, "n_rows", bases) if by_count else _moments(
        white.withColumn("one", F.lit(1).cast("long")), "one", bases)
    per_length = spark.createDataFrame(
        [(d, sums[d][0], bases[d].explained, errors.get(d)) for d in sums],
        "dims int, n long, explained array<double>, identity_error double")
    rows = saved(_keyed(df, id_col, vector, scale, offset, ids=True), "white-rows")
    total = white.agg(F.sum("n_rows")).first()[0] or 0
    # By definition fewer than HOT_SHARE vectors: safe to broadcast at any size.
    is_hot = F.col("n_rows") * HOT_SHARE > total
    common = F.broadcast(white.filter(is_hot).select("digest", F.lit(True).alias("hot"),
                                                     F.col("deviation").alias("hot_deviation"),
                                                     F.col("whitened").alias("hot_whitened")))
    marked = rows.join(common, "digest", "left")
    hot = marked.filter("hot").select("id", "dims", F.col("hot_deviation").alias("deviation"),
                                      F.col("hot_whitened").alias("whitened"))
    rest = (marked.filter("hot is null").select("digest", "id")
            .join(white.filter(~is_hot).select("digest", "dims", "deviation", "whitened"), "digest")
            .select("id", "dims", "deviation", "whitened"))
    return (hot.unionByName(rest).join(F.broadcast(per_length), "dims")
            .select(F.col("id").alias(id_col), "dims", "n", "deviation", "whitened", "explained", "identity_error"))


def by_component(white: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component, numbered from 1."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "z")
    return white.select(id_col, "n", "deviation", "identity_error", pairs).select(
        id_col, (F.col("at") + 1).alias("component"), "n", "deviation",
        F.col("z.whitened").alias("whitened"), F.col("z.explained").alias("explained"), "identity_error")
