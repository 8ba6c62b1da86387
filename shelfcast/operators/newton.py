"""Class-weighted logistic regression of every group in one job per Newton step.

One pass over the rows gives each group's loss, gradient and curvature matrix:
tasks add up their own rows, then partial sums are added ``MERGE`` at a time,
so a group may hold any share of the rows.  Each group solves its own small
system; a step that raises its loss is halved; groups stop by themselves.

The penalty is ``l2 / 2`` times the squared coefficients, the intercept left
out.  Missing inputs count as 0.  A group without rows has no coefficients.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.session import materialize

MERGE = 64
MOST_STEPS = 40
TOLERANCE = 1e-9


def vectors(df: DataFrame, group: str, features: list[str], label: Column, weight: Column, keep: list[str],
            name: str) -> DataFrame:
    """``grp, y, w, x`` (an array of the features) and the kept columns, written once."""
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    return materialize(df.select(F.col(group).alias("grp"), label.cast("double").alias("y"),
                                 weight.cast("double").alias("w"), x.alias("x"), *keep), name)


def _matrix(batch: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("x"))
    flat = x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[at]
    return np.column_stack([np.ones(len(flat)), flat])


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    codes = batch.column(batch.schema.get_field_index("grp")).dictionary_encode()
    places = codes.indices.to_numpy(zero_copy_only=False)
    for i, g in enumerate(codes.dictionary.to_pylist()):
        yield g, np.flatnonzero(places == i)


def sums(rows: DataFrame, beta: dict[str, np.ndarray]) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Per group in ``beta`` the weighted loss, its gradient and curvature."""
    p = len(next(iter(beta.values())))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            y = b.column(b.schema.get_field_index("y")).to_numpy()
            w = b.column(b.schema.get_field_index("w")).to_numpy()
            for g, at in _groups(b):
                if g in beta:
                    x = _matrix(b, at)
                    score = x @ beta[g]
                    prob = 1 / (1 + np.exp(-score))
                    loss = (w[at] * (np.logaddexp(0, score) - y[at] * score)).sum()
                    gradient = x.T @ (w[at] * (prob - y[at]))
                    curve = (x * (w[at] * prob * (1 - prob))[:, None]).T @ x
                    one = np.concatenate([[loss], gradient, curve.ravel()])
                    total[g] = total[g] + one if g in total else one
        part = TaskContext.get().partitionId()
        for g, one in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([g], pa.string()), pa.array([part], pa.int32()), pa.array([one.tobytes()], pa.binary())],
                ["grp", "part", "data"])

    def add(t: pa.Table) -> pa.Table:
        order, data = np.argsort(t["part"].to_numpy()), t["data"].to_pylist()
        one = sum(np.frombuffer(data[i]) for i in order)
        return pa.table({"grp": t["grp"][:1], "part": pa.array([t["part"][0].as_py() // MERGE], pa.int32()),
                         "data": pa.array([one.tobytes()], pa.binary())})

    parts = rows.select("grp", "y", "w", "x").mapInArrow(count, "grp string, part int, data binary")
    parts = (parts.groupBy("grp", F.floor(F.col("part") / MERGE))
             .applyInArrow(lambda key, t: add(t), "grp string, part int, data binary"))
    # A row per group and MERGE tasks is left: groups x features squared numbers each.
    out: dict[str, np.ndarray] = {}
    for r in sorted(parts.collect(), key=lambda r: (r["grp"], r["part"])):
        one = np.frombuffer(r["data"])
        out[r["grp"]] = out[r["grp"]] + one if r["grp"] in out else one
    return {g: (float(v[0]), v[1:1 + p], v[1 + p:].reshape(p, p)) for g, v in out.items()}


def fit(rows: DataFrame, l2: float = 1.0) -> dict[str, np.ndarray]:
    """Coefficients per group, intercept first."""
    groups = [r["grp"] for r in rows.select("grp").distinct().collect()]
    width = rows.select(F.max(F.size("x"))).first()[0]
    if width is None:
        return {}
    ridge = np.diag([0.0] + [l2] * width)
    beta = {g: np.zeros(width + 1) for g in groups}
    before: dict[str, tuple[float, np.ndarray, np.ndarray]] = {}   # loss, place and step that led on from it
    open_groups, rows = set(groups), rows.select("grp", "y", "w", "x").persist()
    for _ in range(MOST_STEPS):
        for g, (loss, gradient, curve) in sums(rows, {g: beta[g] for g in open_groups}).items():
            b = beta[g]
            loss += float(b @ ridge @ b) / 2
            if g in before and not loss <= before[g][0] + 1e-9 * abs(before[g][0]):
                _, place, step = before[g]
                before[g] = (before[g][0], place, step / 2)
                beta[g] = place + step / 2
                continue
            step = -np.linalg.lstsq(curve + ridge, gradient + ridge @ b, rcond=None)[0]
            if np.abs(step).max() <= TOLERANCE * (1 + np.abs(b).max()):
                open_groups.discard(g)
                continue
            before[g], beta[g] = (loss, b, step), b + step
        if not open_groups:
            break
    rows.unpersist()
    return beta


def predict(rows: DataFrame, beta: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """``grp``, kept columns and ``prob`` of every row of a fitted group."""
    kept = rows.select("grp", *keep, "x")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", prob double"

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prob, known = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            for g, at in _groups(b):
                if g in beta:
                    prob[at], known[at] = 1 / (1 + np.exp(-(_matrix(b, at) @ beta[g]))), True
            out = pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns - 1)] + [pa.array(prob)],
                                             b.schema.names[:-1] + ["prob"])
            yield out.filter(pa.array(known))

    return kept.mapInArrow(score, schema)
