"""Boosted trees by distributed histograms: every store and every fit in one job.

A fit is a loss, a target and a feature subset; each store has its own model of
it.  All models grow together: one Spark job per tree level adds up, per (fit,
store, node), the gradients, curvatures and counts of every feature's bins, and
chooses the split that lowers the loss most.  Tasks add up their own rows
first, so what is shuffled grows with models and nodes, not with rows; splits
and leaf values, a few numbers per node, are what comes to the driver, and sums
of tasks that are at most ``DRIVER_BYTES`` together, which it adds up itself.
No store is in one task: its rows stand in blocks that any task may read.

Rows are binned once (quantiles per store; categories by code, null as one of
them) and written as blocks of packed arrays, which all fits share.  The level
jobs are hundreds and short, so they run over an RDD of the blocks: that plans
nothing and turns no rows into columns.  Every
``WRITE_EVERY`` rounds the rows' scores are written with them; in between they
follow from the last rounds' trees, so a lost task repeats little.

Losses: ``squared`` and ``absolute`` (leaves hold medians), ``poisson`` (log
link), ``log`` (probability of target 1).  Splits by category order the bins by
their mean gradient, so that any two sets of categories may part.

Missing numbers count as 0, as in the model tables.  A store without training
rows has no model and no predictions.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.session import materialize

BINS = 64
BLOCK_ROWS = 32_768
TASK_BLOCKS = 64          # blocks that one task reads at most, about
WRITE_EVERY = 10
DRIVER_BYTES = 32 << 20   # sums of tasks that the driver adds up at most
MIN_LEAF = 20             # rows in a leaf at least
MIN_CURVATURE = 1e-3
CATEGORY_SMOOTHING = 10.0
MEDIAN_BINS = 1024
PATIENCE, TOLERANCE = 10, 1e-7
HOLDOUT = 0.1


@dataclass(frozen=True)
class Fit:
    name: str
    loss: str                                  # squared, absolute, poisson, log
    target: str                                # raw, log1p, occurrence
    features: tuple[str, ...]
    rounds: int = 70
    positive_only: bool = False
    l2: float = 0.0
    balanced: bool = False                     # class weights n / (2 * n of the class), per store
    holdout_seed: int | None = None            # early stopping on a tenth of the rows


@dataclass
class Tree:
    """A complete tree of fixed depth; a node that does not part sends all left."""
    feature: np.ndarray                        # per inner node
    left: np.ndarray                           # per inner node and bin
    value: np.ndarray                          # per leaf


@dataclass
class Model:
    start: float
    trees: list[Tree] = field(default_factory=list)
    stopped: bool = False
    losses: list[float] = field(default_factory=list)


def target_of(fit: Fit, y: np.ndarray) -> np.ndarray:
    return {"raw": lambda: y, "log1p": lambda: np.log1p(y), "occurrence": lambda: (y > 0).astype(float)}[fit.target]()


def target_column(fit: Fit, sales: Column) -> Column:
    return {"raw": sales.cast("double"), "log1p": F.log1p(sales.cast("double")),
            "occurrence": (sales > 0).cast("double")}[fit.target]


def gradients(loss: str, t: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What lowers the loss: residuals, and curvatures."""
    if loss == "poisson":
        mean = np.exp(score)
        return t - mean, mean
    if loss == "log":
        p = 1 / (1 + np.exp(-score))
        return t - p, p * (1 - p)
    if loss == "absolute":
        gap = t - score
        return np.where(np.abs(gap) <= 1e-9, 0.0, np.sign(gap)), np.ones_like(t)  # rounding is no residual
    return t - score, np.ones_like(t)


def row_losses(loss: str, t: np.ndarray, score: np.ndarray) -> np.ndarray:
    if loss == "poisson":
        return np.exp(score) - t * score
    if loss == "log":
        return np.logaddexp(0, score) - t * score
    return np.abs(t - score) if loss == "absolute" else (t - score) ** 2 / 2


def leaves(tree: Tree, x: np.ndarray, depth: int) -> np.ndarray:
    """The rows' nodes at ``depth``, numbered from 0; ``x`` has a row per feature."""
    n, bins = x.shape[1], tree.left.shape[1]
    flat, rows, right = np.ravel(x), np.arange(n), (~tree.left).astype(np.int64).ravel()
    if not depth:
        return np.zeros(n, np.int64)
    node = right[:bins].take(x[tree.feature[0]])
    for level in range(1, depth):
        at = node + ((1 << level) - 1)
        node = 2 * node + right.take(at * bins + flat.take(tree.feature.take(at) * n + rows))
    return node


def best_split(hist: np.ndarray, allowed: np.ndarray, categorical: np.ndarray, l2: float,
               min_leaf: int) -> tuple[int, np.ndarray, list[float]]:
    """The feature, its left bins, and residual and curvature sums left and
    right, of the split that lowers the loss most; feature -1 and all bins left
    if none does.  ``hist``: features x bins x (residuals, curvatures, rows)."""
    total = hist[0].sum(0)
    every = np.ones(hist.shape[1], bool)
    order = np.argsort(-hist[:, :, 0] / (hist[:, :, 1] + CATEGORY_SMOOTHING), axis=1, kind="stable")
    order[~categorical] = np.arange(hist.shape[1])
    left = np.cumsum(np.take_along_axis(hist, order[:, :, None], axis=1), axis=1)[:, :-1]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[..., 0] ** 2 / (left[..., 1] + l2) + right[..., 0] ** 2 / (right[..., 1] + l2)
                - total[0] ** 2 / (total[1] + l2))
    usable = (allowed[:, None] & (left[..., 2] >= min_leaf) & (right[..., 2] >= min_leaf)
              & (left[..., 1] >= MIN_CURVATURE) & (right[..., 1] >= MIN_CURVATURE))
    gain = np.where(usable, gain, 0.0)
    # The first of equal gains, whatever the order in which sums were added.
    at = int(np.argmax(gain.ravel() >= gain.max() * (1 - 1e-9)))
    f, cut = divmod(at, gain.shape[1])
    if not gain[f, cut] > 1e-12:
        return -1, every, [float(total[0]), float(total[1]), 0.0, 0.0]
    goes = np.zeros(hist.shape[1], bool)
    goes[order[f, :cut + 1]] = True
    return f, goes, [float(v) for v in (left[f, cut, 0], left[f, cut, 1], right[f, cut, 0], right[f, cut, 1])]


# ------------------------------------------------------------------ blocks


class Binner:
    """Bin edges of the numeric features per store, and the bins of categories."""

    def __init__(self, features: list[str], categorical: list[str], edges: dict[str, dict[str, np.ndarray]], bins: int):
        self.features, self.categorical, self.edges, self.bins = features, categorical, edges, bins

    @staticmethod
    def fit(train: DataFrame, features: list[str], categorical: list[str], group: str, bins: int = BINS) -> "Binner":
        """One aggregate over the rows.  What comes to the driver is stores x
        features x bins numbers."""
        numeric = [f for f in features if f not in categorical]
        shares = [float(i) / bins for i in range(1, bins)]
        value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        aggs = [F.percentile_approx(value(c), shares, 10_000).alias(f"n{i}") for i, c in enumerate(numeric)]
        aggs += [F.max(F.col(c)).alias(f"c{i}") for i, c in enumerate(categorical)]
        found = train.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("rows"), *aggs).collect()
        for i, c in enumerate(categorical):
            if max((r[f"c{i}"] or 0 for r in found), default=0) + 2 > bins:
                raise ValueError(f"{c} has more categories than the {bins} bins")
        edges = {r["g"]: {c: np.unique(r[f"n{i}"]) for i, c in enumerate(numeric)} for r in found}
        return Binner(features, categorical, edges, bins)

    def bins_of(self, group: str, feature: str, values: np.ndarray) -> np.ndarray:
        if feature in self.categorical:  # code -1, no category, is bin 0
            return np.clip(np.nan_to_num(values, nan=-1) + 1, 0, self.bins - 1).astype(np.uint8)
        return np.searchsorted(self.edges[group][feature], np.nan_to_num(values), "left").astype(np.uint8)


def blocks_of(df: DataFrame, binner: Binner, group: str, keys: list[str], label: str, name: str,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``grp, block, n, x, y, h`` and the keys as arrays, written: the rows of a
    store dealt to blocks of about ``block_rows`` by a hash of their keys."""
    counts = df.groupBy(F.col(group).alias("grp")).agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    columns = [F.coalesce(F.col(f).cast("double"), F.lit(-1.0 if f in binner.categorical else 0.0)).alias(f"x{i}")
               for i, f in enumerate(binner.features)]
    rows = df.select(F.col(group).alias("grp"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
                     F.col(label).cast("double").alias("y"), F.xxhash64(*keys).alias("h"), *columns)
    rows = rows.join(F.broadcast(materialize(counts, f"{name}-parts")), "grp")  # a row per store
    rows = rows.withColumn("block", F.pmod("h", "parts")).drop("parts")
    key_types = [rows.schema[f"k{i}"].dataType.simpleString() for i in range(len(keys))]
    schema = "grp string, block int, n int, x binary, y binary, h binary" + "".join(
        f", k{i} array<{t}>" for i, t in enumerate(key_types))
    known = set(binner.edges)

    def pack(t: pa.Table) -> pa.Table:
        group, n = t["grp"][0].as_py(), t.num_rows
        if group not in known:
            n, t = 0, t.slice(0, 0)
        x = [binner.bins_of(group, f, t[f"x{i}"].to_numpy()) if n else np.zeros(0, np.uint8)
             for i, f in enumerate(binner.features)]
        out = {"grp": pa.array([group], pa.string()), "block": pa.array([0], pa.int32()),
               "n": pa.array([n], pa.int32()), "x": pa.array([np.concatenate(x).tobytes()], pa.binary()),
               "y": pa.array([t["y"].to_numpy().astype("<f8").tobytes()], pa.binary()),
               "h": pa.array([t["h"].to_numpy().astype("<i8").tobytes()], pa.binary())}
        for i in range(len(keys)):
            c = t[f"k{i}"].combine_chunks()
            out[f"k{i}"] = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c)
        return pa.table(out)

    return materialize(rows.groupBy("grp", "block").applyInArrow(pack, schema), name)


def _arrays(row: dict, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(row["x"], np.uint8).reshape(n_features, row["n"]), np.frombuffer(row["y"], "<f8"),
            np.frombuffer(row["h"], "<i8"))


BLOCK = ("grp", "block", "n", "x", "y", "h", "f")


def held_blocks(blocks: DataFrame, tasks: int) -> RDD:
    """The blocks as persisted dicts, as many to each of ``tasks`` tasks, those
    of a store side by side."""
    named = [c for c in BLOCK if c in blocks.columns]
    rows = blocks.select(*named).rdd.map(lambda r: {c: bytes(v) if isinstance(v, bytearray) else v for c, v in zip(named, r)})
    keys = sorted(tuple(r) for r in blocks.select("grp", "block").collect())  # a row per block of rows
    place = {k: i * tasks // len(keys) for i, k in enumerate(keys)}
    return (rows.map(lambda r: (place[r["grp"], r["block"]], r)).partitionBy(tasks, int).values()
            .persist(StorageLevel.MEMORY_AND_DISK))


def added(state: RDD, count: Callable, add: Callable, most_bytes: int, tasks: int) -> list:
    """``add(number, data)`` of all that ``count(blocks)`` gives by number, data
    in the order of the tasks, so that sums are the same whatever came first."""
    def numbered(part: int, blocks: Iterable[dict]):
        for at, data in count(blocks):
            yield (at, part), data

    def whole(parts: Iterable[tuple]):
        for at, some in groupby(parts, lambda p: p[0][0]):
            yield add(at, [data for _, data in some])

    parts = state.mapPartitionsWithIndex(numbered)
    if most_bytes <= DRIVER_BYTES:
        return list(whole(sorted(parts.collect(), key=lambda p: p[0])))
    return parts.repartitionAndSortWithinPartitions(tasks, lambda k: k[0] % tasks).mapPartitions(whole).collect()


def packed(sums: np.ndarray) -> tuple[bytes, bytes]:
    """The rows of a table of sums that have a count (its last column) and their places."""
    at = np.flatnonzero(sums[:, -1])
    return at.astype("<u4").tobytes(), sums[at].astype("<f8").tobytes()


def unpacked(parts: list[tuple[bytes, bytes]], rows: int, columns: int) -> np.ndarray:
    """The sum of packed tables."""
    out = np.zeros((rows, columns))
    for at, values in parts:
        out[np.frombuffer(at, "<u4")] += np.frombuffer(values, "<f8").reshape(-1, columns)
    return out


def held(h: np.ndarray, seed: int) -> np.ndarray:
    """A tenth of the rows, by a hash of their keys and the seed."""
    with np.errstate(over="ignore"):
        mixed = (h.astype(np.uint64) ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(40)) % np.uint64(1000) < np.uint64(int(1000 * HOLDOUT))


# ------------------------------------------------------------------- growth


class Booster:
    """Models of all fits and stores over one blocks table."""

    def __init__(self, binner: Binner, fits: list[Fit], rate: float, depth: int = 5, min_leaf: int = MIN_LEAF):
        self.binner, self.fits, self.rate, self.depth, self.min_leaf = binner, fits, rate, depth, min_leaf
        self.categorical = np.array([f in binner.categorical for f in binner.features])
        self.allowed = [np.array([f in fit.features for f in binner.features]) for fit in fits]
        self.models: dict[tuple[int, str], Model] = {}
        self.class_weights: dict[tuple[int, str], tuple[float, float]] = {}
        self.spread: dict[tuple[int, str], float] = {}

    def _travelling(self, written: int) -> "Booster":
        """What tasks need: of the models, only the trees that the written
        scores lack."""
        light = copy.copy(self)
        light.binner = Binner(self.binner.features, self.binner.categorical, {}, self.binner.bins)
        light.models = {k: Model(m.start, m.trees[written:]) for k, m in self.models.items()}
        return light

    # ---- what the tasks do

    def _weights(self, m: int, group: str, y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Row weights of a fit, and which rows its early stopping keeps apart."""
        fit = self.fits[m]
        w = (y > 0).astype(float) if fit.positive_only else np.ones(len(y))
        if fit.balanced:
            zero, one = self.class_weights[m, group]
            w = w * np.where(y > 0, one, zero)
        return w, held(h, fit.holdout_seed) if fit.holdout_seed is not None else None

    def _scores(self, row: dict, x: np.ndarray) -> np.ndarray:
        """Scores of all fits: as written, and the trees since."""
        group, out = row["grp"], np.zeros((len(self.fits), row["n"]))
        stored = np.frombuffer(row["f"], "<f8").reshape(out.shape) if row.get("f") is not None else None
        for m in range(len(self.fits)):
            model = self.models.get((m, group))
            if model is not None:
                out[m] = stored[m] if stored is not None else model.start
                for tree in model.trees:
                    out[m] += self.rate * tree.value[leaves(tree, x, self.depth)]
        return out

    def _rows(self, blocks: Iterable[dict]):
        n_features = len(self.binner.features)
        for row in blocks:
            if row["n"]:
                x, y, h = _arrays(row, n_features)
                yield row, x, y, h, self._scores(row, x)

    def _batches(self, batches: Iterable[pa.RecordBatch]):
        return self._rows(row for b in batches for row in b.to_pylist())

    def _histograms(self, state: RDD, written: int, level: int, partial: dict, active: list[tuple[int, str]]) -> list:
        """One level of all active models' trees: model, node (-1: held-out
        losses, with level 0), and what ``best_split`` found."""
        n_features, bins, nodes = len(self.binner.features), self.binner.bins, 1 << level
        place = {k: i * (nodes + 1) for i, k in enumerate(active)}
        most = sum(self.parts[g] for _, g in active) * nodes * n_features * bins * 28
        tasks = self._tasks(len(active) * nodes)
        self = self._travelling(written)

        def count(blocks: Iterable[dict]) -> Iterator[tuple]:
            sums: dict[tuple[int, str], np.ndarray] = {}
            losses: dict[tuple[int, str], np.ndarray] = {}
            for row, x, y, h, scores in self._rows(blocks):
                for m, fit in enumerate(self.fits):
                    key = (m, row["grp"])
                    if key not in place:
                        continue
                    w, apart = self._weights(m, row["grp"], y, h)
                    t = target_of(fit, y)
                    if apart is not None and level == 0:
                        one = np.array([float((row_losses(fit.loss, t, scores[m]) * w)[apart].sum()), float(w[apart].sum())])
                        losses[key] = losses.get(key, 0) + one
                    use = w > 0 if apart is None else (w > 0) & ~apart
                    r, c = gradients(fit.loss, t, scores[m])
                    node = leaves(partial[key], x, level) * bins
                    if not use.all():
                        node, r, c, w, part_x = node[use], r[use], c[use], w[use], x[:, use]
                    else:
                        part_x = x
                    plain = fit.loss in ("squared", "absolute") and not fit.balanced  # curvature 1: the count
                    r, c = r * w, c * w
                    one = np.empty((n_features, nodes * bins, 3))
                    for f in range(n_features):
                        at = node + part_x[f]
                        one[f, :, 0] = np.bincount(at, r, nodes * bins)
                        one[f, :, 2] = np.bincount(at, minlength=nodes * bins)
                        one[f, :, 1] = one[f, :, 2] if plain else np.bincount(at, c, nodes * bins)
                    one = one.reshape(n_features, nodes, bins, 3)
                    sums[key] = sums[key] + one if key in sums else one
            for key, one in losses.items():
                yield place[key] + nodes, one.tolist()
            for key, one in sums.items():
                for node in range(nodes):
                    if one[0, node, :, 2].any():
                        yield place[key] + node, packed(one[:, node].reshape(-1, 3))

        def choose(at: int, data: list) -> tuple:
            i, node = divmod(at, nodes + 1)
            m, group = active[i]
            if node == nodes:
                return m, group, -1, -1, None, [sum(v) for v in zip(*data)]
            hist = unpacked(data, n_features * bins, 3).reshape(n_features, bins, 3)
            feature, goes, sums = best_split(hist, self.allowed[m], self.categorical, self.fits[m].l2, self.min_leaf)
            return m, group, node, feature, goes, sums

        return added(state, count, choose, most, tasks)

    def _tasks(self, groups: int) -> int:
        """Tasks that add up ``groups`` groups."""
        return max(1, min(self.parallel, groups // 8))

    def _medians(self, state: RDD, written: int, partial: dict, active: list[tuple[int, str]]) -> dict:
        """Per active model the median residual of each leaf: the bin that holds
        it, then the bin within that, and the least residual there (the median
        itself if no other lies within a millionth of the target's spread)."""
        ends = 1 << self.depth
        chosen = {k: np.full(ends, -1) for k in active}
        before, values = ({k: np.zeros(ends) for k in active} for _ in range(2))
        total: dict = {}
        place = {k: i * ends for i, k in enumerate(active)}
        most = sum(self.parts[g] for _, g in active) * ends * MEDIAN_BINS * 20
        tasks = self._tasks(len(active) * ends)
        self = self._travelling(written)
        for again in (False, True):
            def count(blocks: Iterable[dict]) -> Iterator[tuple]:
                sums: dict = {}
                for row, x, y, h, scores in self._rows(blocks):
                    for m, fit in enumerate(self.fits):
                        key = (m, row["grp"])
                        if key not in place:
                            continue
                        w, apart = self._weights(m, row["grp"], y, h)
                        use = w > 0 if apart is None else (w > 0) & ~apart
                        leaf = leaves(partial[key], x, self.depth)[use]
                        residual, w = (target_of(fit, y) - scores[m])[use], w[use]
                        reach = self.spread[key]
                        exact = (residual + reach) / (2 * reach) * MEDIAN_BINS
                        at = np.clip(exact.astype(np.int64), 0, MEDIAN_BINS - 1)
                        if again:
                            inside = at == chosen[key][leaf]
                            leaf, residual, w = leaf[inside], residual[inside], w[inside]
                            finer = ((exact - at)[inside] * MEDIAN_BINS).astype(np.int64)
                            at = np.clip(finer, 0, MEDIAN_BINS - 1)
                        at = leaf * MEDIAN_BINS + at
                        one = np.full((MEDIAN_BINS * ends, 2), np.inf)
                        one[:, 1] = np.bincount(at, w, MEDIAN_BINS * ends)
                        np.minimum.at(one[:, 0], at, residual)
                        if key in sums:
                            one = np.stack([np.minimum(sums[key][:, 0], one[:, 0]), sums[key][:, 1] + one[:, 1]], axis=1)
                        sums[key] = one
                for key, one in sums.items():
                    one = one.reshape(ends, -1, 2)
                    for leaf in np.flatnonzero(one[:, :, 1].any(1)).tolist():
                        yield place[key] + leaf, packed(one[leaf])

            def add(at: int, data: list) -> tuple:
                i, leaf = divmod(at, ends)
                key = active[i]
                one, least = np.zeros(MEDIAN_BINS), np.full(MEDIAN_BINS, np.inf)
                for bins, some in data:
                    bins, some = np.frombuffer(bins, "<u4"), np.frombuffer(some, "<f8").reshape(-1, 2)
                    one[bins] += some[:, 1]
                    least[bins] = np.minimum(least[bins], some[:, 0])
                whole = float(one.sum()) if key + (leaf,) not in total else total[key + (leaf,)]
                running = before[key][leaf] + np.cumsum(one)
                found = min(int(np.searchsorted(running, whole / 2)), MEDIAN_BINS - 1)
                return key, leaf, found, float(least[found]), whole, float(running[found] - one[found])

            for key, leaf, found, value, whole, below in added(state, count, add, most, tasks):
                chosen[key][leaf], values[key][leaf] = found, value
                before[key][leaf], total[key + (leaf,)] = below, whole
        return values

    def _starts(self, train: DataFrame, group: str, label: str) -> None:
        """Constant models, class weights and target ranges, by one aggregate."""
        sales, aggs = F.col(label), []
        for m, fit in enumerate(self.fits):
            t = target_column(fit, sales)
            t = F.when(sales > 0, t) if fit.positive_only else t
            aggs += [F.avg(t).alias(f"mean{m}"), F.percentile_approx(t, 0.5, 10_000).alias(f"median{m}"),
                     (F.max(t) - F.min(t)).alias(f"spread{m}")]
        found = train.groupBy(F.col(group).alias("g")).agg(
            F.count(F.lit(1)).alias("n"), F.sum((sales > 0).cast("int")).alias("n1"), *aggs).collect()
        for r in found:
            for m, fit in enumerate(self.fits):
                mean = r[f"mean{m}"]
                if mean is None:
                    continue
                n, n1 = r["n"], r["n1"]
                if fit.balanced:
                    self.class_weights[m, r["g"]] = (n / (2 * max(1, n - n1)), n / (2 * max(1, n1)))
                    mean = 0.5 if 0 < n1 < n else mean
                start = {"squared": mean, "absolute": r[f"median{m}"], "poisson": float(np.log(max(mean, 1e-6))),
                         "log": float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))}[fit.loss]
                self.spread[m, r["g"]] = float(r[f"spread{m}"] or 0) + 1e-9
                self.models[m, r["g"]] = Model(float(start))

    def fit(self, train: DataFrame, blocks: DataFrame, group: str, label: str) -> "Booster":
        """Grow all models."""
        self._starts(train, group, label)
        return self._grow(blocks)

    def _grow(self, blocks: DataFrame) -> "Booster":
        bins, inner = self.binner.bins, (1 << self.depth) - 1
        spark = blocks.sparkSession
        cores = spark.sparkContext.defaultParallelism
        self.parallel = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.parts = {r[0]: r[1] for r in blocks.groupBy("grp").count().collect()}  # blocks per store
        tasks = max(cores, -(-sum(self.parts.values()) // TASK_BLOCKS))
        state, written = held_blocks(blocks, tasks), 0
        for rounds in range(max((f.rounds for f in self.fits), default=0)):
            if rounds and rounds % WRITE_EVERY == 0:
                blocks, before = self._written(blocks, written), state
                state, written = held_blocks(blocks, tasks), rounds
                before.unpersist()
            active = [k for k, m in self.models.items() if not m.stopped and rounds < self.fits[k[0]].rounds]
            if not active:
                break
            partial = {k: Tree(np.zeros(inner, np.int64), np.ones((inner, bins), bool), np.zeros(1 << self.depth))
                       for k in active}
            for level in range(self.depth):
                for m, group, node, feature, goes, sums in self._histograms(state, written, level, partial, active):
                    key = (m, group)
                    if node < 0:
                        self.models[key].losses.append(sums[0] / max(sums[1], 1e-12))
                        continue
                    at = node + (1 << level) - 1
                    tree = partial[key]
                    if feature >= 0:
                        tree.feature[at], tree.left[at] = feature, goes
                    if level == self.depth - 1:
                        g0, c0, g1, c1 = sums
                        l2 = self.fits[key[0]].l2
                        tree.value[2 * node] = g0 / (c0 + l2) if c0 + l2 > 0 else 0.0
                        tree.value[2 * node + 1] = g1 / (c1 + l2) if c1 + l2 > 0 else 0.0
                if level == 0:
                    for key in [k for k in active if _no_longer_falls(self.models[k].losses)]:
                        self.models[key].stopped = True
                        active.remove(key)
                    if not active:
                        break
            by_median = [k for k in active if self.fits[k[0]].loss == "absolute"]
            if by_median:
                for key, values in self._medians(state, written, partial, by_median).items():
                    partial[key].value = values
            for key in active:
                self.models[key].trees.append(partial[key])
        state.unpersist()
        return self

    def _written(self, blocks: DataFrame, written: int) -> DataFrame:
        """The blocks with all fits' scores so far."""
        self = self._travelling(written)

        def run(batches):
            for row, _, _, _, scores in self._batches(batches):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["grp"]], pa.string()), pa.array([row["block"]], pa.int32()), pa.array([row["n"]], pa.int32()),
                     *[pa.array([row[c]], pa.binary()) for c in "xyh"], pa.array([scores.astype("<f8").tobytes()], pa.binary())],
                    ["grp", "block", "n", "x", "y", "h", "f"])

        return materialize(blocks.mapInArrow(run, "grp string, block int, n int, x binary, y binary, h binary, f binary"),
                           "boosting-scores")

    def predict(self, blocks: DataFrame, keys: list[str], group: str, label: str) -> DataFrame:
        """Keys, store, label, ``fit`` (its name) and ``value`` in the target's
        scale (``poisson``: mean, ``log``: probability) for all rows and fits."""
        types = [blocks.schema[f"k{i}"].dataType.elementType.simpleString() for i in range(len(keys))]
        schema = (", ".join(f"{k} {t}" for k, t in zip(keys, types))
                  + f", {group} string, {label} double, fit string, value double")
        link = {"poisson": np.exp, "log": lambda s: 1 / (1 + np.exp(-s))}
        names = [*keys, group, label, "fit", "value"]
        shared = blocks.sparkSession.sparkContext.broadcast(self._travelling(0))  # trees x nodes x bins, no rows

        def run(batches):
            booster = shared.value
            for row, _, y, _, scores in booster._batches(batches):
                n = row["n"]
                for m, fit in enumerate(booster.fits):
                    if (m, row["grp"]) in booster.models:
                        value = link.get(fit.loss, lambda s: s)(scores[m])
                        columns = [pa.array(row[f"k{i}"]) for i in range(len(keys))]
                        yield pa.RecordBatch.from_arrays(
                            [*columns, pa.array([row["grp"]] * n, pa.string()), pa.array(y), pa.array([fit.name] * n, pa.string()),
                             pa.array(value)], names)

        return blocks.select("grp", "block", "n", "x", "y", "h", *[f"k{i}" for i in range(len(keys))]).mapInArrow(run, schema)


def _no_longer_falls(losses: list[float]) -> bool:
    """No loss of the last ``PATIENCE`` rounds is below the one before them."""
    return len(losses) > PATIENCE and min(losses[-PATIENCE:]) > losses[-PATIENCE - 1] - TOLERANCE


def boosted(train: DataFrame, val: DataFrame, fits: list[Fit], features: list[str], categorical: list[str],
            rate: float, depth: int = 5, group: str = "store_id", label: str = "sales",
            keys: tuple[str, ...] = ("id", "d"), min_leaf: int = MIN_LEAF, bins: int = BINS,
            block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Booster]:
    """Fit on ``train`` and predict ``val``: the long table of ``predict``,
    written, and the models."""
    binner = Binner.fit(train, features, categorical, group, bins)
    blocks = blocks_of(train, binner, group, list(keys), label, "boosting-train", block_rows)
    booster = Booster(binner, fits, rate, depth, min_leaf).fit(train, blocks, group, label)
    rows = blocks_of(val, binner, group, list(keys), label, "boosting-val", block_rows)
    return materialize(booster.predict(rows, list(keys), group, label), "boosting-predictions"), booster
