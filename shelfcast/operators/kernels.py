"""Window features by random dilated convolutions.

Each kernel looks at a few inputs over five steps, one, two or four days apart,
along a window of ``length`` rows of a series; the window keeps its greatest
response, the share of responses above zero, and the inputs of its last row.  A
linear model on these tells shapes in the history apart that the values of
single days do not.

Series are cut into chunks of ``CHUNK`` rows that overlap by a window, one row
in the shuffle and one group each, so no group grows with a series.  Rows count
as steps, as in the other window operators; a window never crosses series.
Missing inputs count as 0.  Rows with fewer than ``length - 1`` rows before
them have no window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1024
TAPS = 5
DILATIONS = (1, 2, 4)
INPUTS_PER_KERNEL = 3


def random_kernels(n_inputs: int, n_kernels: int, seed: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per dilation: taps x inputs x kernels weights, mean zero, and biases."""
    rng = np.random.default_rng(seed)
    out = []
    for i, dilation in enumerate(DILATIONS):
        k = n_kernels // len(DILATIONS) + (i < n_kernels % len(DILATIONS))
        weights = np.zeros((TAPS, n_inputs, k))
        for j in range(k):
            inputs = rng.choice(n_inputs, min(INPUTS_PER_KERNEL, n_inputs), replace=False)
            w = rng.normal(size=(TAPS, len(inputs)))
            weights[:, inputs, j] = w - w.mean(0)
        out.append((dilation, weights, rng.uniform(-1, 1, k)))
    return out


def window_features(x: np.ndarray, kernels: list[tuple[int, np.ndarray, np.ndarray]], length: int) -> np.ndarray:
    """Per window of ``length`` rows of ``x`` (oldest first) each kernel's
    greatest response and its share of positive ones, then the last row."""
    n, out = len(x) - length + 1, []
    for dilation, weights, bias in kernels:
        span = (TAPS - 1) * dilation
        response = sum(x[j * dilation:len(x) - span + j * dilation] @ weights[j] for j in range(TAPS)) + bias
        seen = np.lib.stride_tricks.sliding_window_view(response, length - span, axis=0)[:n]
        out += [seen.max(-1), (seen > 0).mean(-1)]
    return np.concatenate([*out, x[length - 1:]], axis=1)


def kernel_features(df: DataFrame, inputs: list[str], keep: list[str], length: int = 28, n_kernels: int = 60,
                    seed: int = 42, key: str = "id", order: str = "d_int") -> DataFrame:
    """``key``, ``order``, the kept columns and ``kernel``, the features of the
    window that ends with the row."""
    kernels = random_kernels(len(inputs), n_kernels, seed)
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs])
    rows = df.select(key, order, *keep, x.alias("__x"), place.alias("__at"))
    own = F.floor(F.col("__at") / CHUNK)
    ahead = F.floor((F.col("__at") + length - 1) / CHUNK)  # its last windows end in the next chunk
    rows = rows.withColumn("__chunk", F.explode(F.array_distinct(F.array(own, ahead))))
    kept = [key, order, *keep]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", kernel array<double>"
    width = 2 * n_kernels + len(inputs)

    def make(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t["__at"].to_numpy(), kind="stable")))
        flat = t["__x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(t.num_rows, len(inputs))
        n = max(0, t.num_rows - length + 1)
        made = window_features(x, kernels, length) if n else np.zeros((0, width))
        ends = t.slice(t.num_rows - n, n).select(kept)
        column = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(made.ravel()))
        return ends.append_column("kernel", column)

    return rows.groupBy(key, "__chunk").applyInArrow(make, schema)
