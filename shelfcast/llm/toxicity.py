"""Counterfactual-regularised toxicity classifier.

A logistic model over words and word beginnings is fitted to labelled texts.
Where a labelled text names an identity group, the names are swapped for
others of the same kind, and the fit penalises any change of the score; so
neutral mentions of a group move no score, whatever the labels' bias.

The fit takes a bounded sample of labelled rows (``max_labelled``, chosen by
hash of the id); everything else covers all rows: every whole text is scored,
in its own task, without a shuffle.  Features are chosen by
counts over all sampled rows before the rows come together, so that only the
chosen ones do.  The sampled labels and the model, whose size the hash range
bounds, are broadcast.

Defined results: a null or empty text scores the model's bias; label rows
without a label are left out, an id with several labels counts as toxic if any
says so; without usable labels of both kinds every score is the share of toxic
ones (0 if there are none); repeated rows score alike; an empty table of
documents gives an empty one; columns other than id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import lower_words_of, map_batches
from shelfcast.llm.packing import pack_keys, pack_numbers, unpack_keys, unpack_numbers

MAX_LABELLED = 30_000    # labelled rows that the fit takes, about
DIMENSION = 1 << 20      # feature hash range
SLICES = 16              # slices of the hash range, for counting
BEGINNINGS = (4, 5, 6)   # word beginnings, in characters
LEAST_DOCS = 3           # labelled texts a feature must stand in
LEAST_Z = 3.0            # z value of its toxic count, unless it stands in toxic texts only
RIDGE = 1e-3
SWAP_WEIGHT = 1.0        # weight of the counterfactual penalty
STEPS = 400
THRESHOLD = 0.3
_EDGE = b".,;:!?\"'()[]{}|#*$%&<>-_"

#: Identity terms of one kind, which swap with each other.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "natives"), ("disabled", "blind", "deaf"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "deutsche"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "français"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "españoles"),
)


class Model(NamedTuple):
    bias: float
    weights: dict[int, float]  # by feature number; all others weigh nothing


def swaps(terms=IDENTITY_TERMS) -> dict[bytes, bytes]:
    """Each identity term and the next of its kind."""
    return {a.encode(): kind[(i + 1) % len(kind)].encode() for kind in terms for i, a in enumerate(kind)}


def word_features(word: bytes) -> list[int]:
    """Feature numbers of one lower-cased word: itself and its beginnings."""
    text = word.strip(_EDGE).decode("utf-8", "ignore")
    if not text:
        return []
    out = [zlib.crc32(("w" + text).encode()) % DIMENSION]
    out += [zlib.crc32(("b" + text[:n]).encode()) % DIMENSION for n in BEGINNINGS if len(text) >= n]
    return out


def text_features(words: set[bytes], seen: dict[bytes, list[int]]) -> set[int]:
    out: set[int] = set()
    for w in words:
        f = seen.get(w)
        if f is None:
            if len(seen) > 500_000:
                seen.clear()
            f = seen[w] = word_features(w)
        out.update(f)
    return out


def sampled_labels(labels: DataFrame, use: Column, doc_id: str, label: str, max_labelled: int) -> DataFrame:
    """``doc_id, toxic``: about ``max_labelled`` labelled rows by hash of the id."""
    y = (labels.filter(use & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
         .groupBy(F.col(doc_id).alias("__id")).agg(F.max((F.col(label) > 0).cast("int")).alias("toxic")))
    n = y.count()
    if n > max_labelled:
        share = int(max_labelled / n * 1_000_000)
        y = y.filter(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < share)
    return y


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, doc_id: str = "doc_id",
        text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED,
        swap_weight: float = SWAP_WEIGHT, terms=IDENTITY_TERMS) -> Model:
    """Fit to the label rows for which ``use`` (over their columns) holds."""
    y = sampled_labels(labels, F.lit(True) if use is None else use, doc_id, label, max_labelled)
    rows = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))
    rows = rows.join(F.broadcast(y), "__id")
    other = swaps(terms)

    totals = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("positive")).first()
    n, positive = totals["n"], totals["positive"] or 0
    if positive in (0, n):
        share = positive / n if n else 0.0
        return Model(math.log((share + 1e-6) / (1 - share + 1e-6)), {})
    chosen = telling_features(rows, n, positive)

    def extract(texts: list[str | None]) -> list[tuple]:
        seen: dict[bytes, list[int]] = {}
        kept = set(chosen)
        out = []
        for t in texts:
            words = {w.strip(_EDGE) for w in lower_words_of(t)}
            named = words & other.keys()
            swapped = (words - named) | {other[w] for w in named} if named else None
            out.append(tuple(None if ws is None else np.array(
                sorted(text_features(ws, seen) & kept), np.int32).tobytes() for ws in (words, swapped)))
        return out

    found = map_batches(rows, ["__text"], extract, "features binary, swapped binary", ["toxic"])
    data = found.toArrow()
    # In an order that does not depend on the partitions, so that reruns agree.
    rows = sorted(zip(data["features"].to_pylist(), data["toxic"].to_pylist(), data["swapped"].to_pylist()),
                  key=lambda r: r[:2])
    w, bias = logistic([np.frombuffer(f, np.int32) for f, _, _ in rows],
                       [None if s is None else np.frombuffer(s, np.int32) for _, _, s in rows],
                       np.array([t for _, t, _ in rows], float), np.array(chosen, np.int32), swap_weight)
    return Model(bias, dict(zip(chosen, w.tolist())))


def telling_features(rows: DataFrame, n: int, positive: int) -> list[int]:
    """The features whose toxic count stands out from their share of the texts,
    and those of toxic texts only, counted over all rows of ``__text, toxic``: each batch counts its texts, the owner of a slice of the
    feature range adds the counts up."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            df, pos, seen = np.zeros(DIMENSION, np.uint32), np.zeros(DIMENSION, np.uint32), {}
            for t, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = np.fromiter(text_features({w.strip(_EDGE) for w in lower_words_of(t)}, seen), np.int64)
                df[f] += 1
                if toxic:
                    pos[f] += 1
            out = []
            for i in range(SLICES):
                part = slice(i * DIMENSION // SLICES, (i + 1) * DIMENSION // SLICES)
                at = np.flatnonzero(df[part])
                out.append((i, pack_keys((at + part.start).astype(np.uint64)), pack_numbers(df[part][at]),
                            pack_numbers(pos[part][at])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["slice", "features", "df", "pos"])

    def choose(group: pa.Table) -> pa.Table:
        df, pos = np.zeros(DIMENSION), np.zeros(DIMENSION)
        for f, d, p in zip(*(group[c].to_pylist() for c in ("features", "df", "pos"))):
            f = unpack_keys(f).astype(np.int64)
            df[f] += unpack_numbers(d, np.uint32)
            pos[f] += unpack_numbers(p, np.uint32)
        neg = df - pos
        # Without smoothing, so that few texts suffice where all of them are toxic.
        share = positive / n
        stands_out = np.abs(pos - df * share) >= LEAST_Z * np.sqrt(df * share * (1 - share))
        return pa.table({"feature": np.flatnonzero((df >= LEAST_DOCS) & (stands_out | (neg == 0)))})

    counted = rows.select("__text", "toxic").mapInArrow(count, "slice int, features binary, df binary, pos binary")
    best = counted.groupBy("slice").applyInArrow(choose, "feature long")
    return sorted(r[0] for r in best.toLocalIterator())


def logistic(texts: list[np.ndarray], swapped: list, y: np.ndarray, chosen: np.ndarray,
             swap_weight: float) -> tuple[np.ndarray, float]:
    """Weights of the chosen features and bias, with a ridge and the penalty on
    score changes under swaps."""
    n, k = len(y), len(chosen)

    def sparse(arrays):
        cols = np.searchsorted(chosen, np.concatenate([*arrays, np.zeros(0, np.int32)]))
        return np.repeat(np.arange(len(arrays)), [len(a) for a in arrays]), cols

    r, c = sparse(texts)
    pairs = [i for i, s in enumerate(swapped) if s is not None]
    r1, c1 = sparse([texts[i] for i in pairs])
    r2, c2 = sparse([swapped[i] for i in pairs])
    w, bias = np.zeros(k), float(np.log(y.sum() / (n - y.sum())))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, STEPS + 1):  # Adam over all sampled rows
        z = np.bincount(r, weights=w[c], minlength=n) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(c, weights=(p - y)[r], minlength=k) / n + RIDGE * w
        if pairs:
            change = (np.bincount(r1, weights=w[c1], minlength=len(pairs))
                      - np.bincount(r2, weights=w[c2], minlength=len(pairs)))
            g += swap_weight * 2 / n * (np.bincount(c1, weights=change[r1], minlength=k)
                                        - np.bincount(c2, weights=change[r2], minlength=k))
        g = np.append(g, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, bias = w - step[:k], bias - float(step[k])
    return w, bias


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score``, 0 to 1, of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def scores(texts: list[str | None]) -> list[tuple]:
        bias, weights = shared.value
        seen: dict[bytes, tuple] = {}
        out = []
        for t in texts:
            hit: set[int] = set()
            for w in set(lower_words_of(t)):
                f = seen.get(w)
                if f is None:
                    if len(seen) > 500_000:
                        seen.clear()
                    f = seen[w] = tuple(i for i in word_features(w) if i in weights)
                if f:
                    hit.update(f)
            z = bias + sum(weights[i] for i in sorted(hit))
            out.append((float(1 / (1 + np.exp(-min(30.0, max(-30.0, z))))),))
        return out

    return map_batches(docs, [text], scores, "score double", list(keep))
