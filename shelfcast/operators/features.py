"""Feature operators: date parts, lags, rolling stats, price momentum, event
distance, target encodings, category codes and scaling.

All per-series windows share one spec, ``partitionBy('id').orderBy('d_int')``,
so Spark plans a single Exchange + Sort for all of them.  A window partition
is one series: its size is the number of days, whatever the raw row counts.
Offsets count rows, as the reference's grouped shifts do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.columns import day_index, occurrence, safe_ratio, weekday0
from shelfcast.session import materialize, small_side

SALES_LAGS = [28, 35, 42, 364]
ROLL_WINDOWS = [7, 14, 30, 60]
BASE_LAG = 28
NO_EVENT = 9999  # sentinel when no event before / after a day

# The feature names of the model tables, in their order; the
# last two come from the occurrence encodings.
FEATURES_ALL = [
    "item_id", "dept_id", "cat_id", "wday", "month", "year",
    "event_name_1", "event_type_1", "snap_CA", "snap_TX", "snap_WI",
    "sell_price", "sales_lag_28", "sales_lag_35", "sales_lag_42",
    "rolling_mean_7", "rolling_std_7", "rolling_mean_14", "rolling_std_14",
    "rolling_mean_30", "rolling_std_30", "rolling_mean_60", "rolling_std_60",
    "price_change_w1", "price_change_m1", "price_max_ratio",
    "days_since_event", "days_to_event", "sales_lag_364", "item_wday_mean",
]
OCCURRENCE_FEATURES = FEATURES_ALL + ["dept_wday_mean", "item_event_mean"]
CATEGORICAL = ["dept_id", "cat_id", "event_name_1", "event_type_1"]


def feature_set(name: str, features: list[str] | None = None) -> list[str]:
    """``all`` or ``no_lags`` (drops names containing ``lag``; rolling stay) (PRJ3)."""
    feats = list(features or FEATURES_ALL)
    if name == "no_lags":
        return [f for f in feats if "lag" not in f]
    if name == "all":
        return feats
    raise ValueError(f"unknown feature set {name!r}")


def series_window(key: str = "id", order: str = "d_int"):
    return Window.partitionBy(key).orderBy(order)


def with_day_index(df: DataFrame) -> DataFrame:
    return df if "d_int" in df.columns else df.withColumn("d_int", day_index("d"))


def add_date_parts(df: DataFrame, date_col: str = "date") -> DataFrame:
    """``wday`` (Monday = 0), ``month``, ``year`` (SCL2/SCL3)."""
    d = F.to_date(F.col(date_col))
    return df.withColumns({"wday": weekday0(d), "month": F.month(d), "year": F.year(d)})


def sales_lags(df: DataFrame, lags=SALES_LAGS, key: str = "id") -> DataFrame:
    """``sales_lag_k = lag(sales, k)`` per series, in rows (WIN3/WIN4)."""
    df = with_day_index(df)
    w = series_window(key)
    return df.withColumns({f"sales_lag_{k}": F.lag("sales", k).over(w) for k in lags})


def _running(df: DataFrame, values: dict[str, Column], w) -> DataFrame:
    """Running sums over the rows so far, under the given names."""
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({name: F.coalesce(F.sum(v).over(so_far), F.lit(0)) for name, v in values.items()})


def _between(name: str, w, base_lag: int, n: int) -> Column:
    """The sum over the ``n`` rows that end ``base_lag`` rows back: the
    difference of two running sums (none before the first row)."""
    return F.lag(name, base_lag, 0).over(w) - F.lag(name, base_lag + n, 0).over(w)


def rolling_stats(df: DataFrame, windows=ROLL_WINDOWS, base_lag: int = BASE_LAG,
                  key: str = "id", value: str = "sales") -> DataFrame:
    """Rolling mean / sample std over ``n`` rows ending ``base_lag`` rows back (WIN5).

    A value only when the frame holds all ``n`` rows (pandas' default
    ``min_periods``).  Whole numbers go by running sums of count, x and x
    squared in one pass, exact in 64 bits, whose differences at two places give
    every window; other types, where differences would lose digits, by the
    frame ``rowsBetween(-(base_lag-1+n), -base_lag)``.
    """
    df = with_day_index(df)
    w = series_window(key)
    cols = {}
    if df.schema[value].dataType.simpleString() in ("tinyint", "smallint", "int"):
        x = F.col(value).cast("long")
        out = _running(df, {"__n": F.when(x.isNotNull(), F.lit(1)).otherwise(0).cast("long"), "__s": x, "__q": x * x}, w)
        for n in windows:
            total, squares = (_between(c, w, base_lag, n) for c in ("__s", "__q"))
            full = _between("__n", w, base_lag, n) == n
            spread = (squares * n - total * total).cast("double") / F.lit(float(n * (n - 1)) if n > 1 else None)
            cols[f"rolling_mean_{n}"] = F.when(full, total / F.lit(float(n)))
            cols[f"rolling_std_{n}"] = F.when(full, F.sqrt(spread))
        return out.withColumns(cols).drop("__n", "__s", "__q")
    for n in windows:
        fr = w.rowsBetween(-(base_lag - 1 + n), -base_lag)
        full = F.count(value).over(fr) == n
        cols[f"rolling_mean_{n}"] = F.when(full, F.avg(value).over(fr))
        cols[f"rolling_std_{n}"] = F.when(full, F.stddev_samp(value).over(fr))
    return df.withColumns(cols)


def recent_occurrence(df: DataFrame, rows: int = 28, base_lag: int = BASE_LAG, key: str = "id") -> DataFrame:
    """``occ_rate_n``: share of sold rows among ``n`` rows ending ``base_lag``
    rows back; NULL unless all are there.  Same window spec as the lags."""
    df, w = with_day_index(df), series_window(key)
    known = F.col("sales").isNotNull()
    out = _running(df, {"__n": known.cast("long"), "__o": F.when(known, occurrence("sales")).cast("long")}, w)
    return out.withColumn(f"occ_rate_{rows}", F.when(
        _between("__n", w, base_lag, rows) == rows, _between("__o", w, base_lag, rows) / F.lit(float(rows)))).drop("__n", "__o")


def price_momentum(df: DataFrame, key: str = "id", causal: bool = False) -> DataFrame:
    """Price ratios to 7 and 28 rows back and to the series' max price (WIN1/WIN2).

    Missing or zero divisors give 1.0 (NULL-safe ``try_divide``).  The max
    looks at the whole series, future included, as the reference does;
    ``causal=True`` uses the running max instead (B7).
    """
    df = with_day_index(df)
    w = series_window(key)
    p = F.col("sell_price")
    whole = Window.partitionBy(key)
    mx = F.max(p).over(w.rowsBetween(Window.unboundedPreceding, 0) if causal else whole)
    return df.withColumns({
        "price_change_w1": safe_ratio(p, F.lag(p, 7).over(w), 1.0),
        "price_change_m1": safe_ratio(p, F.lag(p, 28).over(w), 1.0),
        "price_max_ratio": safe_ratio(p, mx, 1.0),
    })


def event_days(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Days since the last / to the next event, counted in calendar rows (WIN6).

    Computed on the distinct dates of ``df`` (one row per date, an event if any
    event name is set that day, B12): a table bounded by the number of days.
    Only that small table is ordered globally.
    """
    days = (df.groupBy(date_col)
            .agg(F.max(F.col("event_name_1").isNotNull().cast("int")).alias("is_event")))
    w = Window.orderBy(date_col)
    idx = F.row_number().over(w) - 1
    days = days.withColumn("idx", idx)
    ev_idx = F.when(F.col("is_event") == 1, F.col("idx"))
    last_ev = F.last(ev_idx, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    next_ev = F.first(ev_idx, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return days.select(
        date_col,
        F.coalesce(F.col("idx") - last_ev, F.lit(NO_EVENT)).cast("smallint").alias("days_since_event"),
        F.coalesce(next_ev - F.col("idx"), F.lit(NO_EVENT)).cast("smallint").alias("days_to_event"),
    )


def event_distance(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Attach ``days_since_event`` / ``days_to_event`` by date (JON3).

    The day table has one row per date, so it is broadcast; a row without a
    date has no distance.
    """
    return df.join(F.broadcast(event_days(df, date_col)), date_col, "left")


def train_rows(df: DataFrame, train_end) -> DataFrame:
    t = train_end if isinstance(train_end, Column) else F.lit(train_end)
    return with_day_index(df).where(F.col("d_int") <= t)


def encoding_map(train: DataFrame, keys: list[str], target: Column, name: str) -> DataFrame:
    """Train-only mean of ``target`` per key; NULL keys never form a group."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return train.where(cond).groupBy(*keys).agg(F.avg(target).alias(name))


def target_encode(df: DataFrame, train_end, keys: list[str], name: str,
                  target: str = "quantity", fallback_keys: list[str] | None = None,
                  default: float = 0.0, train: DataFrame | None = None) -> DataFrame:
    """Leak-free target encoding (AGG2-AGG5).

    ``target='quantity'`` averages ``sales``; ``'occurrence'`` averages
    ``sales > 0``.  Statistics come from rows with ``d_int <= train_end`` only;
    a row with no matching group takes the ``fallback_keys`` mean, then
    ``default``.  A map is written and counted; a small one is broadcast, so
    that the rows of ``df`` are not shuffled by these few keys.
    """
    tr = train if train is not None else train_rows(df, train_end)
    tgt = F.col("sales").cast("double") if target == "quantity" else occurrence("sales").cast("double")
    out = df.join(small_side(encoding_map(tr, keys, tgt, name), f"map-{name}"), keys, "left")
    value = F.col(name)
    if fallback_keys:
        fb = f"__{name}_fb"
        out = out.join(small_side(encoding_map(tr, fallback_keys, tgt, fb), f"map-{fb}"), fallback_keys, "left")
        value = F.coalesce(value, F.col(fb))
    out = out.withColumn(name, F.coalesce(value, F.lit(default)))
    return out.drop(f"__{name}_fb") if fallback_keys else out


def add_encodings(df: DataFrame, train_end) -> DataFrame:
    """``item_wday_mean`` (quantity, item fallback), ``dept_wday_mean`` and
    ``item_event_mean`` (occurrence)."""
    df = target_encode(df, train_end, ["item_id", "wday"], "item_wday_mean",
                       "quantity", fallback_keys=["item_id"])
    df = target_encode(df, train_end, ["dept_id", "wday"], "dept_wday_mean", "occurrence")
    return target_encode(df, train_end, ["item_id", "event_name_1"], "item_event_mean", "occurrence")


def category_dictionaries(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column, value -> code`` for all ``cols``: rank among a column's sorted
    distinct non-null values (WIN10).

    One scan gives the distinct (column, value) pairs.  They are sorted by
    range, each range is numbered by itself, and the ranges' counts give their
    offsets: no task orders all values.
    """
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols]))
    vals = df.select(pair.alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull()).distinct()
    ranged = materialize(vals.repartitionByRange("column", "value")
                         .withColumn("part", F.spark_partition_id()), "dictionary-ranges")
    inside = F.row_number().over(Window.partitionBy("part", "column").orderBy("value"))
    counts = ranged.groupBy("column", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("column", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return (ranged.withColumn("inside", inside).join(offsets, ["column", "part"])
            .select("column", "value", (F.col("before") + F.col("inside") - 1).cast("int").alias("code")))


def category_dictionary(df: DataFrame, col: str) -> DataFrame:
    """``value -> code`` of one column."""
    return category_dictionaries(df, [col]).select("value", "code")


def category_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace each column with its code; NULL or unseen values become -1 (B8).

    The dictionaries are built from the whole input in one scan, so train and
    validation share codes; a small one is broadcast.
    """
    out = df
    every = materialize(category_dictionaries(df, cols), "dictionaries")
    for c in cols:
        dic = every.where(F.col("column") == c).select(F.col("value").alias(c), F.col("code").alias(f"__code_{c}"))
        out = (out.join(small_side(dic, f"dictionary-{c}"), c, "left")
               .withColumn(c, F.coalesce(F.col(f"__code_{c}"), F.lit(-1)))
               .drop(f"__code_{c}"))
    return out


def standardize(df: DataFrame, cols: list[str], by: str = "store_id",
                fit_rows: DataFrame | None = None, ddof: int = 0,
                eps: float = 0.0) -> DataFrame:
    """Per-group standard scaling (AGG19).

    ``ddof=0``: population std, zero variance -> 1 (the tabular scaler);
    ``ddof=1, eps=1e-8``: sample std + eps (the one-store sequence scaler).
    Missing values are filled with 0 first.  Statistics come from
    ``fit_rows`` (default: ``df``), a table of groups x features, broadcast
    when it counts small.
    """
    src = (fit_rows if fit_rows is not None else df).fillna(0, subset=cols)
    stats = src.groupBy(by).agg(
        *[F.avg(c).alias(f"__mu_{c}") for c in cols],
        *[(F.stddev_pop(c) if ddof == 0 else F.stddev_samp(c)).alias(f"__sd_{c}") for c in cols])
    out = df.fillna(0, subset=cols).join(small_side(stats, "scales"), by, "left")
    scaled = {}
    for c in cols:
        sd = F.col(f"__sd_{c}")
        if ddof == 0:
            sd = F.when(sd == 0, F.lit(1.0)).otherwise(sd)
        scaled[c] = (F.col(c) - F.col(f"__mu_{c}")) / (sd + F.lit(eps))
    return out.withColumns(scaled).drop(*[f"__mu_{c}" for c in cols], *[f"__sd_{c}" for c in cols])


def build_features(joined: DataFrame, train_end, causal_price_max: bool = False) -> DataFrame:
    """The full feature table over a star-joined, pre-release-dropped panel.

    One shuffle by ``id`` serves lags, rolling stats and price ratios; the
    event table and encoding maps are small joins.
    """
    df = add_date_parts(with_day_index(joined))
    df = sales_lags(df)
    df = rolling_stats(df)
    df = recent_occurrence(df)
    df = price_momentum(df, causal=causal_price_max)
    df = event_distance(df)
    return add_encodings(df, train_end)
