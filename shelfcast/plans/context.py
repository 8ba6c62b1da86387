"""Shared plans for one (session, table folder).

The reference runs as separate steps joined by files (preprocessed panel ->
feature table -> prediction table).  The same boundaries exist here as
Parquet tables written under the shared ``spark.checkpoint.dir``:

- ``daily``: per (series, day) sums of the raw line items (one raw pass)
- ``joined``: the star-joined panel, pre-release rows included (partitioned
  by store, so a store filter prunes files)
- ``features``: the feature table over the pre-release-dropped panel
- ``quantity_preds`` / ``occurrence_probs``: long prediction tables

Each is computed once per application and folder, cuts lineage (a lost
executor re-reads the files instead of recomputing from the raw scans), and
is shared by every report.  Queries still run their own operator on top of
these tables; queries about the panel build itself run from the raw tables.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators import ensemble as E
from shelfcast.operators import features as FT
from shelfcast.operators import panel as P
from shelfcast.session import materialize, materialize_by_key, new_path, on_release
from shelfcast.sources import standin as S
from shelfcast.sources.files import write_wide_lines
from shelfcast.sources.tables import table_stamp

_TABLES: dict = {}


def _forget(application: str) -> None:
    for key in [k for k in _TABLES if k[0] == application]:
        del _TABLES[key]


on_release(_forget)


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """The inputs' files, so a rewritten table is not reused."""
    return tuple(table_stamp(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation", "region"))


class RetailContext:
    def __init__(self, spark: SparkSession, sf_dir: str, horizon: int = P.HORIZON,
                 persist: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.horizon = horizon
        self.persist = persist

    def _table(self, name: str, build, partition_by=None) -> DataFrame:
        if not self.persist:
            return build()
        key = (self.spark.sparkContext.applicationId, self.sf_dir, _stamp(self.spark, self.sf_dir), name)
        if key not in _TABLES:
            _TABLES[key] = materialize(build(), name, partition_by)
        return _TABLES[key]

    # ---------------------------------------------------------- inputs
    @cached_property
    def calendar(self) -> DataFrame:
        return S.calendar(self.spark, self.sf_dir)

    @cached_property
    def daily(self) -> DataFrame:
        """Per (series, day) sums of the raw line items: the one raw-table pass."""
        return self._table("daily", lambda: S.daily_lines(self.spark, self.sf_dir))

    @cached_property
    def prices(self) -> DataFrame:
        return S.sell_prices(self.spark, self.sf_dir, self.daily)

    @cached_property
    def n_days(self) -> int:
        return S.n_days(self.spark, self.sf_dir)

    @cached_property
    def train_end(self) -> int:
        """Last training day ``T = max(d_int) - horizon``."""
        return self.n_days - self.horizon

    @cached_property
    def sales_wide(self) -> DataFrame:
        """The wide sales input (a file in the reference), pivoted from the panel."""
        return self._table("sales_wide", lambda: S.sales_wide(self.spark, self.sf_dir, self.sales_long))

    @cached_property
    def wide_file(self) -> str:
        """The wide sales CSV: what the reference starts from.  Its path."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, _stamp(self.spark, self.sf_dir), "wide_file")
        if key not in _TABLES:
            path = new_path(self.spark, "wide-file")
            write_wide_lines(self.sales_long, path, S.ID_COLS, self.n_days)
            _TABLES[key] = path
        return _TABLES[key]

    # ----------------------------------------------------------- panel
    @cached_property
    def joined(self) -> DataFrame:
        """Star-joined panel with ``d_int``, so that day filters reach the files."""
        return self._table("joined", lambda: FT.with_day_index(P.star_join(
            S.sales_long(self.spark, self.sf_dir, self.daily), self.calendar, self.prices)), ["store_id"])

    @cached_property
    def series(self) -> DataFrame:
        """The joined panel in buckets of ``id``, sorted by day: series windows
        over it need no exchange."""
        if not self.persist:
            return self.joined
        key = (self.spark.sparkContext.applicationId, self.sf_dir, _stamp(self.spark, self.sf_dir), "series")
        if key not in _TABLES:
            _TABLES[key] = materialize_by_key(self.joined, "series", "id", "d_int")
        return _TABLES[key]

    @cached_property
    def series_panel(self) -> DataFrame:
        return P.drop_prerelease(self.series)

    @cached_property
    def sales_long(self) -> DataFrame:
        return self.joined.select(*S.ID_COLS, "d", "sales", "d_int")

    @cached_property
    def panel(self) -> DataFrame:
        """Star-joined panel without pre-release rows, with ``d_int``."""
        return P.drop_prerelease(self.joined)

    @cached_property
    def features(self) -> DataFrame:
        return self._table("features", lambda: FT.build_features(self.series_panel, self.train_end),
                           ["store_id"])

    @cached_property
    def coded(self) -> DataFrame:
        """The feature table with categories and the store as codes: what all fits read."""
        from shelfcast.operators.models import CATEGORIES, with_store_code
        return self._table("coded", lambda: with_store_code(FT.category_codes(self.features, CATEGORIES)),
                           ["store_id"])

    def fitted_members(self, grid: list) -> DataFrame:
        """Predictions of some configs of the model grid.  A fit is grown once
        per application, for the first query that takes it; those which a grid
        lacks grow together."""
        from shelfcast.operators.models import distinct_fits, grid_members, grow_fits
        fits = distinct_fits(grid)
        key = (self.spark.sparkContext.applicationId, self.sf_dir, _stamp(self.spark, self.sf_dir))
        tables = {f.name: _TABLES.get((*key, f"fit-{f.name}")) for f in fits} if self.persist else {}
        lacking = [f for f in fits if tables.get(f.name) is None]
        if lacking:
            grown = grow_fits(self.coded.where(F.col("d_int") <= self.train_end),
                              E.validation_rows(self.coded, self.train_end, self.horizon), lacking)
            tables |= {f.name: grown.where(F.col("fit") == f.name) for f in lacking}
        if self.persist:
            _TABLES.update({(*key, f"fit-{name}"): table for name, table in tables.items()})
        return grid_members(reduce(DataFrame.unionByName, tables.values()), grid)

    @cached_property
    def fitted_grid(self) -> DataFrame:
        """Predictions of the whole model grid, fitted once per application."""
        from shelfcast.operators.models import model_grid
        return self._table("fitted_grid", lambda: self.fitted_members(model_grid()), ["store_id"])

    @cached_property
    def fitted_occurrence(self) -> DataFrame:
        """Probabilities of the three boosted classifiers and the sequence model."""
        from shelfcast.operators.models import boosted_occurrence, kernel_occurrence
        return self._table("fitted_occurrence", lambda: boosted_occurrence(
            self.coded.where(F.col("d_int") <= self.train_end),
            E.validation_rows(self.coded, self.train_end, self.horizon)).unionByName(
                kernel_occurrence(self.features, self.train_end)), ["store_id"])

    # ------------------------------------------------------ forecasts
    @cached_property
    def quantity_preds(self) -> DataFrame:
        return self._table("quantity_preds", lambda: E.quantity_candidates(
            self.features, self.train_end, self.horizon), ["store_id"])

    @cached_property
    def model_rmse(self) -> DataFrame:
        from shelfcast.operators.metrics import rmse
        return rmse(self.quantity_preds, "sales", "pred", ["store_id", "model_id"])

    @cached_property
    def weights(self) -> DataFrame:
        return E.ensemble_weights(self.model_rmse)

    @cached_property
    def ensemble(self) -> DataFrame:
        """Prediction table ``id, d, store_id, sales, simple_avg_pred``."""
        return self._table("ensemble", lambda: E.weighted_ensemble(self.quantity_preds, self.weights),
                           ["store_id"])

    @cached_property
    def occurrence_probs(self) -> DataFrame:
        return self._table("occurrence_probs", lambda: E.occurrence_candidates(
            self.features, self.train_end, self.horizon), ["store_id"])

    @cached_property
    def scored(self) -> DataFrame:
        return E.power_mean(self.occurrence_probs)

    @cached_property
    def sweep(self) -> DataFrame:
        return E.threshold_sweep(self.scored)

    @cached_property
    def best(self) -> DataFrame:
        return E.best_threshold(self.sweep)


def ctx(spark: SparkSession, sf_dir: str, persist: bool = True) -> RetailContext:
    return RetailContext(spark, sf_dir, persist=persist)
