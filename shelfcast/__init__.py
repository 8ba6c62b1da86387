"""shelfcast: retail demand analytics expressed as Spark DataFrame plans.

Every operator takes and returns a ``DataFrame``; nothing is collected to the
driver except scalar parameters.  Sub-packages:

- ``sources``   table scans, the stand-in star schema, file sources and sinks
- ``functions`` column expressions (day index, dates, ids, narrowing)
- ``operators`` reshape, joins, features, sequences, metrics, ensembles, models
- ``plans``     the named query registry and its DuckDB oracle SQL
- ``streaming`` incremental forecast sink (per-store dynamic overwrite)
"""

from shelfcast.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
