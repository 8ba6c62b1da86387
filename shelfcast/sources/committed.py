"""Per-store results that a stopped run leaves whole and the next one continues (SNK3).

Results of finished (store, member) pairs are written under a folder of their
own for every attempt; only then a manifest row for each pair is appended.
Readers take the parts that the manifest names, so the remains of an attempt
that stopped in between are never seen, and a run asks the manifest what is
left to do.  Spark's committer makes either write appear whole or not at all;
a pair that two runs finish at the same time counts once, by the later attempt.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["store_id", "model_id"]
MANIFEST = "store_id string, model_id string, attempt string, n_rows long"


class StoreResults:
    """Committed results under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def manifest(self) -> DataFrame:
        """One row per committed pair: its attempt and number of rows."""
        folder = os.path.join(self.path, "commits")
        if not self._exists(folder):
            return self.spark.createDataFrame([], MANIFEST)
        rows = self.spark.read.schema(MANIFEST).json(folder)
        return rows.groupBy(*KEYS).agg(F.max(F.struct("attempt", "n_rows")).alias("c")).select(*KEYS, "c.attempt", "c.n_rows")

    def missing(self, stores: Iterable[str], members: Iterable[str]) -> dict[str, list[str]]:
        """Per store the members that are not committed (stores x members rows are read)."""
        done = {(r["store_id"], r["model_id"]) for r in self.manifest().collect()}
        left = {s: [m for m in members if (s, m) not in done] for s in stores}
        return {s: ms for s, ms in left.items() if ms}

    def commit(self, results: DataFrame) -> int:
        """Write the results of finished pairs, then their manifest rows; the
        number of pairs.  Times order attempts; the rest keeps them apart."""
        attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        folder = os.path.join(self.path, "data", attempt)
        results.hint("rebalance", *KEYS).write.partitionBy(*KEYS).parquet(folder)
        pairs = self._read(folder, results).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"))
        pairs = pairs.select(*KEYS, F.lit(attempt).alias("attempt"), "n_rows").persist()
        n = pairs.count()
        if n:
            pairs.coalesce(1).write.mode("append").json(os.path.join(self.path, "commits"))
        pairs.unpersist()
        return n

    def _read(self, folder: str, like: DataFrame) -> DataFrame:
        kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields]
        return self.spark.read.schema(", ".join(kept)).parquet(folder)

    def read(self, schema: str) -> DataFrame:
        """The rows of all committed pairs."""
        done = self.manifest()
        folders = [os.path.join(self.path, "data", r["attempt"]) for r in done.select("attempt").distinct().collect()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        out = None
        for folder in folders:  # one per commit
            one = self.spark.read.schema(schema).parquet(folder).withColumn("attempt", F.lit(os.path.basename(folder)))
            out = one if out is None else out.unionByName(one)
        chosen = F.broadcast(done.select(*KEYS, "attempt"))  # stores x members rows
        return out.join(chosen, [*KEYS, "attempt"], "left_semi").drop("attempt")


def resume(results: StoreResults, stores: list[str], members: list[str],
           make: Callable[[list[str], list[str]], DataFrame], stores_at_once: int = 1) -> int:
    """Make and commit what is missing, ``stores_at_once`` stores per commit:
    ``make(stores, members)`` gives their rows.  The number of pairs committed."""
    left = results.missing(stores, members)
    names, n = sorted(left), 0
    for i in range(0, len(names), max(1, stores_at_once)):
        part = names[i:i + max(1, stores_at_once)]
        wanted = sorted({m for s in part for m in left[s]})
        open_pairs = results.spark.createDataFrame([(s, m) for s in part for m in left[s]], "store_id string, model_id string")
        n += results.commit(make(part, wanted).join(F.broadcast(open_pairs), KEYS, "left_semi"))
    return n
