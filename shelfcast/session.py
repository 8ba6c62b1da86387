"""Session construction and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators are written against.  AQE re-plans at runtime: it
# turns sort-merge joins into broadcast joins only when the *measured* shuffle
# output of a side is under the threshold (the size check behind every
# broadcast of a data-dependent table), coalesces small partitions and splits
# skewed ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
_WRITTEN: list[tuple[str, str]] = []  # (application, path) of materialized tables
_CATALOG: list[tuple[str, str]] = []  # (application, name) of those in the session's catalog
LOCAL_DRIVER_MEMORY = "16g"  # local mode: the driver JVM is the only executor


def get_spark(master: str | None = None, app: str = "shelfcast",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults.

    On a cluster pass ``master=None`` and let the launcher decide; locally the
    caller passes ``local[N]`` and a matching shuffle partition count.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = LOCAL_DRIVER_MEMORY
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/object store)
    folder and is left alone; without it a cluster session raises, since a
    machine-local folder would differ per executor.  Local masters get a fresh
    folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="shelfcast-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def checkpoint_dir(spark: SparkSession) -> str:
    return spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder, tracked for ``release_tables``."""
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:8]}")
    _WRITTEN.append((spark.sparkContext.applicationId, path))
    return path


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    This cuts lineage (a lost executor recomputes from the written files, not
    from the raw scan) and keeps column statistics for later pruning.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if partition_by:
        # Rows of a partition come together, a large one in several tasks:
        # a few files per partition instead of one per partition and task.
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)


def materialize_by_key(df: DataFrame, name: str, key: str, order: str) -> DataFrame:
    """As ``materialize``, in buckets of ``key`` that are sorted by ``order``: a
    window or aggregate over ``key`` then needs no exchange.

    The rows go to their buckets before the write, so a bucket is one file.
    The table stands in the session's catalog until ``release_tables``.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, name)
    table = "shelfcast_" + os.path.basename(path).replace("-", "_")
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, order).format("parquet")
     .option("path", path).saveAsTable(table))
    _CATALOG.append((spark.sparkContext.applicationId, table))
    return spark.table(table)


BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def small_side(df: DataFrame, name: str, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A lookup table for a join with fact rows: written, counted, and marked
    for broadcast if it has at most ``rows`` rows and, by its columns' widths
    and the length of its texts, ``most_bytes`` bytes; else the join shuffles."""
    written = materialize(df, name)
    texts = [f.name for f in written.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    length = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in texts), F.lit(0)) + 8 * len(written.columns) + 16
    n, size = written.agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0))).first()
    return F.broadcast(written) if n <= rows and size <= most_bytes else written


_ON_RELEASE: list[Callable[[str], None]] = []  # called with the application when its tables go


def on_release(forget: Callable[[str], None]) -> None:
    """Have ``forget(application)`` called by ``release_tables``, for what keeps plans over the tables."""
    _ON_RELEASE.append(forget)


def release_tables(spark: SparkSession) -> int:
    """Delete the folders that this application wrote; plans over them are
    unusable afterwards, and shared tables are built anew.  Returns their number."""
    for forget in _ON_RELEASE:
        forget(spark.sparkContext.applicationId)
    for owner, table in [t for t in _CATALOG if t[0] == spark.sparkContext.applicationId]:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        _CATALOG.remove((owner, table))
    app, n = spark.sparkContext.applicationId, 0
    for owner, path in [w for w in _WRITTEN if w[0] == app]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        n += bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))
        _WRITTEN.remove((owner, path))
    return n
