"""Incremental per-store results sink (SNK3 as Structured Streaming).

Finished per-store prediction files land in a folder; a streaming query picks
up new files and writes every micro-batch under ``store_id=.../batch_id=...``.
A batch that runs again after a failure replaces its own partitions only, so
nothing is lost or doubled; the checkpoint location (under the shared
checkpoint folder) records which files were consumed.  Readers take, for each
``(store_id, id, d)``, the row of the latest batch.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfcast.session import checkpoint_dir
from shelfcast.sources.files import PREDICTIONS_SCHEMA

STORE_PREDICTIONS_SCHEMA = T.StructType(PREDICTIONS_SCHEMA.fields + [T.StructField("store_id", T.StringType())])
KEYS = ["store_id", "id", "d"]


def stream_store_results(spark: SparkSession, source_dir: str, sink_dir: str,
                         checkpoint: str | None = None, once: bool = True,
                         schema: T.StructType = STORE_PREDICTIONS_SCHEMA) -> StreamingQuery:
    """Start the stream; ``once=True`` processes what is there and stops."""
    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), "store-results-stream")

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(epoch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("store_id", "batch_id").parquet(sink_dir))

    reader = spark.readStream.schema(schema).parquet(source_dir)
    writer = reader.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")
    return writer.start()


def read_store_results(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The latest row of every ``(store_id, id, d)``: an aggregate with
    map-side partials, no window over a store."""
    df = spark.read.parquet(sink_dir)
    rest = [c for c in df.columns if c not in (*KEYS, "batch_id")]
    latest = df.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
    return latest.select(*KEYS, *[F.col(f"r.`{c}`").alias(c) for c in rest])
