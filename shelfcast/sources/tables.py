"""Parquet table scans with explicit column lists (pruned at the reader)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def table_stamp(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """Names, lengths and times of a table's files, through Spark's own file
    systems: the same for local paths and object stores, and different as soon
    as a file of the folder changes."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return ()
    files = fs.listFiles(path, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """Scan one table.  Naming the columns keeps ``ReadSchema`` minimal."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def folder_of(df: DataFrame) -> str:
    """The folder of a DataFrame that reads one Parquet table, partition folders left out."""
    parts = df.inputFiles()[0].split("/")[:-1]
    while "=" in parts[-1]:
        parts.pop()
    return "/".join(parts)


def footer_scan(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet scan whose plain counts, minima and maxima come from the files'
    footers: the DataSource V2 reader takes aggregates down to the files
    (``spark.sql.parquet.aggregatePushdown``), which the default reader does not.
    Timestamps and strings have no such bounds and are scanned."""
    key = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(key)
    spark.conf.set(key, ",".join(s for s in before.split(",") if s.strip() != "parquet"))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(key, before)
