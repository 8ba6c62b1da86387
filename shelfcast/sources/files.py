"""File sources and sinks of the reference's formats (SRC1-SRC3, SNK1-SNK5).

Schemas are explicit: no inference pass over the data.  Only the wide sales
file has a data-dependent column list (``d_1..d_N``), read from its header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALENDAR_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("wm_yr_wk", T.IntegerType()),
    T.StructField("weekday", T.StringType()),
    T.StructField("wday", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("d", T.StringType()),
    T.StructField("event_name_1", T.StringType()),
    T.StructField("event_type_1", T.StringType()),
    T.StructField("event_name_2", T.StringType()),
    T.StructField("event_type_2", T.StringType()),
    T.StructField("snap_CA", T.IntegerType()),
    T.StructField("snap_TX", T.IntegerType()),
    T.StructField("snap_WI", T.IntegerType()),
])

PRICES_SCHEMA = T.StructType([
    T.StructField("store_id", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("wm_yr_wk", T.IntegerType()),
    T.StructField("sell_price", T.DoubleType()),
])

PREDICTIONS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("d", T.StringType()),
    T.StructField("sales", T.IntegerType()),
    T.StructField("simple_avg_pred", T.DoubleType()),
])

TEMPLATE_SCHEMA = T.StructType([T.StructField("id", T.StringType())] +
                               [T.StructField(f"F{i}", T.DoubleType()) for i in range(1, 29)])

WIDE_ID_COLS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header row and a fixed schema, matched by column name (SRC1/SRC2).

    The header's order is free; a column that is missing raises, further
    columns are not read.  A value that does not fit its type is NULL.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_wide_sales(spark: SparkSession, path: str, prefix: str = "d_") -> DataFrame:
    """Wide sales CSV: id columns as strings, every ``d_*`` column as int (SRC1).

    The header gives the column list; values are read as strings and cast in
    one projection, so no inference pass scans the file.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    exprs = [f"`{c}`" if not c.startswith(prefix) else f"CAST(`{c}` AS INT) AS `{c}`" for c in raw.columns]
    return raw.selectExpr(*exprs)


def write_wide_lines(long: DataFrame, path: str, id_cols: list[str], n_days: int, day: str = "d_int",
                     value: str = "sales", prefix: str = "d_") -> None:
    """Wide sales CSV of a dense long panel, header first in every part (SRC1).

    A row's days are one array, joined into text: no plan has a column per day.
    A series without exactly days ``1..n_days`` raises.
    """
    cell = F.sort_array(F.collect_list(F.struct(F.col(day).alias("i"), F.col(value).alias("v"))))
    rows = long.groupBy(*id_cols).agg(cell.alias("cells"))
    dense = ((F.size("cells") == n_days) & (F.col("cells")[0]["i"] == 1) & (F.col("cells")[n_days - 1]["i"] == n_days))
    days = F.array_join(F.transform("cells", lambda c: F.coalesce(c["v"].cast("string"), F.lit(""))), ",")
    line = F.concat(F.to_csv(F.struct(*id_cols)), F.lit(","), days)
    line = F.when(dense, line).otherwise(F.raise_error(F.lit("the wide file needs one row per day 1..n")))
    header = ",".join([*id_cols, *[f"{prefix}{i}" for i in range(1, n_days + 1)]])
    # The header is a row of its own before each part's lines.
    place = F.row_number().over(Window.partitionBy("part").orderBy("line"))
    parts = rows.select(line.alias("line")).withColumn("part", F.spark_partition_id()).withColumn("place", place)
    lines = parts.select(F.explode(F.when(F.col("place") == 1, F.array(F.lit(header), F.col("line"))).otherwise(F.array("line"))).alias("value"))
    lines.write.mode("overwrite").text(path)


def melt_wide_lines(spark: SparkSession, path: str, id_schema: str | None = None, prefix: str = "d_", var_name: str = "d",
                    value_name: str = "sales") -> DataFrame:
    """A wide CSV as ``(id columns, d, sales)`` rows by its lines (SRC1 + RSH1).

    Files are read as text; a line's last fields are its days, exploded with
    their positions, which the header names: no column per day, and a task
    holds one line at a time.  Id columns may be quoted; a day that is empty or
    no whole number is NULL.  The header may come again at the head of parts;
    its days must come last, in any order.
    """
    text = spark.read.text(path)
    header = text.first()
    if header is None:
        raise ValueError(f"{path} has no header")
    names = [n.strip().strip('"') for n in header[0].rstrip("\r").split(",")]
    n_ids = next((i for i, n in enumerate(names) if n.startswith(prefix)), len(names))
    ids, days = names[:n_ids], names[n_ids:]
    if not ids or not days or not all(d.startswith(prefix) for d in days):
        raise ValueError(f"{path} has no id columns followed by {prefix} columns")
    schema = id_schema or ", ".join(f"`{c}` string" for c in ids)
    fields = F.split(F.regexp_replace("value", "\r$", ""), ",", -1)
    rows = text.where((F.col("value") != header[0]) & (F.length("value") > 0)).select(fields.alias("f"))
    n = F.size("f") - len(days)   # commas inside quoted ids make more fields
    rows = rows.select(F.from_csv(F.array_join(F.slice("f", F.lit(1), n), ","), schema).alias("ids"),
                       F.slice("f", n + 1, F.lit(len(days))).alias("f"))
    cells = rows.select("ids", F.posexplode("f").alias("at", "v"))
    label = F.element_at(F.split(F.lit(",".join(days)), ","), F.col("at") + 1)
    if days == [f"{prefix}{i}" for i in range(1, len(days) + 1)]:
        label = F.concat(F.lit(prefix), F.col("at") + 1)
    return cells.select("ids.*", label.alias(var_name), F.trim("v").try_cast("int").alias(value_name))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan (SRC3); naming columns prunes the read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = ("store_id",),
                  mode: str = "overwrite") -> None:
    """Parquet sink partitioned by store (SNK1): store filters prune files."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header (SNK2); one part file per task, no single writer."""
    df.write.mode(mode).option("header", True).csv(path)


def write_store_results(df: DataFrame, path: str, store_col: str = "store_id") -> None:
    """Per-store checkpointed results (SNK3).

    Dynamic partition overwrite replaces only the stores present in ``df``, so
    finishing one store rewrites that store's files, not all results so far.
    """
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(store_col).parquet(path))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines sink: the metrics record (SNK4) or sample records (SNK5)."""
    df.write.mode(mode).json(path)


def metrics_record(metrics: DataFrame, best: DataFrame) -> DataFrame:
    """The metrics JSON record (SNK4): final metrics plus the success flag.

    ``best`` is the one-row choice table; its flag enters as a scalar
    subquery, not a join.
    """
    flag = best.select("all_kill_success").scalar()
    return metrics.select(F.col("accuracy").alias("Accuracy"), F.col("precision").alias("Precision"),
                          F.col("recall").alias("Recall"), F.col("f1").alias("F1-Score"),
                          F.col("optimal_threshold").alias("Optimal_Threshold"),
                          flag.alias("All_Kill_Success"))
