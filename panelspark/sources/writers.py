"""Writers of panels, features, alerts and sequences."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators import clean, rolling
from panelspark.schema import DISK_KEY, columns_with_token


def write_panel(df: DataFrame, path: str, mode: str = "append") -> None:
    """Add rows to a panel partitioned by month; rows of a month are brought together first, in as
    many pieces as their size asks for."""
    month = F.date_format("dt", "yyyyMM").cast("int")
    out = df.withColumn("month", month).hint("rebalance", "month")
    out.write.mode(mode).partitionBy("month").parquet(path)


def store_panel(df: DataFrame, path: str, period: str = "yyyyMM") -> None:
    """Put whole periods (months, or days with ``yyyyMMdd``) of a panel in place: those in ``df`` are replaced,
    others stay, so that a period may be written again. Periods may differ in their columns; the store's
    columns are kept beside it, and a column that changes its type is an error. One writer at a time."""
    spark = df.sparkSession
    known = stored_columns(spark, path)
    fields = {f.name: f.dataType for f in known or []}
    for f in df.schema:
        if fields.setdefault(f.name, f.dataType) != f.dataType:
            raise TypeError(f"{f.name} is stored as {fields[f.name].simpleString()}, not as {f.dataType.simpleString()}")
    every = T.StructType([T.StructField(n, t) for n, t in fields.items()])
    if known is None or [f.name for f in known] != every.names:
        spark.createDataFrame([(every.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_columns")
    out = df.withColumn("period", F.date_format("dt", period).cast("int")).hint("rebalance", "period")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def stored_columns(spark: SparkSession, path: str) -> T.StructType | None:
    """Columns that any period of the store has; None where there is no store yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_columns")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return T.StructType.fromJson(json.loads(spark.read.text(f"{path}/_columns", wholetext=True).first()["value"]))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All periods of a store, with NULL where a period lacks a column. No file is opened for its schema."""
    return spark.read.schema(stored_columns(spark, path).add("period", T.IntegerType())).parquet(path)


def bucket_panel(df: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Store a panel as table ``name`` with each disk's rows in one bucket, by day: the feature plan then reads the
    rows where it needs them and starts without an exchange. Rows are brought to their buckets first, so that a
    bucket is one file; take as many buckets as a shuffle of the panel would have partitions."""
    placed = df.repartition(buckets, *DISK_KEY)
    placed.write.bucketBy(buckets, *DISK_KEY).sortBy(*DISK_KEY, "dt").mode("overwrite").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def write_test_panel(df: DataFrame, path: str) -> None:
    """Drop columns with too many NULLs, narrow the types, store."""
    kept = df.drop(*clean.fit_null_prune(df))
    clean.correct_types(kept).write.parquet(path)


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_sample(df: DataFrame, path: str) -> None:
    """Keep the sample that is already there."""
    df.write.mode("ignore").parquet(path)


def write_submission(df: DataFrame, path: str) -> None:
    """One headerless CSV. The result holds at most one row per disk alerted and at most the daily
    cap of rows per day, so a single file is enough."""
    ordered = df.select("manufacturer", "model", "serial_number", "dt").orderBy("dt", "model", "serial_number")
    ordered.coalesce(1).write.option("header", False).csv(path)


def write_sequences(df: DataFrame, path: str, features: list[str], label: str = "tag", length: int = 20, rows_per_file: int = 100_000) -> None:
    windows = rolling.sequence_windows(df, features, label, length)
    windows.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def slice_to_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV per day."""
    df.hint("rebalance", "dt").write.partitionBy("dt").option("header", True).csv(path)


def split_raw_normalized(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The key with the raw sensors and the key with the normalized ones, without all-NULL columns."""
    empty = set(clean.fit_null_prune(df, all_null_only=True))
    normalized = [c for c in columns_with_token(df, "normalized") if c not in keys]
    raw = [c for c in df.columns if c not in keys and c not in normalized]
    return (
        df.select(*keys, *[c for c in raw if c not in empty]),
        df.select(*keys, *[c for c in normalized if c not in empty]),
    )
