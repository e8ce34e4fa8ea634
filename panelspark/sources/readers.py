"""Readers of the sensor panel and the fault log."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark import schema as S
from panelspark.functions.scalar import parse_yyyymmdd
from panelspark.operators.clean import nan_to_null
from panelspark.operators.combine import union_all


def csv_by_name(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """CSV files as text columns named by their header, an unnamed first column included.

    Files of one scan must agree on their header; one that does not is an error, not a shift of columns.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    first = spark.read.text(listed).filter(F.length("value") > 0).first()
    names = next(csv.reader([first[0]])) if first else []
    fields = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(fields).csv(listed, header=True, enforceSchema=False)


def typed(df: DataFrame, fields: Sequence[T.StructField], path: object) -> DataFrame:
    """The named columns with their types, NaN as NULL; other columns are not parsed."""
    missing = [f.name for f in fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"no column {missing} in {path}")
    return nan_to_null(df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields]))


def scan_csv_panel(spark: SparkSession, paths: str | Sequence[str], sensors: Sequence[str] | None = None) -> DataFrame:
    """Sensor CSV files: the wanted columns by their names in the header, wherever they stand.

    Large files are read in splits by many tasks; columns that are not used are not parsed.
    """
    wanted = S.panel_schema(list(sensors) if sensors is not None else None)
    return typed(csv_by_name(spark, paths), wanted.fields, paths).withColumn("dt", parse_yyyymmdd("dt"))


def daily_paths(folder: str, start: str, end: str, pattern: str = "disk_sample_smart_log_{day}_round2.csv") -> list[str]:
    """File names of a date range, one per day."""
    from datetime import date, timedelta

    first, last = date.fromisoformat(start), date.fromisoformat(end)
    return [
        f"{folder}/{pattern.format(day=(first + timedelta(days=i)).strftime('%Y%m%d'))}"
        for i in range((last - first).days + 1)
    ]


def scan_daily_files(spark: SparkSession, folder: str, start: str, end: str, columns: Sequence[str], sensors: Sequence[str] | None = None, **kw) -> DataFrame:
    """Chosen columns of the daily files of a date range, in one scan."""
    return scan_csv_panel(spark, daily_paths(folder, start, end, **kw), sensors).select(*columns)


def scan_day_partitions(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Days of a panel that is partitioned by ``dt``; other days are not listed or read."""
    days = spark.read.parquet(path).filter(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return nan_to_null(days)


def scan_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return nan_to_null(spark.read.parquet(path).select(*columns))


def load_panel(spark: SparkSession, path: str, is_train: bool, start: str = "", end: str = "", columns: Sequence[str] | None = None, sensors: Sequence[str] | None = None, **kw) -> DataFrame:
    """The prepared store for training, the daily drop of a date range for prediction."""
    if is_train:
        wanted = columns or [*S.INDEX_COLUMNS, *S.SENSORS, "tag", "flag"]
        return scan_columns(spark, path, wanted)
    return scan_daily_files(spark, path, start, end, columns or [*S.INDEX_COLUMNS, *S.SENSORS], sensors, **kw)


def scan_fault_log(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Both fault files in order, columns by name; what else a file has is dropped.

    ``list_order`` keeps the order of the lists: file first, then line within the file's splits.
    """
    def one(path: str, place: int) -> DataFrame:
        line = F.struct(F.lit(place).alias("file"), F.col("_metadata.file_path").alias("path"),
                        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        df = csv_by_name(spark, path).withColumn("list_order", line)
        return typed(df, [*S.FAULT_SCHEMA.fields, df.schema["list_order"]], path)

    both = union_all(one(first, 0), one(second, 1))
    return both.withColumn("fault_time", F.to_date("fault_time"))
