"""Cleaning: duplicates, missing values, types and data-dependent column choice.

Column choices are fitted first (``fit_*`` reads one row of statistics) and applied as plain
selects, so that a job that trains and a job that predicts use the same columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.schema import (
    DISTINCT_LIMIT,
    INDEX_COLUMNS,
    LABEL_COLUMNS,
    MISSING_CATEGORY,
    MISSING_CONTINUOUS,
    NULL_PERCENT_LIMIT,
    POWER_ON_HOURS,
    column_roles,
)


def in_date_range(df: DataFrame, start: str | None = None, end: str | None = None, date: str = "dt") -> DataFrame:
    """Inclusive range; either bound may be open."""
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(end).cast("date"))
    return df


def of_model(df: DataFrame, model: int | None) -> DataFrame:
    return df if model is None else df.filter(F.col("model") == model)


def powered_on(df: DataFrame, hours: str = POWER_ON_HOURS) -> DataFrame:
    """Drop rows with zero power-on hours; unknown hours stay."""
    return df.filter(~F.col(hours).eqNullSafe(0))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Treat NaN as missing, as SQL aggregates do with NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def dedupe_disk_day(df: DataFrame, key: Sequence[str] = INDEX_COLUMNS, order: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the first by ``order`` (all other columns by default, a total order).

    Spark keeps one row per key and task before the shuffle, so copies of one key, however many,
    never meet in one task.
    """
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    first = Window.partitionBy(*key).orderBy(*(rest if order is None else order))
    return df.withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") == 1).drop("__rn")


# --- missing values --------------------------------------------------------------------------


def per_column(df: DataFrame, columns: Sequence[str], stats: dict[str, object]) -> DataFrame:
    """Statistics of many columns in one aggregate, as one row per column.

    ``stats`` maps a name to a function ``column -> aggregate Column``.
    """
    wide = df.agg(*[F.struct(*[fn(F.col(c)).alias(s) for s, fn in stats.items()]).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])
    return wide.select(F.explode(entries).alias("e")).select("e.column", "e.s.*")


def null_percent(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, null_percent)``, rounded half-even to two digits."""
    share = {"null_percent": lambda c: F.bround(F.avg(c.isNull().cast("int")) * 100, 2)}
    return per_column(df, df.columns if columns is None else columns, share)


def fit_null_prune(df: DataFrame, limit: float = NULL_PERCENT_LIMIT, all_null_only: bool = False) -> list[str]:
    """Columns with at least ``limit`` percent NULL, or only those without any value."""
    if all_null_only:
        counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
        return [c for c in df.columns if counts[c] == 0]
    over = {r["column"] for r in null_percent(df).filter(F.col("null_percent") >= limit).collect()}
    return [c for c in df.columns if c in over]


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, distinct_values)`` with NULL counted as one value.

    The columns are stacked and repeated values folded before the shuffle.
    """
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    stacked = typed.unpivot([], list(columns), "column", "value").groupBy("column", "value").agg(F.lit(1).alias("one"))
    return stacked.groupBy("column").agg(F.count("one").alias("distinct_values"))


def fit_distinct_prune(df: DataFrame, columns: Sequence[str], limit: int = DISTINCT_LIMIT) -> list[str]:
    """Columns with at most ``limit`` distinct values, NULL counted as one."""
    if limit <= 1:
        # One value at most: min and max agree and NULLs do not mix with values. No shuffle needed.
        one = df.agg(
            *[
                (
                    (F.coalesce(F.min(c) == F.max(c), F.lit(True)))
                    & ((F.count(c) == F.count(F.lit(1))) | (F.count(c) == 0))
                ).alias(c)
                for c in columns
            ]
        ).first()
        return [c for c in columns if one[c]] if limit == 1 else []
    few = {r["column"] for r in distinct_counts(df, columns).filter(F.col("distinct_values") <= limit).collect()}
    return [c for c in columns if c in few]


def small_std(df: DataFrame, columns: Sequence[str], limit: float = 1.0) -> DataFrame:
    """``(column, std, drop)``: sample deviation rounded to two digits, to drop at or below ``limit``."""
    stats = per_column(df, columns, {"std": lambda c: F.bround(F.stddev_samp(c), 2)})
    return stats.withColumn("drop", F.coalesce(F.col("std") <= limit, F.lit(False)))


def fit_std_prune(df: DataFrame, columns: Sequence[str], limit: float = 1.0) -> list[str]:
    low = {r["column"] for r in small_std(df, columns, limit).filter("drop").collect()}
    return [c for c in columns if c in low]


def fit_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns if row[c] is not None}


def fill_mean(df: DataFrame, columns: Sequence[str], means: dict[str, float] | None = None) -> DataFrame:
    return df.na.fill(fit_means(df, columns) if means is None else means)


def fill_constant(
    df: DataFrame,
    continuous: Sequence[str] = (),
    category: Sequence[str] = (),
    value: float = MISSING_CONTINUOUS,
    category_value: int = MISSING_CATEGORY,
) -> DataFrame:
    values = {**{c: value for c in continuous}, **{c: category_value for c in category}}
    return df.na.fill(values) if values else df


def missing_strategy(df: DataFrame, strategy: str, value: float = 0.0) -> DataFrame:
    """``replace`` NULL, ``drop_samples`` (rows), ``drop_features`` (columns) or ``skip``."""
    if strategy == "replace":
        numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
        text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        return df.na.fill({**{c: value for c in numeric}, **{c: str(value) for c in text}})
    if strategy in ("drop", "drop_samples"):
        return df.na.drop()
    if strategy == "drop_features":
        holes = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
        return df.drop(*[c for c in df.columns if holes[c]])
    if strategy == "skip":
        return df
    raise ValueError(f"unknown strategy {strategy!r}")


# --- types -----------------------------------------------------------------------------------

_INTEGERS = [(T.ByteType(), 2**7), (T.ShortType(), 2**15), (T.IntegerType(), 2**31)]
_FLOAT_LIMIT = 3.4028234663852886e38


def fit_types(df: DataFrame) -> dict[str, T.DataType]:
    """Smallest type that holds each continuous column strictly inside its range; labels and model
    as bytes."""
    roles = column_roles(df)
    types: dict[str, T.DataType] = {
        c: T.ByteType() for c in df.columns if c == "model" or c in LABEL_COLUMNS
    }
    if not roles.continuous:
        return types
    row = df.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in roles.continuous]).first()
    for c in roles.continuous:
        low, high = row[c]
        integral = isinstance(df.schema[c].dataType, T.IntegralType)
        types[c] = T.LongType() if integral else T.DoubleType()
        if low is None:
            continue
        if integral:
            types[c] = next((t for t, n in _INTEGERS if -n < low and high < n - 1), T.LongType())
        elif -_FLOAT_LIMIT < low and high < _FLOAT_LIMIT:
            types[c] = T.FloatType()
    return types


def correct_types(df: DataFrame, types: dict[str, T.DataType] | None = None, dates: Sequence[str] = ("dt", "fault_time")) -> DataFrame:
    """Narrow the columns and parse ``yyyyMMdd`` dates."""
    from panelspark.functions.scalar import parse_yyyymmdd

    types = fit_types(df) if types is None else types
    changes: dict[str, Column] = {c: F.col(c).cast(t) for c, t in types.items() if c in df.columns}
    for c in dates:
        if c in df.columns and not isinstance(df.schema[c].dataType, T.DateType):
            changes[c] = parse_yyyymmdd(c)
    return df.withColumns(changes)
