"""Counts, distributions and column summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators import ordering
from panelspark.schema import DISK_KEY


def _is(label: str, value: int) -> Column:
    return F.count_if(F.col(label) == value)


def records_per_month(df: DataFrame, date: str = "dt") -> DataFrame:
    return df.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def faults_per_month_by_model(df: DataFrame, label: str = "tag") -> DataFrame:
    """Rows with the label set, per month, for disk models 1 and 2 side by side."""
    hit = F.col(label) == 1
    return df.groupBy(F.year("dt").alias("year"), F.month("dt").alias("month")).agg(
        F.count_if(hit & (F.col("model") == 1)).alias("model_one"),
        F.count_if(hit & (F.col("model") == 2)).alias("model_two"),
    )


def fault_vs_normal_per_month(df: DataFrame, label: str = "tag") -> DataFrame:
    return df.groupBy(F.year("dt").alias("year"), F.month("dt").alias("month")).agg(
        _is(label, 1).alias("fault_disk"), _is(label, 0).alias("normal_disk")
    )


def fault_ratio_by_weekday(df: DataFrame, label: str = "tag") -> DataFrame:
    """Counts by weekday (Monday = 0) and their ratio to seven digits."""
    counts = df.groupBy(F.weekday("dt").alias("weekday")).agg(
        _is(label, 1).alias("fault_disk"), _is(label, 0).alias("normal_disk")
    )
    return counts.withColumn("ratio", F.bround(F.try_divide("fault_disk", "normal_disk"), 7))


def fault_type_matrix(faults: DataFrame, kinds: Sequence[int] = range(7)) -> DataFrame:
    """Month by fault kind with zeros, and the month's total."""
    month = F.date_format("fault_time", "yyyy-MM").alias("month")
    return (
        faults.groupBy(month)
        .agg(*[_is("tag", k).alias(f"tag_{k}") for k in kinds], F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n"), "month")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def stacked(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """Wide sensors to ``(keep…, column, value)``."""
    typed = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(list(keep), list(columns), "column", "value")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum per column, all exact."""
    long = stacked(df, columns).filter(F.col("value").isNotNull())
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    parts = ordering.quantiles(long, ["column"], "value", [0.25, 0.5, 0.75])
    return moments.join(parts.drop("n"), "column").select(
        "column", "count", "mean", "std", "min",
        F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"), "max",
    )


def boxplot_stats(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Exact five-number summary of each column per group."""
    parts = ordering.quantiles(stacked(df, columns, by), ["column", by], "value", [0.0, 0.25, 0.5, 0.75, 1.0])
    names = ["min", "q25", "q50", "q75", "max"]
    return parts.select("column", by, "n", *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])


def boxplot_stats_approx(df: DataFrame, columns: Sequence[str], by: str, accuracy: int = 10_000) -> DataFrame:
    """The same from mergeable sketches: one pass, no ordering, error at most 1/``accuracy`` in rank."""
    probs = F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])
    out = df.groupBy(by).agg(*[F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(c) for c in columns])
    names = ["min", "q25", "q50", "q75", "max"]
    return out.unpivot([by], list(columns), "column", "q").select(
        "column", by, *[F.col("q")[i].alias(n) for i, n in enumerate(names)]
    )


def null_counts_by_label(df: DataFrame, columns: Sequence[str], label: str = "tag") -> DataFrame:
    return df.groupBy(label).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def records_per_disk(df: DataFrame, keys: Sequence[str] = DISK_KEY) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"))


def records_per_disk_histogram(df: DataFrame, bins: int = 10, keys: Sequence[str] = DISK_KEY) -> DataFrame:
    """Disks by number of records in equal bins, the last one closed: ``(bin, disks)``."""
    counts = records_per_disk(df, keys)
    span = counts.agg(F.min("records").alias("lo"), F.max("records").alias("hi"))
    bounds = span.select(F.struct("lo", "hi")).scalar()
    width = (F.col("__b.hi") - F.col("__b.lo")) / F.lit(bins)
    index = F.when(width > 0, F.floor((F.col("records") - F.col("__b.lo")) / width)).otherwise(0)
    return (
        counts.withColumn("__b", bounds)
        .groupBy(F.least(index, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("disks"))
    )


def density_profile(first: DataFrame, second: DataFrame, columns: Sequence[str], bins: int = 50, log: bool = False) -> DataFrame:
    """Share of rows per bin in two datasets, on bins shared by both: ``(column, bin, first, second)``.

    With ``log`` the values are passed through the logarithm first, 0 staying 0.
    """
    def long(df: DataFrame, is_first: bool) -> DataFrame:
        out = stacked(df, columns).filter(F.col("value").isNotNull())
        if log:
            v = F.col("value")
            out = out.withColumn("value", F.when(v == 0, 0.0).when(v > 0, F.ln(v))).filter(F.col("value").isNotNull())
        return out.withColumn("is_first", F.lit(is_first))

    # Two aggregates without a shuffle of values: a row per column and task, then one per bin and task.
    values = long(first, True).unionByName(long(second, False))
    bounds = values.groupBy("column").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.count_if("is_first").alias("na"), F.count_if(~F.col("is_first")).alias("nb"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    # ``bounds`` has one row per column name, so its size is fixed by the schema.
    return (
        values.join(F.broadcast(bounds), "column")
        .groupBy("column", index.cast("int").alias("bin"))
        .agg(
            F.try_divide(F.count_if("is_first"), F.first("na")).alias("first_share"),
            F.try_divide(F.count_if(~F.col("is_first")), F.first("nb")).alias("second_share"),
        )
    )


def minmax_distinct(first: DataFrame, second: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values (NULL counts), maximum and minimum per column of two tables."""
    def one(df: DataFrame, name: str) -> DataFrame:
        folded = stacked(df, columns).groupBy("column", "value").agg(F.lit(1).alias("one"))
        return folded.groupBy("column").agg(
            F.count("one").alias("distinct_values"), F.max("value").alias("max"), F.min("value").alias("min")
        ).withColumn("dataset", F.lit(name))

    return one(first, "first").unionByName(one(second, "second"))


def class_balance(df: DataFrame, label: str = "tag") -> DataFrame:
    counts = df.agg(F.count_if(F.col(label) > 0).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"))
    return counts.withColumn("ratio", F.bround(F.try_divide("positives", "negatives"), 5))


def category_share(df: DataFrame, columns: Sequence[str], limit: float = 0.005, least_categories: int = 5) -> DataFrame:
    """``(column, value, share)`` of the values above ``limit``, for columns with enough categories.

    NULL counts as a category and towards the total but gets no row of its own.
    """
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counts = text.unpivot([], list(columns), "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("categories"))
    return (
        counts.join(F.broadcast(totals), "column")  # one row per column name
        .filter((F.col("categories") >= least_categories) & F.col("value").isNotNull())
        .select("column", "value", F.bround(F.col("n") / F.col("total"), 3).alias("share"))
        .filter(F.col("share") > limit)
    )


def disk_class_counts(df: DataFrame, label: str = "tag") -> DataFrame:
    """Disks with a fault, disks without, and their ratio."""
    disks = df.groupBy(*DISK_KEY).agg(F.max((F.col(label) != 0).cast("int")).alias("faulty"))
    return disks.agg(
        F.count_if(F.col("faulty") == 1).alias("fault_disks"), F.count_if(F.col("faulty") == 0).alias("normal_disks")
    ).withColumn("ratio", F.try_divide("fault_disks", "normal_disks"))


def crosstab(df: DataFrame, x: str, y: str) -> DataFrame:
    """Contingency counts in long form ``(x, y, n)``; cells without rows are left out."""
    return df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))


def top_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)

