"""Profiles of any span of time from small stored sketches, without reading the rows again.

A period (a month or a day) of a sensor is a row of counts, sums, bounds, a quantile sketch and a
distinct-value sketch. Rows of many periods merge to the profile of their span, with the errors of one
sketch: about 1/3 % of the rank for quantiles at the default size, about 1 % for distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sizes of the sketches: items kept per level of the quantile sketch, log2 of the distinct sketch's registers.
QUANTILE_ITEMS, DISTINCT_BITS = 800, 14


def sketch_periods(df: DataFrame, columns: Sequence[str], period: str = "yyyyMM", by: Sequence[str] = (), date: str = "dt") -> DataFrame:
    """One row per period, group and sensor: ``period, by, column, rows, n, total, squares, low, high, ranks, values``.

    One partial aggregate over the wide table; NaN counts as missing, rows without a date form a period of
    their own (NULL).
    """
    def summary(c: str) -> Column:
        plain = F.col(f"`{c}`").cast("double")
        v = F.when(~F.isnan(plain), plain)
        return F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"),
            F.min(v).alias("low"), F.max(v).alias("high"), F.kll_sketch_agg_double(v, F.lit(QUANTILE_ITEMS)).alias("ranks"),
            F.hll_sketch_agg(v.cast("string"), F.lit(DISTINCT_BITS)).alias("values"),
        )

    keyed = df.withColumn("period", F.date_format(date, period).cast("int"))
    return keyed.groupBy("period", *by).agg(F.array(*[summary(c) for c in columns]).alias("__s")).select("period", *by, F.inline("__s"))


def store_sketches(sketches: DataFrame, path: str) -> None:
    """Put the sketches of whole periods in place; other periods stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def read_sketches(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Stored sketches of the periods from ``first`` to ``last``; other periods are not opened."""
    out = spark.read.parquet(path)
    if first is not None:
        out = out.filter(F.col("period") >= first)
    return out if last is None else out.filter(F.col("period") <= last)


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per group and sensor for all periods together, in the columns of :func:`sketch_periods`."""
    some = F.col("n") > 0
    return sketches.groupBy(*by, "column").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double(F.when(some, F.col("ranks"))).alias("ranks"), F.hll_union_agg(F.when(some, F.col("values"))).alias("values"),
    )


def profile_of(merged: DataFrame, by: Sequence[str] = (), probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``by, column, rows, n, mean, std, min, q<i>, max, distinct``: exact but for quantiles and distinct values."""
    some = F.col("n") > 0
    quantile = F.when(some, F.kll_sketch_get_quantile_double("ranks", F.array(*[F.lit(float(p)) for p in probs])))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") - F.col("total") * F.col("total") / F.col("n")) / (F.col("n") - 1))
    return merged.withColumn("__q", quantile).select(
        *by, "column", "rows", "n", (F.col("total") / F.col("n")).alias("mean"), F.when(F.col("n") > 1, spread).alias("std"), F.col("low").alias("min"),
        *[F.col("__q")[i].alias(f"q{i}") for i in range(len(probs))], F.col("high").alias("max"),
        F.when(some, F.hll_sketch_estimate("values")).otherwise(0).alias("distinct"),
    )


def _grid(ranks: Column, points: int) -> Column:
    """Quantiles at the middles of ``points`` equal parts of the rank."""
    return F.kll_sketch_get_quantile_double(ranks, F.array(*[F.lit((i + 0.5) / points) for i in range(points)]))


def _share_upto(grid: str, value: Column, points: int) -> Column:
    return F.size(F.filter(grid, lambda q: q <= value)) / F.lit(float(points))


def density_of(first: DataFrame, second: DataFrame, bins: int = 50, points: int = 1000) -> DataFrame:
    """Share of values per bin in two merged tables, on equal bins over both: ``column, bin, first_share, second_share``;
    a bin takes its upper border, a column with one value has one bin. Shares are multiples of 1 / ``points``."""
    pair = _pairs(first, second)
    low, high = F.least("a.low", "b.low"), F.greatest("a.high", "b.high")
    edges = F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda i: F.when(i == bins, high).otherwise(low + (high - low) * i / bins))

    def shares(side: str) -> Column:
        upto = F.transform("edges", lambda e: _share_upto(f"__{side}", e, points))
        before = F.concat(F.array(F.lit(0.0)), F.slice(upto, 1, bins - 1))
        return F.zip_with(upto, before, lambda u, b: u - b)

    pair = pair.withColumn("__a", _grid(F.col("a.ranks"), points)).withColumn("__b", _grid(F.col("b.ranks"), points))
    spread = pair.withColumn("edges", F.when(high > low, edges).otherwise(F.array_repeat(high, bins)))
    both = spread.select(F.col("a.column").alias("column"), F.arrays_zip(shares("a").alias("x"), shares("b").alias("y")).alias("s"))
    return both.select("column", F.posexplode("s").alias("bin", "s")).select(
        "column", "bin", F.col("s.x").alias("first_share"), F.col("s.y").alias("second_share")
    ).filter((F.col("first_share") > 0) | (F.col("second_share") > 0))


def drift_of(first: DataFrame, second: DataFrame, points: int = 400) -> DataFrame:
    """``column, statistic``: the greatest distance of the two distributions, looked for at ``points`` quantiles of each."""
    pair = _pairs(first, second).withColumn("__a", _grid(F.col("a.ranks"), points)).withColumn("__b", _grid(F.col("b.ranks"), points))
    gaps = F.transform(F.concat("__a", "__b"), lambda x: F.abs(_share_upto("__a", x, points) - _share_upto("__b", x, points)))
    return pair.select(F.col("a.column").alias("column"), F.array_max(gaps).alias("statistic"))


def _pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row per sensor that has values in both tables."""
    a, b = first.filter("n > 0").alias("a"), second.filter("n > 0").alias("b")
    return a.join(b, F.col("a.column") == F.col("b.column"))
