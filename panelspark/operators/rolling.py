"""Rolling features per disk. Every function works on a panel with one row per disk and day.

All windows partition by the disk key, so a chain of them keeps the first exchange.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from panelspark.schema import DISK_KEY

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors get the functions with the task


def by_disk(keys: Sequence[str] = DISK_KEY, date: str = "dt") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(date)


def last_rows(n: int, keys: Sequence[str] = DISK_KEY, date: str = "dt") -> WindowSpec:
    return by_disk(keys, date).rowsBetween(-(n - 1), 0)


_AGGREGATES = {"min": F.min, "max": F.max, "std": F.stddev_samp, "mean": F.avg}


def rolling_stats(columns: Sequence[str], n: int, kinds: Sequence[str] = ("min", "max", "std")) -> list[Column]:
    """``{column}_{kind}_{n}`` over the last ``n`` rows of the disk, kinds being ``min``, ``max``,
    ``std`` (sample; NULL where the frame has one value) and ``mean``. All share one window."""
    frame = last_rows(n)
    return [_AGGREGATES[k](c).over(frame).alias(f"{c}_{k}_{n}") for k in kinds for c in columns]


def frame_shapes(x: np.ndarray, known: np.ndarray, row: np.ndarray, n: int, kinds: Sequence[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per row each kind's value and whether it is NULL, over the known values of the row and the ``n - 1`` before it.

    ``x`` and ``known`` begin with the ``n - 1`` rows before the first; ``row`` numbers the rows of a disk from 1, so it
    tells how many of the rows before belong to it.
    """
    size = len(row)
    lags = [(x[n - 1 - i : n - 1 - i + size], known[n - 1 - i : n - 1 - i + size] & (row > i)) for i in range(n - 1, -1, -1)]
    k, total, mean, m2, m3, m4 = (np.zeros(size) for _ in range(6))
    for value, own in lags:  # one value more at a time, as the aggregates add it, so that ties of rounding fall alike
        total += np.where(own, value, 0.0)
        k = k + own
        delta = np.where(own, value - mean, 0.0)
        part = np.where(own, delta / k, 0.0)
        delta2, part2 = delta * delta, part * part
        mean = mean + part
        m2 = m2 + delta * (delta - part)
        m3 = m3 - 3.0 * part * m2 + delta * (delta2 - part2)
        m4 = m4 - 4.0 * part * m3 - 6.0 * part2 * m2 + delta * (delta * delta2 - part * part2)
    flat = m2 / k <= 1e-14  # not so where a value is not a number
    out = {}
    for kind in kinds:
        if kind == "skew":
            out[kind] = np.sqrt(k) * m3 / np.sqrt(m2 * m2 * m2) * np.sqrt(k * (k - 1)) / (k - 2), (k < 3) | flat
        elif kind == "kurt":
            out[kind] = (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * (k * m4 / (m2 * m2) - 3) + 6), (k < 4) | flat
        else:
            out[kind] = np.sqrt(m2 / (k - 1)) / (total / k), (k < 2) | (total / k == 0)
    return out


def _shapes(names: Sequence[str], columns: Sequence[str], n: int, kinds: Sequence[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Goes through disks in order of their days; keeps the ``n - 1`` rows before a batch."""
        before = {c: (np.zeros(n - 1), np.zeros(n - 1, bool)) for c in columns}
        for batch in batches:
            row = batch.column("__row").to_numpy()
            out = [batch.column(i) for i in range(len(names))]
            for c in columns:
                values = batch.column(names.index(c)).cast(pa.float64(), safe=False)
                x = np.concatenate([before[c][0], values.fill_null(0.0).to_numpy(zero_copy_only=False)])
                known = np.concatenate([before[c][1], values.is_valid().to_numpy(zero_copy_only=False) & (row > n)])
                before[c] = x[len(row) :], known[len(row) :]
                with np.errstate(all="ignore"):
                    made = frame_shapes(x, known, row, n, kinds)
                out += [pa.array(value, pa.float64(), mask=null) for value, null in made.values()]
            yield pa.RecordBatch.from_arrays(out, [*names, *[f"{c}_{kind}_{n}" for c in columns for kind in kinds]])

    return run


def shape_features(df: DataFrame, columns: Sequence[str], n: int, kinds: Sequence[str] = ("skew", "kurt", "cv")) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis and the coefficient of variation.

    The first ``n`` rows of a disk take no part. Frames with fewer than 3 (4; cv: 2) values, or without
    spread (cv: with mean 0), give NULL. The window numbers and orders the rows; the moments of all frames of a
    batch are worked out at once, which takes a small part of the time of as many window aggregates.
    """
    rows = df.withColumn("__row", F.row_number().over(by_disk())).sortWithinPartitions(*DISK_KEY, "dt")  # as the window leaves them
    made = [StructField(f"{c}_{kind}_{n}", DoubleType()) for c in columns for kind in kinds]
    return rows.mapInArrow(_shapes(df.columns, list(columns), n, list(kinds)), StructType([*df.schema.fields, *made]))


def period_diff(columns: Sequence[str], n: int) -> list[Column]:
    """Change against the value ``n`` rows ago."""
    w = by_disk()
    return [(F.col(c) - F.lag(c, n).over(w)).alias(f"{c}_diff_for_last_period_{n}") for c in columns]


def shift_lag(columns: Sequence[str], periods: Sequence[int]) -> list[Column]:
    """Values of earlier rows (the columns keep the name of the feature they stand for)."""
    w = by_disk()
    return [F.lag(c, p).over(w).alias(f"{c}_diff_with_last_period_{p}") for p in periods for c in columns]


def add_rolling_slope(df: DataFrame, columns: Sequence[str], hours: str, n: int) -> DataFrame:
    """Least-squares slope of a column on the whole power-on days of its last ``n`` distinct readings.

    A reading counts once per distinct (value, hours) pair of the disk, at its first day; slopes stand
    on those rows only and need all ``n`` readings. Hours without change give NULL. The finer window
    keys are satisfied by the disk partitioning, so they add sorts but no exchange.
    """
    out = df
    for c in columns:
        pair = Window.partitionBy(*DISK_KEY, c, hours).orderBy("dt")
        fresh = F.col(c).isNotNull() & F.col(hours).isNotNull() & (F.row_number().over(pair) == 1)
        frame = Window.partitionBy(*DISK_KEY, "__fresh").orderBy("dt").rowsBetween(-(n - 1), 0)
        days = F.floor(F.col(hours) / 24).cast("double")
        slope = F.when(
            F.col("__fresh") & (F.count(F.lit(1)).over(frame) == n) & (F.var_pop(days).over(frame) > 0),
            F.regr_slope(F.col(c), days).over(frame),
        )
        out = (
            out.withColumn("__fresh", fresh)
            .withColumn(f"{c}_slope_for_last_duration_{n}", slope)
            .drop("__fresh")
        )
    return out


def forward_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace NULL by the last known value of the same disk."""
    upto = by_disk().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})


def last_n_per_disk(df: DataFrame, n: int = 14) -> DataFrame:
    w = Window.partitionBy(*DISK_KEY).orderBy(F.col("dt").desc())
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def sequence_windows(df: DataFrame, features: Sequence[str], label: str, length: int = 20) -> DataFrame:
    """Every run of ``length`` consecutive rows of a disk as a matrix, with the label of its last row."""
    frame = last_rows(length)
    return (
        df.select(
            *DISK_KEY,
            "dt",
            label,
            F.collect_list(F.struct("dt", F.array(*[F.col(c).cast("double") for c in features]).alias("x")))
            .over(frame)
            .alias("__rows"),
        )
        .filter(F.size("__rows") == length)
        .select(
            *DISK_KEY,
            F.element_at("__rows", 1)["dt"].alias("first_dt"),
            F.col("dt").alias("last_dt"),
            F.transform("__rows", lambda r: r["x"]).alias("data"),
            F.col(label),
        )
    )
