"""Dense daily calendar per disk, and the way back to the observed days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.schema import DISK_KEY


def fill_calendar(
    df: DataFrame,
    keys: Sequence[str] = DISK_KEY,
    date: str = "dt",
    zero_columns: Sequence[str] = (),
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """One row per disk and day from the first to the last reading (or ``start`` to ``end``).

    A day without a reading takes the whole last row before it, NULLs included; ``zero_columns``
    take 0 there. ``observed`` tells real rows from filled ones. Each reading is copied to the days
    up to the next one, so the step needs one window over the disk and no join. Expects at most one
    row per disk and day, which bounds a disk's rows by the length of the calendar.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    day = F.col(date)
    until = F.coalesce(F.date_sub(F.lead(date).over(w), 1), F.lit(end).cast("date") if end else day)
    since = day
    if start:
        bound = F.lit(start).cast("date")
        since = F.when(F.lag(date).over(w).isNull(), bound).otherwise(F.greatest(day, bound))
    if end:
        until = F.least(until, F.lit(end).cast("date"))
    spans = df.withColumn("__since", since).withColumn("__until", until)
    if start or end:
        spans = spans.filter(F.col("__since") <= F.col("__until"))
    rows = spans.withColumn("__day", F.explode(F.sequence("__since", "__until")))
    observed = F.col("__day") == day
    out = []
    for c in df.columns:
        if c == date:
            out.append(F.col("__day").alias(date))
        elif c in keys:
            out.append(F.col(c))
        elif c in zero_columns:
            out.append(F.when(observed, F.col(c)).otherwise(F.lit(0).cast(df.schema[c].dataType)).alias(c))
        elif start:
            out.append(F.when(F.col("__day") >= day, F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return rows.select(*out, observed.alias("observed"))


def observed_days(df: DataFrame) -> DataFrame:
    """Drop the filled days again."""
    return df.filter("observed").drop("observed")
