"""Daily ranking of scores and the alerts drawn from it.

A day can hold any share of the rows, so nothing here orders a whole day in one task: ranks come
from running totals over folded scores, and the top of a day from per-task limits before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators import ordering
from panelspark.schema import ALERT_QUANTILE, ALERTS_PER_DAY, DISK_KEY


def daily_average_rank(df: DataFrame, score: str = "prob", date: str = "dt", ranges: int | None = None) -> DataFrame:
    """Add ``rank``: ascending rank of the score within its day, ties sharing their mean."""
    df = df.withColumn(score, _score(score))
    ranks = ordering.average_rank(df, [date], score, ranges).select(date, score, "rank")
    return df.join(ranks, [date, score], "left").select(*df.columns, "rank")


def _score(score: str) -> Column:
    """The score with NaN as NULL, so that it never ranks first."""
    value = F.col(score).cast("double")
    return F.when(~F.isnan(value), F.col(score))


def quantile_cut_flag(ranked: DataFrame, quantile: float = ALERT_QUANTILE, date: str = "dt", flag: str = "label") -> DataFrame:
    """Add 1 where the rank reaches ``quantile`` of the day's number of rows."""
    sizes = ranked.groupBy(date).agg(F.count(F.lit(1)).alias("__n"))
    hit = F.coalesce((F.col("rank") >= F.col("__n") * F.lit(quantile)).cast("int"), F.lit(0))
    return ranked.join(sizes, date).select(*ranked.columns, hit.alias(flag))


def top_per_day(df: DataFrame, n: int, score: str = "prob", date: str = "dt", key: Sequence[str] = DISK_KEY) -> DataFrame:
    """The ``n`` best scores of each day, ties in key order."""
    w = Window.partitionBy(date).orderBy(F.col(score).desc(), *key)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def daily_alerts(
    df: DataFrame,
    score: str = "prob",
    quantile: float = ALERT_QUANTILE,
    per_day: int = ALERTS_PER_DAY,
    date: str = "dt",
    key: Sequence[str] = DISK_KEY,
) -> DataFrame:
    """Rows at or above the day's rank cut, at most ``per_day`` of the best, with their ``rank``.

    Equal to rank, cut and top-n in that order. As the rank grows with the score, only the
    ``per_day`` highest distinct scores of a day can be alerts, and their ranks follow from the
    number of rows above them. The lowest of them that passes the cut filters the rows in place;
    only what is left is shuffled.
    """
    df = df.withColumn(score, _score(score))
    folded = df.groupBy(date, score).agg(F.count(F.lit(1)).alias("__ties"))
    sizes = folded.groupBy(date).agg(F.sum("__ties").alias("__n"))
    best = Window.partitionBy(date).orderBy(F.col(score).desc())
    top = (
        folded.filter(F.col(score).isNotNull())
        .withColumn("__rn", F.row_number().over(best))
        .filter(F.col("__rn") <= per_day)
        .withColumn("__upto", F.sum("__ties").over(best.rowsBetween(Window.unboundedPreceding, 0)))
        .join(sizes, date)
        .withColumn("rank", F.col("__n") - F.col("__upto") + (F.col("__ties") + 1) / 2)
        .filter(F.col("rank") >= F.col("__n") * F.lit(quantile))
        .select(date, score, "rank")
    )
    lowest = top.groupBy(date).agg(F.min(score).alias("__lowest"))
    left = df.join(lowest, date).filter(F.col(score) >= F.col("__lowest"))
    # Ties first go down to the daily cap, then the few rows left look up their rank.
    best_rows = top_per_day(left.select(*df.columns), per_day, score, date, key)
    return best_rows.join(top, [date, score]).select(*df.columns, "rank")


def summarize_days(df: DataFrame, per_day: int = ALERTS_PER_DAY, score: str = "prob", date: str = "dt", key: Sequence[str] = DISK_KEY) -> DataFrame:
    """All that a day's alerts depend on, in at most 2 x ``per_day`` + 1 rows a day: ``date, kind, score, ties, key``.

    ``all``: the day's number of rows in ``ties``; ``score``: its ``per_day`` highest distinct scores and how many
    rows have them; ``row``: its ``per_day`` best rows. Summaries of parts of a day can be merged: a score or a
    row among the best of a day is among the best of each part that it lies in.
    """
    rows = df.select(F.col(date), _score(score).alias(score), F.lit(1).cast("long").alias("ties"), *key)
    folded = rows.groupBy(date, score).agg(F.sum("ties").alias("ties"))
    parts = [
        folded.groupBy(date).agg(F.sum("ties").alias("ties")).withColumn("kind", F.lit("all")),
        folded.filter(F.col(score).isNotNull()).withColumn("kind", F.lit("score")),
        rows.filter(F.col(score).isNotNull()).drop("ties").withColumn("kind", F.lit("row")),
    ]
    out = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    return _best(out, per_day, score, date, key)


def merge_day_summaries(summaries: Sequence[DataFrame], per_day: int = ALERTS_PER_DAY, score: str = "prob", date: str = "dt", key: Sequence[str] = DISK_KEY) -> DataFrame:
    """The summary of all rows that ``summaries`` (of :func:`summarize_days`) tell of."""
    every = summaries[0]
    for s in summaries[1:]:
        every = every.unionByName(s)
    counted = every.filter("kind <> 'row'").groupBy(date, "kind", score).agg(F.sum("ties").alias("ties"))
    return _best(counted.unionByName(every.filter("kind = 'row'"), True), per_day, score, date, key)


def _best(summary: DataFrame, per_day: int, score: str, date: str, key: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(date, "kind").orderBy(F.col(score).desc(), *key)
    best = summary.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= per_day)
    return best.select(date, "kind", F.col(score).cast("double").alias(score), "ties", *key)


def alerts_of_summary(
    summary: DataFrame, quantile: float = ALERT_QUANTILE, score: str = "prob", date: str = "dt", key: Sequence[str] = DISK_KEY
) -> DataFrame:
    """The rows that :func:`daily_alerts` gives, from summaries alone."""
    sizes = summary.filter("kind = 'all'").select(date, F.col("ties").alias("__n"))
    upto = Window.partitionBy(date).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    top = (
        summary.filter("kind = 'score'").withColumn("__upto", F.sum("ties").over(upto)).join(sizes, date)
        .withColumn("rank", F.col("__n") - F.col("__upto") + (F.col("ties") + 1) / 2)
        .filter(F.col("rank") >= F.col("__n") * F.lit(quantile))
    )
    return summary.filter("kind = 'row'").select(date, score, *key).join(top.select(date, score, "rank"), [date, score])


def first_alert_per_disk(alerts: DataFrame, date: str = "dt", key: Sequence[str] = DISK_KEY) -> DataFrame:
    """Earliest alert of each disk. Later ones vanish here, after they took a place on their day."""
    rest = [c for c in alerts.columns if c not in key and c != date]
    first = F.min(F.struct(date, *rest)).alias("__a")
    return alerts.groupBy(*key).agg(first).select(
        *[F.col(c) if c in key else F.col(f"__a.`{c}`").alias(c) for c in alerts.columns]
    )


def submission(alerts: DataFrame, manufacturer: str = "A") -> DataFrame:
    """First alerts in the layout of the result file."""
    first = first_alert_per_disk(alerts)
    return first.select(F.lit(manufacturer).alias("manufacturer"), "model", "serial_number", "dt")
