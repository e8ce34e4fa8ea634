"""Joins and set operations on keyed tables.

No broadcast is forced: Spark broadcasts a side whose measured size allows it and otherwise
shuffles by key, with skewed partitions split at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.schema import INDEX_COLUMNS


def rejoin_labels(features: DataFrame, labels: DataFrame, on: Sequence[str] = INDEX_COLUMNS) -> DataFrame:
    return features.join(labels, list(on), "left")


def merge_predictions(rows: DataFrame, alerts: DataFrame, on: Sequence[str] = INDEX_COLUMNS) -> DataFrame:
    """All rows with the alert columns; ``pred`` is 0 where there was no alert."""
    return rows.join(alerts, list(on), "left").withColumn("pred", F.coalesce("pred", F.lit(0)))


def merge_features(left: DataFrame, right: DataFrame, on: Sequence[str] = INDEX_COLUMNS) -> DataFrame:
    return left.join(right, list(on), "inner")


def enrich(df: DataFrame, *dimensions: tuple[DataFrame, str]) -> DataFrame:
    """Left join to each ``(table, key)`` in turn."""
    for dim, key in dimensions:
        df = df.join(dim, key, "left")
    return df


def union_all(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; a column a table lacks is NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def keys_only_in(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(*on).distinct().join(right.select(*on), list(on), "left_anti")


def keys_in_both(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.select(*on).intersect(right.select(*on))


def keys_except(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.select(*on).subtract(right.select(*on))
