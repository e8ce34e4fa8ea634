"""Order statistics over groups of any size.

A window that orders a whole group puts that group into one task. The functions here give the same
exact answers (positions, ranks, quantiles, the n smallest) without that: ties are collapsed by a
partial aggregate first, Spark range-partitions what is left, and only the totals of the ranges are
added up per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import materialize

_PREFIX_DIGITS = 3  # hash digits that one refinement of a stratum adds
_HASH_DIGITS = 32


def _placed(df: DataFrame, group: Sequence[str], order: str, sums: Sequence[str], ranges: int | None) -> DataFrame:
    """``df`` with ``<name>_before`` and the group's total ``<name>_total`` of each of ``sums``."""
    keys = list(group)
    by = [*keys, order]
    ranged = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    # Written with the range's number: the borders are sampled, and both uses below must see the same ones.
    ranged = materialize(ranged.withColumn("__range", F.spark_partition_id()), "ranges")
    zero = F.lit(0)
    whole = Window.partitionBy(*keys)  # at most one row per range for a group
    earlier = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*keys, "__range").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums]).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__range").alias("__k_range"),
        *[F.coalesce(F.sum(f"__t_{c}").over(earlier), zero).alias(f"__s_{c}") for c in sums],
        *[F.sum(f"__t_{c}").over(whole).alias(f"{c}_total") for c in sums],
    )
    inside = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), zero).alias(f"__l_{c}") for c in sums])
    same = F.col("__range") == F.col("__k_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return local.join(starts, same).select(
        *df.columns,
        *[(F.col(f"__l_{c}") + F.col(f"__s_{c}")).alias(f"{c}_before") for c in sums],
        *[f"{c}_total" for c in sums],
    )


def running_totals(
    df: DataFrame, group: Sequence[str], order: str, sums: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Add ``<name>_before``: the sum of ``name`` over the rows of the group with a smaller ``order``.

    ``df`` holds one row per ``(group, order)``, as after ``groupBy(*group, order)``. It is
    range-partitioned by both, into ``ranges`` ranges (by default the session's number of shuffle
    partitions, which grows with the input), and written once. Each range of a group is summed apart;
    the totals, one row per range and group, give each its start. NULL groups are groups.
    """
    return _placed(df, group, order, sums, ranges).drop(*[f"{c}_total" for c in sums])


def average_rank(df: DataFrame, group: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """Ascending rank per group with ties sharing their mean: ``(group, value, ties, rank)``."""
    ties = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("ties"))
    return running_totals(ties, group, value, ["ties"], ranges).select(
        *group, value, "ties", (F.col("ties_before") + (F.col("ties") + 1) / 2).alias("rank")
    )


def quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float], ranges: int | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles per group as columns ``q0, q1, …`` next to ``n``."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    placed = _placed(counted, group, value, ["__c"], ranges).withColumnRenamed("__c_total", "n")
    first, last = F.col("__c_before"), F.col("__c_before") + F.col("__c") - 1
    picks, outs = [], []
    for i, p in enumerate(probs):
        spot = F.lit(float(p)) * (F.col("n") - 1)
        picks.append(F.max(F.when(F.floor(spot).between(first, last), F.col(value))).alias(f"__lo{i}"))
        picks.append(F.max(F.when(F.ceil(spot).between(first, last), F.col(value))).alias(f"__hi{i}"))
        share = spot - F.floor(spot)
        outs.append((F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * share).alias(f"q{i}"))
    return placed.groupBy(*group, "n").agg(*picks).select(*group, "n", *outs)


def hash_key(columns: Sequence[str], seed: int) -> Column:
    """Uniform 128-bit text hash of a row key, the same in every SQL engine with ``md5``."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def smallest_per_stratum(
    df: DataFrame,
    strata: Sequence[str],
    quotas: DataFrame,
    key: Sequence[str],
    seed: int,
    bucket_rows: int = 10_000,
) -> DataFrame:
    """The ``quota`` rows of each stratum with the smallest seeded hash of their key: a sample
    without replacement that any run repeats.

    ``quotas`` holds ``(strata, quota)``, one row per stratum to draw from. The hash of the last
    row to keep is found first: counts per hash prefix tell the prefix it lies in. That prefix is made
    longer, level by level, until it holds at most ``bucket_rows`` rows; only these are ordered. The wide rows are then filtered by comparing hashes; they are never
    shuffled to one task per stratum. ``key`` must identify a row.
    """
    keys = list(strata)
    if not keys:
        df, quotas, keys = df.withColumn("__one", F.lit(0)), quotas.withColumn("__one", F.lit(0)), ["__one"]
    hashed = df.withColumn("__h", hash_key(key, seed))
    narrow = materialize(hashed.select(*keys, *[F.col(c).alias(f"__k_{c}") for c in key], "__h"), "hashes")
    sizes = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("__held"))
    cut = quotas.select(*keys, "quota").join(sizes, keys).filter((F.col("quota") > 0) & (F.col("quota") < F.col("__held")))
    cut = materialize(cut.select(*keys, F.lit("").alias("__p"), F.col("quota").alias("__need"), "__held"), "cut")
    by_prefix = Window.partitionBy(*keys).orderBy("__next").rowsBetween(Window.unboundedPreceding, 0)
    for digits in range(_PREFIX_DIGITS, _HASH_DIGITS, _PREFIX_DIGITS):
        if cut.filter(F.col("__held") > bucket_rows).isEmpty():
            break
        counted = (
            narrow.join(cut.drop("__held"), keys)
            .filter(F.col("__h").startswith(F.col("__p")))
            .groupBy(*keys, "__need", F.substring("__h", 1, digits).alias("__next"))
            .agg(F.count(F.lit(1)).alias("__held"))  # at most 16 ** _PREFIX_DIGITS rows per stratum
            .withColumn("__earlier", F.sum("__held").over(by_prefix) - F.col("__held"))
        )
        need = F.col("__need") - F.col("__earlier")
        deciding = counted.filter((need > 0) & (need <= F.col("__held")))
        cut = materialize(deciding.select(*keys, F.col("__next").alias("__p"), need.alias("__need"), "__held"), "cut")
    order = [F.col("__h"), *[F.col(f"__k_{c}") for c in key]]
    last_kept = (
        narrow.join(cut, keys)
        .filter(F.col("__h").startswith(F.col("__p")))
        .withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .filter(F.col("__rn") == F.col("__need"))
        .select(*keys, F.struct("__h", *[F.col(f"__k_{c}").alias(c) for c in key]).alias("__last"))
    )
    # One row per stratum, written: its size is then known, and Spark broadcasts it only if small.
    rule = materialize(quotas.select(*keys, "quota").join(last_kept, keys, "left"), "quota")
    inside = F.col("__last").isNull() | (F.struct("__h", *key) <= F.col("__last"))
    kept = hashed.join(rule, keys).filter((F.col("quota") > 0) & inside)
    return kept.select(*[c for c in df.columns if c != "__one"])
