"""Down-sampling of the healthy rows, repeatable on any cluster.

Samples take the rows with the smallest seeded hash of their key, so a sample depends on the rows
and the seed alone. Faulty rows are never sampled away.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators import combine, label
from panelspark.operators.ordering import hash_key, smallest_per_stratum
from panelspark.schema import DISK_KEY, INDEX_COLUMNS


def _wanted(amount: float, rows: Column | str) -> Column:
    """``amount`` up to 1 is a share of ``rows``, above it a number of rows."""
    rows = F.col(rows) if isinstance(rows, str) else rows
    return F.floor(F.lit(float(amount)) * rows) if amount <= 1 else F.lit(int(amount)).cast("long")


def _quotas(normal: DataFrame, strata: Sequence[str], amount: float, proportional: bool) -> DataFrame:
    counts = normal.groupBy(*strata).agg(F.count(F.lit(1)).alias("__rows"))
    totals = counts.agg(F.struct(F.sum("__rows").alias("rows"), F.count(F.lit(1)).alias("strata"))).scalar()
    wanted = _wanted(amount, "__t.rows")
    share = F.col("__rows") / F.col("__t.rows") if proportional else F.lit(1.0) / F.col("__t.strata")
    return counts.withColumn("__t", totals).select(*strata, F.floor(wanted * share).alias("quota"))


def _stratified(normal: DataFrame, strata: Sequence[str], amount: float, seed: int, key: Sequence[str], proportional: bool = False) -> DataFrame:
    return smallest_per_stratum(normal, strata, _quotas(normal, strata, amount, proportional), key, seed)


def split_by_label(df: DataFrame, tag: str = "tag") -> tuple[DataFrame, DataFrame]:
    """Faulty rows and the others."""
    return df.filter(F.col(tag) == 1), df.filter(~F.col(tag).eqNullSafe(1))


def sample_by_month(normal: DataFrame, amount: float, seed: int = 42, key: Sequence[str] = INDEX_COLUMNS) -> DataFrame:
    """The same number of rows from every calendar month."""
    months = normal.withColumns({"__year": F.year("dt"), "__month": F.month("dt")})
    return _stratified(months, ["__year", "__month"], amount, seed, key).drop("__year", "__month")


def sample_by_bucket(normal: DataFrame, amount: float, bucket: str = "power_on_hours_in_day_unit_cate", seed: int = 42, key: Sequence[str] = INDEX_COLUMNS) -> DataFrame:
    """The same number of rows from every bucket; rows without a bucket are dropped.

    A share in ``amount`` refers to the rows that have a bucket.
    """
    return _stratified(normal.filter(F.col(bucket).isNotNull()), [bucket], amount, seed, key)


def sample_by_cluster(normal: DataFrame, amount: float, cluster: str = "cluster_label", seed: int = 42, key: Sequence[str] = INDEX_COLUMNS) -> DataFrame:
    """Rows from every cluster in proportion to its size."""
    return _stratified(normal.filter(F.col(cluster).isNotNull()), [cluster], amount, seed, key, proportional=True)


def sample_negatives(df: DataFrame, amount: float, seed: int = 42, key: Sequence[str] = INDEX_COLUMNS) -> DataFrame:
    """Healthy rows of a span; a share in ``amount`` refers to all its rows."""
    _, normal = split_by_label(df)
    quota = df.agg(_wanted(amount, F.count(F.lit(1))).alias("quota"))
    return smallest_per_stratum(normal, [], quota, key, seed)


def sampling_plan(
    df: DataFrame,
    train: tuple[str, str],
    amount: float,
    method: str | None = "month",
    valid: tuple[str, str] | None = None,
    valid_amount: float | None = None,
    gap: tuple[str, str] | None = None,
    prior_before: str | None = None,
    seed: int = 42,
    key: Sequence[str] = INDEX_COLUMNS,
    strict_pair: bool = False,
) -> DataFrame:
    """Training and validation rows drawn from a labelled feature table.

    All faulty rows of the training span stay and its healthy rows are down-sampled by ``method``
    (``month``, ``bucket``, ``cluster`` or None for none of them). ``valid`` adds the validation
    span, down-sampled by ``valid_amount``; ``gap`` adds the faulty rows of that span whose disk is
    confirmed to fail in it; ``prior_before`` starts the training data there and adds the faulty
    rows of earlier years.
    """
    def span(bounds: tuple[str, str]) -> DataFrame:
        return df.filter(F.col("dt").between(F.lit(bounds[0]).cast("date"), F.lit(bounds[1]).cast("date")))

    parts = []
    if valid:
        rows = span(valid)
        if valid_amount:
            parts += [split_by_label(rows)[0], sample_negatives(rows, valid_amount, seed, key)]
        else:
            parts.append(rows)
    base = span(train)
    if prior_before:
        start = F.lit(prior_before).cast("date")
        base = base.filter(F.col("dt") >= start)
        parts.append(split_by_label(df.filter(F.col("dt") < start))[0])
    faulty, normal = split_by_label(base)
    parts.append(faulty)
    if gap:
        parts.append(confirmed_faults(span(gap), strict_pair))
    if method == "month":
        parts.append(sample_by_month(normal, amount, seed, key))
    elif method == "bucket":
        parts.append(sample_by_bucket(normal, amount, seed=seed, key=key))
    elif method == "cluster":
        parts.append(sample_by_cluster(normal, amount, seed=seed, key=key))
    elif method is None:
        parts.append(normal)
    else:
        raise ValueError(f"unknown sampling method {method!r}")
    out = combine.union_all(*parts)
    return out.drop("cluster_label") if "cluster_label" in out.columns else out


def confirmed_faults(span: DataFrame, strict_pair: bool = False) -> DataFrame:
    """Faulty rows of the disks that have their failure day inside the span."""
    return label.in_failed_disks(span.filter(F.col("tag") == 1), span.filter(F.col("flag") == 1), strict_pair)


def unit_hash(columns: Sequence[str], seed: int) -> Column:
    """Uniform number in [0, 1) from the seeded hash of a key."""
    return F.conv(F.substring(hash_key(columns, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def sample_disks(df: DataFrame, rate: float, seed: int = 42, key: Sequence[str] = DISK_KEY) -> DataFrame:
    """All rows of a random share of the disks, and of every disk with a faulty row."""
    faulty = df.filter(F.col("tag") != 0).select(*key).distinct().withColumn("__faulty", F.lit(True))
    keep = F.col("__faulty").isNotNull() | (unit_hash(key, seed) < F.lit(rate))
    return df.join(faulty, list(key), "left").filter(keep).select(*df.columns)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42, key: Sequence[str] = INDEX_COLUMNS) -> DataFrame:
    """Each row by itself with probability ``fraction``."""
    return df.filter(unit_hash(key, seed) < F.lit(fraction))


def random_split(df: DataFrame, share: float = 0.8, seed: int = 42, key: Sequence[str] = INDEX_COLUMNS) -> DataFrame:
    """Add ``split``: ``train`` with probability ``share``, else ``test``. One pass for both sides."""
    return df.withColumn("split", F.when(unit_hash(key, seed) < F.lit(share), "train").otherwise("test"))
