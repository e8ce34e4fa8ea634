"""Labels from the fault log and membership in the set of failed disks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.schema import DISK_KEY, FAULT_HORIZON_DAYS

FAULT_KEY = ["manufacturer", "model", "serial_number"]


def first_listed_fault(faults: DataFrame, order: str = "list_order") -> DataFrame:
    """The fault listed first for each disk; later entries of the same disk do not count."""
    return faults.groupBy(*FAULT_KEY).agg(
        F.min_by("fault_time", order).alias("fault_time"), F.min_by("tag", order).alias("fault_tag")
    )


def label_before_failure(
    panel: DataFrame,
    faults: DataFrame,
    horizon: int = FAULT_HORIZON_DAYS,
    lower_inclusive: bool = True,
    order: str = "list_order",
) -> DataFrame:
    """Add ``tag``, ``flag`` and ``30_day``.

    With d the days to the first-listed failure of the disk: ``tag`` is the fault tag plus one for
    0 ≤ d ≤ ``horizon`` (0 < d if not ``lower_inclusive``), ``flag`` is 1 at d = 0 and ``30_day`` is
    1 at d = ``horizon``; all are 0 elsewhere. The fault log is one row per disk after its own
    aggregate; Spark broadcasts it when its run-time size allows and otherwise joins by key.
    """
    days = F.datediff("fault_time", "dt")
    lower = days >= 0 if lower_inclusive else days > 0
    in_reach = F.coalesce(lower & (days <= horizon), F.lit(False))

    def at(d: int):
        return F.coalesce((days == d).cast("tinyint"), F.lit(0).cast("tinyint"))

    return panel.join(first_listed_fault(faults, order), FAULT_KEY, "left").select(
        *[panel[c] for c in panel.columns],
        F.when(in_reach, F.col("fault_tag") + 1).otherwise(0).cast("tinyint").alias("tag"),
        at(0).alias("flag"),
        at(horizon).alias("30_day"),
    )


def binarize_label(df: DataFrame, label: str = "tag") -> DataFrame:
    return df.withColumn(label, F.when(F.col(label) != 0, 1).otherwise(0).cast("tinyint"))


def in_failed_disks(df: DataFrame, failed: DataFrame, strict_pair: bool = False) -> DataFrame:
    """Rows whose serial number and whose model both occur among ``failed``.

    The two are looked up apart, so a pair may match through two different disks; ``strict_pair``
    asks for the same disk. The model set is a handful of values, the serial set one row per disk.
    """
    if strict_pair:
        return df.join(failed.select(*DISK_KEY).distinct(), DISK_KEY, "left_semi")
    out = df
    for c in DISK_KEY:
        out = out.join(failed.select(c).distinct(), c, "left_semi")
    return out.select(*df.columns)


def failed_disk_history(df: DataFrame, strict_pair: bool = False) -> DataFrame:
    """Whole history of every disk that has a failure day (``flag`` = 1)."""
    return in_failed_disks(df, df.filter(F.col("flag") == 1), strict_pair)
