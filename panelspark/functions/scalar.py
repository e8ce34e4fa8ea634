"""Column expressions. All run inside the JVM; none needs Python at run time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- dates -----------------------------------------------------------------------------------


def parse_yyyymmdd(c: Column | str) -> Column:
    """``20180331`` (number or text) to a date; NULL where it does not parse."""
    return F.try_to_timestamp(_col(c).cast("string"), F.lit("yyyyMMdd")).cast("date")


def day_diff(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_col(later), _col(earlier))


def year_month_weekday(c: Column | str) -> list[Column]:
    """Year, month and weekday (Monday = 0) as three named columns."""
    return [
        F.year(_col(c)).alias("year"),
        F.month(_col(c)).alias("month"),
        F.weekday(_col(c)).alias("weekday"),
    ]


def month_gap(c: Column | str, year: int, month: int) -> Column:
    """Whole months from the month of ``c`` to ``year``-``month``."""
    return (F.lit(year) - F.year(_col(c))) * 12 + (F.lit(month) - F.month(_col(c)))


def compact_date(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyyMMdd")


def date_range(start: Column | str, end: Column | str) -> Column:
    """Every day from ``start`` to ``end`` as an array."""
    return F.sequence(F.to_date(_col(start)), F.to_date(_col(end)))


# --- text and maps ---------------------------------------------------------------------------


def name_part(c: Column | str, sep: str, position: int) -> Column:
    """Part ``position`` (from 0) of a ``sep``-separated text."""
    return F.split_part(_col(c), F.lit(sep), F.lit(position + 1))


def map_values(c: Column | str, mapping: Mapping) -> Column:
    """Look up a small fixed mapping; values outside it become NULL."""
    out = F.lit(None)
    for key, value in mapping.items():
        out = F.when(_col(c) == F.lit(key), F.lit(value)).otherwise(out)
    return out


# --- numbers ---------------------------------------------------------------------------------


def log2p1(c: Column | str) -> Column:
    return F.log2(_col(c) + 1)


def safe_log(c: Column | str) -> Column:
    """Natural logarithm with 0 at 0."""
    return F.when(_col(c) == 0, F.lit(0.0)).otherwise(F.ln(_col(c)))


def power_on_days(hours: Column | str) -> Column:
    return F.floor(_col(hours) / 24).cast("double")


def gt_zero_flag(c: Column | str) -> Column:
    return F.coalesce((_col(c) > 0).cast("int"), F.lit(0))


def round_half_even(c: Column | str, digits: int) -> Column:
    return F.bround(_col(c), digits)


def right_closed_cut(c: Column | str, edges: Sequence[float]) -> Column:
    """Number of the interval ``(e0, e1], (e1, e2], …`` a value falls in; NULL outside."""
    value = _col(c)
    code = sum((F.when(value > F.lit(float(e)), 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return F.when((value > F.lit(float(edges[0]))) & (value <= F.lit(float(edges[-1]))), code)


def equal_width_edges(low: float, high: float, bins: int) -> list[float]:
    """``bins`` equal parts of [low, high], the first edge lowered by 0.1 % of the range so that the
    minimum itself falls in the first right-closed interval."""
    if low == high:
        pad = 0.001 * abs(low) if low else 0.001
        step = 2 * pad / bins
        return [low - pad + i * step for i in range(bins)] + [high + pad]
    step = (high - low) / bins
    edges = [low + i * step for i in range(bins)] + [high]
    edges[0] -= (high - low) * 0.001
    return edges


def weighted_sum(weights: Mapping[str, float], available: Sequence[str], missing: str = "error") -> Column:
    """Weighted mean of several columns; NULL if one of them is NULL.

    A weighted column that pruning has removed raises ``KeyError``, or with ``missing="skip"`` the
    weights of the others are scaled up to one.
    """
    absent = [c for c in weights if c not in available]
    if absent and missing != "skip":
        raise KeyError(f"columns needed by the weighted sum are absent: {absent}")
    used = {c: w for c, w in weights.items() if c not in absent}
    total = sum(used.values())
    return sum((F.col(c) * F.lit(w / total) for c, w in used.items()), F.lit(0.0))


def focal_loss(score: Column | str, target: Column | str, alpha: float, gamma: float) -> Column:
    """Focal loss of a raw score: cross-entropy scaled down where the prediction is already good."""
    t = _col(target)
    p = 1 / (1 + F.exp(-_col(score)))
    p_of_class = t * p + (1 - t) * (1 - p)
    weight = alpha * t + (1 - alpha) * (1 - t)
    return -weight * F.pow(1 - p_of_class, F.lit(gamma)) * F.ln(p_of_class)


def focal_weight(prob: Column | str, target: Column | str, alpha: float, gamma: float) -> Column:
    """Row weight of the focal loss, for trainers that take weights but no custom loss."""
    t, p = _col(target), _col(prob)
    p_of_class = t * p + (1 - t) * (1 - p)
    return (alpha * t + (1 - alpha) * (1 - t)) * F.pow(1 - p_of_class, F.lit(gamma))


def one_hot(c: Column | str, categories: Sequence, prefix: str) -> list[Column]:
    """One 0/1 column per category of a fitted vocabulary; unseen values give zeros."""
    return [
        F.coalesce((_col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in categories
    ]
