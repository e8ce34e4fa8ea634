"""From a raw panel to the feature table: clean, fit column choices, categories, rolling features."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark import schema as S
from panelspark.functions import scalar
from panelspark.operators import calendar, clean, combine, label, rolling
from panelspark.session import materialize


@dataclass(frozen=True)
class FittedFeatures:
    """What the training data decided: kept sensors and power-on-day bin edges.

    ``complete`` names sensors without a NULL in the table fitted on; it says nothing about others.
    """

    sensors: list[str]
    day_edges: list[float]
    complete: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "FittedFeatures":
        return FittedFeatures(**json.loads(text))


def clean_panel(
    panel: DataFrame,
    model: int | None = None,
    start: str | None = None,
    end: str | None = None,
    prior_faults: DataFrame | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Model and date filters, extra faulty rows of earlier years, one row per disk and day, powered-on
    rows only. The filters reach the scan."""
    df = clean.in_date_range(clean.of_model(panel, model), start, end)
    if prior_faults is not None:
        df = combine.union_all(df, prior_faults)
    df = clean.dedupe_disk_day(df, S.INDEX_COLUMNS, order)
    return clean.powered_on(df)


def fit_features(
    cleaned: DataFrame,
    sensors: Sequence[str],
    distinct_limit: int = S.DISTINCT_LIMIT,
    null_limit: float = S.NULL_PERCENT_LIMIT,
) -> FittedFeatures:
    """Drop sensors with too few values or too many NULLs, and cut the power-on days into equal bins.

    With the default limit one aggregate over the table answers all of it.
    """
    days = scalar.power_on_days(S.POWER_ON_HOURS)
    row = cleaned.agg(
        F.count(F.lit(1)).alias("rows"),
        F.struct(F.min(days), F.max(days)).alias("days"),
        *[F.struct(F.count(c), F.min(c), F.max(c)).alias(c) for c in sensors],
    ).first()
    if distinct_limit == 1:
        few = {c for c in sensors if row[c][0] == 0 or (row[c][0] == row["rows"] and row[c][1] == row[c][2])}
    else:
        few = set(clean.fit_distinct_prune(cleaned, sensors, distinct_limit))
    empty = {c for c in sensors if round((1 - row[c][0] / max(row["rows"], 1)) * 100, 2) >= null_limit}
    edges = scalar.equal_width_edges(row["days"][0], row["days"][1], S.POWER_ON_DAY_BINS)
    complete = [c for c in sensors if row[c][0] == row["rows"]]
    return FittedFeatures([c for c in sensors if c not in few | empty], edges, complete)


def add_categories(df: DataFrame, day_edges: Sequence[float]) -> DataFrame:
    """Disk model, zero/non-zero flags of the mostly-zero sensors, and the power-on-day bin."""
    flags = {f"{c}_cate": scalar.gt_zero_flag(c) for c in S.ZERO_HEAVY_SENSORS if c in df.columns}
    days = scalar.power_on_days(S.POWER_ON_HOURS)
    return df.withColumns(
        {
            "model_type": scalar.map_values("model", {1: 0, 2: 1}),
            **flags,
            "power_on_hours_in_day_unit_cate": scalar.right_closed_cut(days, day_edges),
        }
    )


def add_combined(df: DataFrame, missing: str = "error") -> DataFrame:
    """The three weighted sums; the mostly-zero sensors are dropped afterwards."""
    sums = {name: scalar.weighted_sum(w, df.columns, missing) for name, w in S.COMBINED_SENSORS.items()}
    return df.withColumns(sums).drop(*S.ZERO_HEAVY_SENSORS)


def daily_features(
    df: DataFrame,
    continuous: Sequence[str],
    categories: Sequence[str],
    labels: Sequence[str],
    window: int = 7,
    complete: Sequence[str] = (),
) -> DataFrame:
    """Calendar fill, rolling minimum, maximum, deviation, difference and slope, and forward fill.

    All windows partition by disk: the first one brings the rows together and the others stay there.
    Slopes stand on real readings only, so they are found before the calendar is filled, while rows
    are few and narrow; a filled day then repeats the slope before it, as the forward fill would.
    Labels ride along instead of being joined back.

    A column known to be ``complete`` has no gaps behind its first rows in any of its features, so the
    forward fill leaves them out.
    """
    sliding = [c for c in continuous if c not in S.NON_SLIDING_SENSORS]
    slopes = [c for c in S.SLOPE_SENSORS if c in sliding]
    read = df.select(*S.INDEX_COLUMNS, *labels, *categories, *continuous)
    dense = calendar.fill_calendar(rolling.add_rolling_slope(read, slopes, S.POWER_ON_HOURS, window))
    made = rolling.rolling_stats(sliding, window) + rolling.period_diff(sliding, window)
    wide = dense.select("*", *made)
    fixed = {*S.INDEX_COLUMNS, *labels, *categories, "observed"}
    numbers = [c for c in wide.columns if c not in fixed]
    whole = {n for n in complete if n in numbers}
    whole |= {f"{c}_{kind}_{window}" for c in complete for kind in ("min", "max", "std", "diff_for_last_period")}
    gappy = [c for c in numbers if c not in whole]
    filled = calendar.observed_days(rolling.forward_fill(wide, gappy) if gappy else wide)
    return filled.select(*S.INDEX_COLUMNS, *categories, *numbers, *labels)


def build_features(
    cleaned: DataFrame,
    fitted: FittedFeatures,
    labels: Sequence[str] = (),
    window: int = 7,
    missing: str = "error",
    same_table: bool = False,
) -> DataFrame:
    """Feature table of a cleaned panel with the columns and bins of ``fitted``.

    ``same_table`` tells that ``fitted`` comes from this very panel, so what it knows about missing
    values holds.
    """
    df = cleaned.select(*S.INDEX_COLUMNS, *labels, *[F.col(c).cast("double").alias(c) for c in fitted.sensors])
    df = add_combined(add_categories(df, fitted.day_edges), missing)
    roles = S.column_roles(df)
    complete = set(fitted.complete) & set(fitted.sensors) if same_table else set()
    sums = [n for n, w in S.COMBINED_SENSORS.items() if complete and set(w) & set(fitted.sensors) <= complete]
    whole = [c for c in roles.continuous if c in complete or c in sums]
    return daily_features(df, roles.continuous, roles.category, [c for c in labels if c in roles.label], window, whole)


def training_features(
    labelled: DataFrame,
    sensors: Sequence[str] = tuple(S.SENSORS),
    window: int = 7,
    missing: str = "error",
    stage: bool = True,
    prune_features: bool = False,
    **cleaning,
) -> tuple[DataFrame, FittedFeatures]:
    """Cleaned, fitted and featurized training table, and what was fitted.

    The cleaned panel feeds the fit and the features; ``stage`` writes it once in between.
    ``prune_features`` also drops finished features with too many NULLs, which needs them written.
    """
    wanted = labelled.select(*S.INDEX_COLUMNS, "tag", "flag", *sensors)
    cleaned = label.binarize_label(clean_panel(wanted, **cleaning))
    if stage:
        cleaned = materialize(cleaned, "cleaned")
    fitted = fit_features(cleaned, sensors)
    out = build_features(cleaned, fitted, ["tag", "flag"], window, missing, same_table=True)
    if prune_features:
        out = materialize(out, "features")
        out = out.drop(*clean.fit_null_prune(out))
    return out, fitted


def prediction_features(
    panel: DataFrame,
    fitted: FittedFeatures,
    start: str,
    end: str,
    window: int = 7,
    missing: str = "error",
    fixed_bins: bool = True,
    **cleaning,
) -> DataFrame:
    """Features of the days from ``start`` to ``end``; earlier rows only feed the windows.

    ``fixed_bins`` uses the constant power-on-day edges, otherwise the fitted ones.
    """
    if fixed_bins:
        fitted = FittedFeatures(fitted.sensors, list(S.POWER_ON_DAY_EDGES))
    cleaned = clean_panel(panel.select(*S.INDEX_COLUMNS, *fitted.sensors), **cleaning)
    return clean.in_date_range(build_features(cleaned, fitted, (), window, missing), start, end)

