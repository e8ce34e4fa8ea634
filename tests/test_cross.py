"""The window formulation against a per-disk pandas restatement, and properties of the results."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark import registry
from panelspark import schema as S
from panelspark.operators import assoc, calendar
from panelspark.plans import features as plan
from panelspark.registry import features as feature_queries

registry.load_all()

COLS = ["smart_1_normalized", "smart_5raw", "smart_195_normalized", "smart_9raw", "smart_9_normalized", "smart_187_normalized"]


def make_per_disk(columns):
    """A function made inside another one travels to the workers by value."""
    fixed = list(S.NON_SLIDING_SENSORS)

    def per_disk(pdf: pd.DataFrame) -> pd.DataFrame:
        """One disk with pandas rolling functions over its filled calendar."""
        pdf = pdf.sort_values("dt")
        seen = pd.DatetimeIndex(pd.to_datetime(pdf["dt"]))
        dense = pdf.set_index(seen)[columns].astype(float).reindex(pd.date_range(seen[0], seen[-1]), method="pad")
        sliding = [c for c in columns if c not in fixed]
        roll = dense[sliding].rolling(7, min_periods=1)
        parts = [roll.min().add_suffix("_min_7"), roll.max().add_suffix("_max_7"), roll.std().add_suffix("_std_7")]
        parts.append(dense[sliding].diff(7).add_suffix("_diff_for_last_period_7"))
        pairs = dense[["smart_5raw", "smart_9raw"]].dropna().drop_duplicates()
        slope = {}
        for i in range(6, len(pairs)):
            block = pairs.iloc[i - 6 : i + 1]
            hours = block["smart_9raw"].to_numpy() // 24
            if np.ptp(hours):
                slope[pairs.index[i]] = np.polyfit(hours, block["smart_5raw"].to_numpy(), 1)[0]
        parts.append(pd.Series(slope, dtype=float).reindex(dense.index).rename("smart_5raw_slope_for_last_duration_7").to_frame())
        out = pd.concat([dense, *parts], axis=1).ffill().loc[seen]
        out.insert(0, "dt", [d.date() for d in out.index])
        out.insert(0, "serial_number", pdf["serial_number"].iloc[0])
        out.insert(0, "model", pdf["model"].iloc[0])
        return out.reset_index(drop=True)

    return per_disk


def test_features_match_pandas_per_disk(spark, sf):
    df = registry.powered(spark, sf).select(*S.INDEX_COLUMNS, *COLS)
    got = plan.daily_features(df, COLS, [], []).toPandas()
    names = list(got.columns)
    per_disk = make_per_disk(COLS)
    types = {"model": "int", "serial_number": "string", "dt": "date"}
    schema = ", ".join(f"{c} {types.get(c, 'double')}" for c in names)
    want = df.groupBy("model", "serial_number").applyInPandas(lambda g: per_disk(g)[names], schema).toPandas()
    key = ["model", "serial_number", "dt"]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    assert (a[key].astype(str) == b[key].astype(str)).all().all()
    for c in names:
        if c not in key:
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=1e-7, equal_nan=True, err_msg=c)


def test_fill_then_observed_gives_the_input_back(spark, sf):
    df = registry.powered(spark, sf).select(*S.INDEX_COLUMNS, *COLS)
    back = calendar.observed_days(calendar.fill_calendar(df)).select(*df.columns)
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_rolling_bounds_hold(spark, sf):
    out = registry.QUERIES["feature_table"](spark, sf)
    broken = [
        F.count_if((F.col(f"{c}_min_7") > F.col(c)) | (F.col(f"{c}_max_7") < F.col(c)) | (F.col(f"{c}_std_7") < 0)).alias(c)
        for c in feature_queries.CONTINUOUS
        if c not in S.NON_SLIDING_SENSORS
    ]
    assert not any(out.agg(*broken).first())


@pytest.mark.parametrize("theil", [False, True])
def test_associations_stay_in_range(spark, sf, theil):
    df = registry.table(spark, sf, "lineitem").select("l_quantity", "l_tax", "l_returnflag", "l_linestatus")
    for r in assoc.associations(df, theil_u=theil).collect():
        low = -1.0 if r["measure"] == "pearson" else 0.0
        assert low - 1e-9 <= r["value"] <= 1 + 1e-9


def test_skipping_complete_columns_changes_nothing(spark, sf):
    df = registry.powered(spark, sf).select(*S.INDEX_COLUMNS, *COLS)
    complete = [c for c in COLS if c != "smart_195_normalized"]
    a = plan.daily_features(df, COLS, [], [])
    b = plan.daily_features(df, COLS, [], [], complete=complete)
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in complete]).first() == tuple([0] * len(complete))
