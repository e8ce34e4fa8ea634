"""Merged sketches against exact answers over the rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import assoc, sketches
from panelspark.session import new_path


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 20_000
    day = rng.integers(1, 29, n)
    a = rng.normal(size=n) + day / 10
    data = [(f"2024-01-{int(d):02d}", float(v), None if i % 5 == 0 else float(i % 300), float("nan") if i % 2 else 7.0, int(d > 14)) for i, (d, v) in enumerate(zip(day, a, strict=True))]
    return spark.createDataFrame(data, "dt string, a double, b double, c double, late int").withColumn("dt", F.col("dt").cast("date")).withColumn("d", F.lit(None).cast("double"))


def test_any_span_without_the_rows(spark, rows):
    path = new_path(spark, "sketches")
    sketches.store_sketches(sketches.sketch_periods(rows, ["a", "b", "c", "d"], "yyyyMMdd"), path)
    sketches.store_sketches(sketches.sketch_periods(rows.filter("dt = '2024-01-07'"), ["a", "b", "c", "d"], "yyyyMMdd"), path)  # again: no change
    for first, last in ((20240101, 20240131), (20240107, 20240107), (20240110, 20240120)):
        part = sketches.read_sketches(spark, path, first, last)
        told = {r.column: r for r in sketches.profile_of(sketches.merge_sketches(part)).collect()}
        own = rows.filter(F.date_format("dt", "yyyyMMdd").cast("int").between(first, last)).toPandas()
        assert "PartitionFilters: [isnotnull(period" in part._jdf.queryExecution().executedPlan().toString()
        for c in ("a", "b", "c"):
            v, r = own[c].dropna(), told[c]
            assert (r.rows, r.n, r.min, r.max) == (len(own), len(v), v.min(), v.max())
            assert r.mean == pytest.approx(v.mean()) and r.std == pytest.approx(v.std(), abs=1e-6)
            assert abs(r.distinct - v.nunique()) <= max(1, 0.03 * v.nunique())
            for p, q in zip((0.25, 0.5, 0.75), (r.q0, r.q1, r.q2), strict=True):
                assert (v < q).mean() - 0.01 <= p <= (v <= q).mean() + 0.01
        assert (told["d"].n, told["d"].q1, told["d"].distinct) == (0, None, 0)


def test_drift_and_density(rows):
    halves = [sketches.merge_sketches(sketches.sketch_periods(rows.filter(F.col("late") == i), ["a", "b", "c", "d"])) for i in (0, 1)]
    exact = {r["column"]: r["statistic"] for r in assoc.ks_two_sample(rows.withColumnRenamed("late", "tag").withColumn("c", F.nanvl("c", F.lit(None))), "tag", ["a", "b"]).collect()}
    close = {r.column: r.statistic for r in sketches.drift_of(*halves).collect()}
    assert set(close) == {"a", "b", "c"} and all(abs(close[c] - exact[c]) < 0.015 for c in exact) and close["c"] == 0
    shares = sketches.density_of(*halves, bins=20).toPandas()
    own = rows.toPandas()
    edges = np.linspace(own.a.min(), own.a.max(), 21)
    for late, name in ((0, "first_share"), (1, "second_share")):
        v = own.a[own.late == late]
        want = np.array([((v > lo) & (v <= hi)).mean() for lo, hi in zip(np.r_[-np.inf, edges[1:-1]], edges[1:], strict=True)])
        got = shares[shares.column == "a"].set_index("bin")[name].reindex(range(20)).fillna(0).to_numpy()
        assert abs(got - want).max() < 0.015 and got.sum() == pytest.approx(1)
    assert shares[shares.column == "c"][["bin", "first_share", "second_share"]].to_numpy().tolist() == [[0, 1, 1]]


def test_groups_and_nothing(rows):
    by = sketches.profile_of(sketches.merge_sketches(sketches.sketch_periods(rows, ["a"], by=["late"]), ["late"]), ["late"])
    assert {r.late: r.rows for r in by.collect()} == {r.late: r["count"] for r in rows.groupBy("late").count().collect()}
    assert sketches.profile_of(sketches.merge_sketches(sketches.sketch_periods(rows.limit(0), ["a"]))).count() == 0
