"""Exact rules on small hand-made frames."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark import schema as S
from panelspark.functions import scalar
from panelspark.operators import assoc, calendar, clean, encode, label, metrics, profile, rank, rolling, sampling, split, trees
from panelspark.plans import features as plan

DISK = "model int, serial_number string, dt date"


def days(spark, values, columns="x double", start=date(2024, 1, 1)):
    rows = [(1, "a", start + timedelta(days=d), *v) for d, v in values]
    return spark.createDataFrame(rows, f"{DISK}, {columns}")


def col(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy("dt").collect()]


def test_label_boundaries(spark):
    dts = [date(2018, 4, 1), date(2018, 3, 31), date(2018, 3, 1), date(2018, 2, 28)]
    panel = spark.createDataFrame([("A", 1, "d", d) for d in dts], "manufacturer string, model int, serial_number string, dt date")
    faults = spark.createDataFrame(
        [("A", 1, "d", date(2018, 3, 31), 2, 1), ("A", 1, "d", date(2018, 3, 10), 5, 2)],
        "manufacturer string, model int, serial_number string, fault_time date, tag int, list_order int",
    )
    out = {r["dt"]: (r["tag"], r["flag"], r["30_day"]) for r in label.label_before_failure(panel, faults).collect()}
    assert [out[d] for d in dts] == [(0, 0, 0), (3, 1, 0), (3, 0, 1), (0, 0, 0)]
    excl = {r["dt"]: r["tag"] for r in label.label_before_failure(panel, faults, lower_inclusive=False).collect()}
    assert [excl[d] for d in dts] == [0, 0, 3, 0]


def test_gap_fill_keeps_null_until_forward_fill(spark):
    df = days(spark, [(0, (1.0,)), (2, (None,)), (4, (2.0,))])
    dense = calendar.fill_calendar(df)
    assert col(dense, "x") == [1.0, 1.0, None, None, 2.0]
    assert col(rolling.forward_fill(dense, ["x"]), "x") == [1.0, 1.0, 1.0, 1.0, 2.0]
    assert col(calendar.observed_days(dense), "x") == [1.0, None, 2.0]


def test_gap_fill_with_bounds_and_zero_columns(spark):
    df = days(spark, [(0, (1.0, 7)), (2, (3.0, 8))], "x double, c int")
    out = calendar.fill_calendar(df, zero_columns=["c"], start="2023-12-31", end="2024-01-05")
    assert col(out, "x", "c") == [(None, 0), (1.0, 7), (1.0, 0), (3.0, 8), (3.0, 0), (3.0, 0)]
    late = calendar.fill_calendar(df, start="2024-01-02")
    assert col(late, "x") == [1.0, 3.0]


def test_rolling_std_and_diff(spark):
    df = days(spark, [(i, (float(i),)) for i in range(8)])
    out = df.select("*", *rolling.rolling_stats(["x"], 7), *rolling.period_diff(["x"], 7))
    assert col(out, "x_diff_for_last_period_7") == [None] * 7 + [7.0]
    assert col(out, "x_min_7")[-1] == 1.0 and col(out, "x_max_7")[-1] == 7.0
    two = days(spark, [(0, (1.0,)), (1, (3.0,))]).select("*", *rolling.rolling_stats(["x"], 7, ["std"]))
    assert col(two, "x_std_7")[0] is None and col(two, "x_std_7")[1] == pytest.approx(1.414214, abs=1e-6)


def test_slope_needs_seven_distinct_readings(spark):
    def slopes(n, hours):
        df = days(spark, [(i, (2.0 * i, hours(i))) for i in range(n)], "x double, h double")
        return col(rolling.add_rolling_slope(df, ["x"], "h", 7), "x_slope_for_last_duration_7")

    assert slopes(6, lambda i: 24.0 * i) == [None] * 6
    assert slopes(7, lambda i: 24.0 * i)[-1] == pytest.approx(2.0)
    assert slopes(7, lambda i: 1.0 + i * 0.1) == [None] * 7
    # A repeated pair does not count, and the slope stands on the distinct rows.
    df = days(spark, [(0, (0.0, 0.0)), (1, (0.0, 0.0)), *[(i + 1, (2.0 * i, 24.0 * i)) for i in range(1, 7)]], "x double, h double")
    out = col(rolling.add_rolling_slope(df, ["x"], "h", 7), "x_slope_for_last_duration_7")
    assert out[:-1] == [None] * 7 and out[-1] == pytest.approx(2.0)


def test_skew_and_kurtosis(spark):
    values = [1.0, 4.0, 9.0, 16.0, 30.0, 31.0]
    df = days(spark, [(i, (0.0,)) for i in range(7)] + [(7 + i, (v,)) for i, v in enumerate(values)])
    last = rolling.shape_features(df, ["x"], 7).orderBy(F.desc("dt")).first()
    assert last["x_skew_7"] == pytest.approx(0.384277, abs=1e-6)
    assert last["x_kurt_7"] == pytest.approx(-2.018204, abs=1e-6)
    early = rolling.shape_features(df, ["x"], 7).orderBy("dt").limit(9).collect()
    assert all(r["x_skew_7"] is None for r in early)


def test_shapes_of_many_disks_at_once(spark):
    """The window numbers the rows, no aggregate runs per row and column; frames go on from batch to batch and end with
    the disk; unknown values do not count, equal ones have no spread, NaN stays NaN."""
    rng = random.Random(8)
    disks = {s: [None if rng.random() < 0.2 else round(rng.gauss(5, 3), 3) for _ in range(rng.choice([3, 9, 40]))] for s in range(12)}
    disks[12], disks[13] = [123456789.1] * 20, [1.0, 2.0, 4.0] * 4 + [float("nan")] + [3.0, 5.0] * 6
    rows = [(s % 2, f"d{s}", date(2024, 1, 1) + timedelta(days=i), v, i % 4) for s, values in disks.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"{DISK}, x double, y int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        out = rolling.shape_features(df, ["x", "y"], 7)
        plan_text = out._jdf.queryExecution().executedPlan().toString()
        got = {(r["serial_number"], r["dt"]): r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "kurtosis" not in plan_text and "row_number" in plan_text and plan_text.count("Sort [") == 1
    assert out.columns == [*df.columns, "x_skew_7", "x_kurt_7", "x_cv_7", "y_skew_7", "y_kurt_7", "y_cv_7"] and len(got) == len(rows)
    for s, values in disks.items():
        for c, own in (("x", values), ("y", [i % 4 for i in range(len(values))])):
            for i in range(len(own)):
                r = got[f"d{s}", date(2024, 1, 1) + timedelta(days=i)]
                known = [own[j] for j in range(max(7, i - 6), i + 1) if own[j] is not None]
                if any(v != v for v in known):
                    assert all(len(known) < least or math.isnan(r[f"x_{k}_7"]) for k, least in (("skew", 3), ("kurt", 4), ("cv", 2)))
                    continue
                frame, flat = pd.Series(known, dtype=float), len(set(known)) < 2
                wanted = {"skew": (3, frame.skew(), flat), "kurt": (4, frame.kurt(), flat), "cv": (2, frame.std() / (frame.mean() or 1), frame.mean() == 0)}
                for k, (least, want, none) in wanted.items():
                    found = r[f"{c}_{k}_7"]
                    assert found is None if len(known) < least or none else found == pytest.approx(want, abs=1e-9)


def test_average_rank(spark):
    df = spark.createDataFrame([(1, s, date(2024, 1, 1), p) for s, p in zip("abcd", [0.1, 0.2, 0.2, 0.5])], f"{DISK}, prob double")
    ranks = {r["serial_number"]: r["rank"] for r in rank.daily_average_rank(df).collect()}
    assert ranks == {"a": 1.0, "b": 2.5, "c": 2.5, "d": 4.0}


def test_cuts(spark):
    edges = scalar.equal_width_edges(0.0, 1811.0, 4)
    assert edges == pytest.approx([-1.811, 452.75, 905.5, 1358.25, 1811.0])
    df = spark.createDataFrame([(v,) for v in (0.0, 452.75, 453.0, 905.5, 1811.0)], "v double")
    assert [r[0] for r in df.select(scalar.right_closed_cut("v", edges)).collect()] == [0, 0, 1, 1, 3]
    fixed = spark.createDataFrame([(v,) for v in (-9999.0, 452.75, 9999.0, 10000.0, None)], "v double")
    assert [r[0] for r in fixed.select(scalar.right_closed_cut("v", S.POWER_ON_DAY_EDGES)).collect()] == [None, 0, 3, None, None]
    assert scalar.equal_width_edges(5.0, 5.0, 2) == pytest.approx([4.995, 5.0, 5.005])


def test_first_alert_uses_a_slot(spark):
    rows = [(1, s, date(2024, 1, d), p) for d in (1, 2) for s, p in (("A", 0.9), ("B", 0.8))]
    df = spark.createDataFrame(rows, f"{DISK}, prob double")
    alerts = rank.daily_alerts(df, quantile=0.0, per_day=1)
    out = [(r["serial_number"], r["dt"]) for r in rank.submission(alerts).collect()]
    assert out == [("A", date(2024, 1, 1))]


def test_power_filter_keeps_null(spark):
    df = spark.createDataFrame([(0.0,), (None,), (5.0,)], "smart_9raw double")
    assert sorted((r[0] is None, r[0] or 0) for r in clean.powered_on(df).collect()) == [(False, 5.0), (True, 0)]


def test_distinct_counts_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (None, 2.0, None), (1.0, 2.0, None)], "x double, y double, z double")
    counts = {r["column"]: r["distinct_values"] for r in clean.distinct_counts(df, ["x", "y", "z"]).collect()}
    assert counts == {"x": 2, "y": 1, "z": 1}
    assert clean.fit_distinct_prune(df, ["x", "y", "z"]) == ["y", "z"]
    assert clean.fit_distinct_prune(df, ["x", "y", "z"], 3) == ["x", "y", "z"]


def test_prunes(spark):
    df = spark.createDataFrame([(1.0, None, 1.0), (2.0, 1.0, 1.1), (3.0, 1.0, 1.0), (9.0, 1.0, 1.0)], "x double, y double, z double")
    assert clean.fit_null_prune(df, 25) == ["y"] and clean.fit_null_prune(df, 25.1) == []
    assert clean.fit_std_prune(df, ["x", "z"]) == ["z"]


def test_membership(spark):
    cols = f"{DISK}, flag int, tag int"
    d = date(2024, 1, 1)
    df = spark.createDataFrame([(1, "a", d, 1, 1), (2, "b", d, 1, 1), (1, "b", d, 0, 0), (1, "c", d, 0, 0)], cols)
    loose = {(r["model"], r["serial_number"]) for r in label.failed_disk_history(df).collect()}
    strict = {(r["model"], r["serial_number"]) for r in label.failed_disk_history(df, strict_pair=True).collect()}
    assert loose == {(1, "a"), (2, "b"), (1, "b")} and strict == {(1, "a"), (2, "b")}


def test_alert_f1(spark):
    d = date(2024, 1, 1)
    rows = [(1, "a", d, 1, 0, 1), (1, "b", d, 1, 0, 1), (1, "x", d, 0, 0, 1), (1, "y", d, 0, 0, 1)]
    rows += [(1, s, d, 1, 1, 0) for s in "abcde"]
    df = spark.createDataFrame(rows, f"{DISK}, tag int, flag int, pred int")
    out = metrics.alert_f1(df).first()
    assert tuple(out) == pytest.approx((0.5, 0.4, 0.444444), abs=1e-6)
    assert tuple(metrics.alert_f1(df.withColumn("pred", F.lit(0))).first()) == (0.0, 0.0, 0.0)
    assert tuple(metrics.alert_f1(df.withColumn("flag", F.lit(0))).first()) == (0.0, 0.0, 0.0)


def test_yates_two_by_two(spark):
    df = spark.createDataFrame([(0, 0)] * 10 + [(1, 1)] * 10, "a int, b int")
    out = assoc.cramers_v(df, [("a", "b")]).first()
    assert out["chi2"] == pytest.approx(16.2)


def test_entropy_extremes(spark):
    df = spark.createDataFrame([(i % 2, i % 2, 7) for i in range(10)], "a int, b int, c int")
    out = {(r["col_a"], r["col_b"]): r["theils_u"] for r in assoc.entropies(df, [("a", "b"), ("a", "c"), ("c", "a")]).collect()}
    assert out[("a", "b")] == pytest.approx(1.0) and out[("a", "c")] == pytest.approx(0.0) and out[("c", "a")] == 1.0


def test_associations_marks_and_matrix(spark):
    df = spark.createDataFrame([("p" if i % 3 else "q", float(i), float(-i)) for i in range(12)], "k string, x double, y double")
    long = assoc.associations(df, mark_columns=True)
    assert {r["col_a"] for r in long.collect()} == {"k (nom)", "x (con)", "y (con)"}
    plain = assoc.associations(df)
    assert plain.count() == 9
    m = {r["col_a"]: r.asDict() for r in assoc.as_matrix(plain, df.columns).collect()}
    assert m["x"]["y"] == pytest.approx(-1.0) and m["k"]["k"] == 1.0 and m["k"]["x"] == m["x"]["k"]


def test_correlation_ratio_without_spread(spark):
    df = spark.createDataFrame([(0, 5.0, 1.0), (1, 5.0, 2.0)], "k int, x double, y double")
    out = {r["column"]: r["eta"] for r in assoc.correlation_ratio(df, "k", ["x", "y"]).collect()}
    assert out == {"x": 0.0, "y": 1.0}


def test_ks_p_value(spark):
    # Two samples of 50 shifted by half their range: D = 0.5, z = 2.5.
    rows = [(1, float(i)) for i in range(50)] + [(0, float(i + 25)) for i in range(50)]
    out = assoc.ks_two_sample(spark.createDataFrame(rows, "tag int, x double"), "tag", ["x"]).first()
    assert out["statistic"] == pytest.approx(0.5)
    assert out["p_value"] == pytest.approx(2 * 2.718281828**-12.5, rel=1e-3)
    near = [(1, float(i)) for i in range(50)] + [(0, float(i) + 0.5) for i in range(50)]
    assert assoc.ks_two_sample(spark.createDataFrame(near, "tag int, x double"), "tag", ["x"]).first()["p_value"] == pytest.approx(1.0)


def test_scaler_without_spread(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    out = encode.fit_scaler(df, ["x", "y"]).apply(df).collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def test_weighted_sum_null_and_missing(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 3.0)], "a double, b double")
    w = {"a": 1.0, "b": 3.0}
    assert [r[0] for r in df.select(scalar.weighted_sum(w, df.columns)).collect()] == [2.5, None]
    with pytest.raises(KeyError):
        scalar.weighted_sum({**w, "c": 1.0}, df.columns)
    assert df.select(scalar.weighted_sum({**w, "c": 1.0}, df.columns, "skip")).first()[0] == 2.5


def test_numerical_encoding_single_label(spark):
    df = spark.createDataFrame([(1, "a", "m"), (2, "b", "m"), (3, "a", "m")], "i int, k string, s string")
    assert encode.numerical_encoding(df, ["i"]).columns == ["i", "k", "s"]
    assert encode.numerical_encoding(df, ["i"], drop_single_label=True).columns == ["i", "k"]
    assert [r["k"] for r in encode.numerical_encoding(df, ["i"]).orderBy("i").collect()] == [0, 1, 0]
    assert encode.numerical_encoding(df, ["i"], nominal=None).columns == df.columns


def test_any_number_of_categories(spark):
    df = spark.range(50_000).select("id", F.concat(F.lit("k"), F.col("id") * 7919 % 50_000).alias("k"), (F.col("id") % 3).alias("m"))
    codes = encode.fit_codes(df, ["k", "m"], ["id"])
    coded = encode.add_codes(df, codes, ["k", "m"])
    assert coded.filter((F.col("k_code") != F.col("id")) | (F.col("m_code") != F.col("id") % 3)).count() == 0
    hot = encode.sparse_one_hot(df.filter("id % 1000 = 7"), codes, ["k", "m"])
    for r in hot.collect():
        assert (r.one_hot.size, sorted(r.one_hot.indices.tolist())) == (50_003, [r.id, 50_000 + r.id % 3])
    assert len(encode.fit_vocabulary(df, ["k"], ["id"])["k"]) == 50_000


def test_sparse_one_hot_is_the_dense_one(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", None), (3, "b", "y"), (4, None, "x"), (5, "c", "x")], "i int, k string, s string")
    known = df.filter("i <= 3")
    codes = encode.fit_codes(known, ["k", "s"], ["i"])
    assert {(r.column, r.value, r.code) for r in codes.collect()} == {("k", "b", 0), ("k", "a", 1), ("s", "x", 0), ("s", "y", 1)}
    got = {r.i: r.one_hot.toArray().tolist() for r in encode.sparse_one_hot(df, codes, ["k", "s"]).collect()}
    assert got == {1: [1, 0, 1, 0], 2: [0, 1, 0, 0], 3: [1, 0, 0, 1], 4: [0, 0, 1, 0], 5: [0, 0, 1, 0]}
    none = encode.fit_codes(known.limit(0), ["k"], ["i"])
    assert encode.sparse_one_hot(df, none, ["k"]).filter("one_hot IS NULL").count() == 5


def test_settings_grow_with_the_data():
    from panelspark.session import cluster_settings

    assert cluster_settings(1)["spark.sql.shuffle.partitions"] == "200"
    assert int(cluster_settings(100 << 40)["spark.sql.shuffle.partitions"]) > 500_000


def test_missing_strategies(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (3.0, 4.0)], "x double, y double")
    assert clean.missing_strategy(df, "replace").filter("x = 0 OR y = 0").count() == 2
    assert clean.missing_strategy(df, "drop_samples").count() == 1
    assert clean.missing_strategy(df.withColumn("z", F.lit(1)), "drop_features").columns == ["z"]
    assert clean.missing_strategy(df, "skip").count() == 3
    with pytest.raises(ValueError):
        clean.missing_strategy(df, "other")


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert clean.nan_to_null(df).filter("x IS NULL").count() == 1


def test_type_narrowing_is_strict(spark):
    df = spark.createDataFrame([(126, 127, 40000, 1.0), (-127, 0, 0, 1e300)], "a long, b long, c long, d double")
    types = {k: v.simpleString() for k, v in clean.fit_types(df).items()}
    assert types == {"a": "tinyint", "b": "smallint", "c": "int", "d": "double"}


def test_dedupe_keeps_first_and_is_total(spark):
    d = date(2024, 1, 1)
    df = spark.createDataFrame([(1, "a", d, 2.0, 1), (1, "a", d, 1.0, 2), (1, "b", d, 5.0, 3)], f"{DISK}, x double, o int")
    by_order = {r["serial_number"]: r["x"] for r in clean.dedupe_disk_day(df, order=["o"]).collect()}
    by_value = {r["serial_number"]: r["x"] for r in clean.dedupe_disk_day(df).collect()}
    assert by_order == {"a": 2.0, "b": 5.0} and by_value == {"a": 1.0, "b": 5.0}
    assert clean.dedupe_disk_day(df).columns == df.columns


def test_sequences_of_short_disks_are_absent(spark):
    df = days(spark, [(i, (float(i), i % 2)) for i in range(5)], "x double, tag int")
    out = rolling.sequence_windows(df, ["x"], "tag", 3).orderBy("last_dt").collect()
    assert [r["data"] for r in out] == [[[0.0], [1.0], [2.0]], [[1.0], [2.0], [3.0]], [[2.0], [3.0], [4.0]]]
    assert [r["tag"] for r in out] == [0, 1, 0]
    assert rolling.sequence_windows(df, ["x"], "tag", 6).count() == 0


def test_sampling_keeps_faults_and_quota(spark, sf):
    from panelspark.registry.sampling import rows

    df = rows(spark, sf)
    faulty, normal = sampling.split_by_label(df)
    picked = sampling.sample_by_month(normal, 50)
    assert picked.count() == 50 and picked.filter("tag = 1").count() == 0
    assert sampling.sample_by_month(normal, 10_000_000).count() == normal.count()
    plan_rows = sampling.sampling_plan(df, ("2024-01-01", "2024-01-30"), 0.1)
    assert plan_rows.filter("tag = 1").count() == faulty.count()
    disks = sampling.sample_disks(df, 0.2)
    keys = ["model", "serial_number"]
    assert disks.filter("tag = 1").select(*keys).distinct().count() == faulty.select(*keys).distinct().count()
    with pytest.raises(ValueError):
        sampling.sampling_plan(df, ("2024-01-01", "2024-01-30"), 0.1, "other")
    everything = sampling.sampling_plan(df, ("2024-01-01", "2024-01-30"), 0.1, None)
    assert everything.count() == df.count()


def test_samples_repeat(spark, sf):
    from panelspark.registry.sampling import rows

    normal = sampling.split_by_label(rows(spark, sf))[1]
    one = {tuple(r) for r in sampling.sample_by_bucket(normal, 0.3).collect()}
    two = {tuple(r) for r in sampling.sample_by_bucket(normal.repartition(3), 0.3).collect()}
    other = {tuple(r) for r in sampling.sample_by_bucket(normal, 0.3, seed=7).collect()}
    assert one == two != other and len(one) == len(other)


def test_split_leaves_the_gap_out(spark, sf):
    from panelspark.registry.evaluation import GAP, TRAIN, VALID, base

    out = split.gap_time_split(base(spark, sf), TRAIN, VALID, GAP)
    between = out.filter(F.col("dt").between(*[F.lit(x).cast("date") for x in GAP]))
    assert between.filter("split = 'valid' OR tag = 0").count() == 0
    with pytest.raises(ValueError):
        split.time_series_folds(out, [TRAIN], [])


def test_folds_may_overlap(spark):
    df = days(spark, [(i, (1.0,)) for i in range(4)])
    out = split.time_series_folds(df, [("2024-01-01", "2024-01-02"), ("2024-01-02", "2024-01-03")], [("2024-01-03", "2024-01-03"), ("2024-01-04", "2024-01-04")])
    got = sorted((r["fold"], r["split"], r["dt"].day) for r in out.collect())
    assert got == [(0, "train", 1), (0, "train", 2), (0, "valid", 3), (1, "train", 2), (1, "train", 3), (1, "valid", 4)]


def test_early_stop():
    assert trees.early_stop_round([5, 4, 3, 3.5, 3.4, 2.9]) == (6, 2.9)
    assert trees.early_stop_round([5, 4, 3, 3.5, 3.4, 3.3, 3.2, 3.1, 1.0]) == (3, 3)


def test_random_params_stay_in_space():
    rows = trees.random_params({"a": [1, 2], "b": (0.1, 0.2)}, {"c": 9}, 20, 1)
    assert len(rows) == 20 and all(r["a"] in (1, 2) and 0.1 <= r["b"] <= 0.2 and r["c"] == 9 for r in rows)
    assert rows == trees.random_params({"a": [1, 2], "b": (0.1, 0.2)}, {"c": 9}, 20, 1)


def test_fitted_features_roundtrip():
    f = plan.FittedFeatures(["a"], [0.0, 1.0])
    assert plan.FittedFeatures.from_json(f.to_json()) == f


def test_fault_type_matrix_is_zero_filled(spark):
    faults = spark.createDataFrame([(date(2024, 1, 3), 0), (date(2024, 1, 9), 6), (date(2024, 2, 1), 6)], "fault_time date, tag int")
    out = [tuple(r) for r in profile.fault_type_matrix(faults).collect()]
    assert out == [("2024-02", 0, 0, 0, 0, 0, 0, 1, 1), ("2024-01", 1, 0, 0, 0, 0, 0, 1, 2)]


def test_rare_values_become_other(spark):
    df = spark.createDataFrame([("a",)] * 9 + [("b",)], "k string")
    assert sorted(r[0] for r in encode.rare_to_other(df, "k", 0.2).collect()) == ["a"] * 9 + ["other"]


def test_early_stop_decides_the_model(spark):
    rows = [(i, float(i % 17), float((i * 7) % 5), int((i * 37) % 100 < 30 + 3 * (i % 17)), "valid" if i % 3 == 0 else "train") for i in range(600)]
    df = spark.createDataFrame(rows, "id int, a double, b double, tag int, split string")
    params = {"maxIter": 12, "maxDepth": 2, "stepSize": 0.3}
    full = trees.train_gbt(df.filter("split = 'train'"), ["a", "b"], **params)
    losses = trees.loss_by_round(full, df.filter("split = 'valid'"))
    kept = trees.train_gbt(df, ["a", "b"], split="split", patience=2, **params)
    assert trees.trees_of(kept).getNumTrees == trees.early_stop_round(losses, 2)[0]
    clear = df.withColumn("tag", (F.col("a") > 8).cast("int"))  # every round gains, each of them under 1 %
    slow = trees.train_gbt(clear, ["a", "b"], split="split", maxIter=6, maxDepth=2, stepSize=0.01)
    assert trees.trees_of(slow).getNumTrees == 6


def test_nan_never_alerts(spark):
    rows = [("a", 1, "2018-01-01", float("nan")), ("b", 1, "2018-01-01", 0.5), ("c", 1, "2018-01-01", 0.1)]
    df = spark.createDataFrame(rows, "serial_number string, model int, dt string, prob double")
    assert [r.serial_number for r in rank.daily_alerts(df, quantile=0.1, per_day=1).collect()] == ["b"]
