"""Paths that only big or skewed data would take, forced by small limits; and plan shapes."""

from __future__ import annotations

import random
import re
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark import registry
from panelspark import schema as S
from panelspark.operators import assoc, metrics, neighbours, ordering, profile, rank, sampling
from panelspark.plans import features as plan
from panelspark.registry import sampling as sampling_queries

CUT = {"ranges": 8}


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most of the rows, a few values shared by many of them, and small groups."""
    rng = random.Random(3)
    rows = [("hot", rng.choice([0.0, 0.5, rng.random() ** 4])) for _ in range(3000)]
    rows += [(f"g{i % 40}", rng.random()) for i in range(400)]
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    return spark.createDataFrame(pdf), pdf


def test_running_totals_over_ranges(spark, skewed):
    df, pdf = skewed
    folded = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = ordering.running_totals(folded, ["g"], "v", ["n"], **CUT).toPandas()
    plain = ordering.running_totals(folded, ["g"], "v", ["n"]).toPandas()
    key = ["g", "v"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), plain.sort_values(key).reset_index(drop=True))
    for r in got.sample(50, random_state=1).itertuples():
        assert r.n_before == ((pdf.g == r.g) & (pdf.v < r.v)).sum()


def test_running_totals_without_group(spark, skewed):
    df, pdf = skewed
    folded = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = ordering.running_totals(folded, [], "v", ["n"], **CUT).toPandas().sort_values("v")
    assert (got.n_before.to_numpy() == got.n.cumsum().shift(fill_value=0).to_numpy()).all()


def test_hot_group_is_spread_over_ranges(spark, skewed):
    df, _ = skewed
    folded = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    ranged = folded.repartitionByRange(8, "g", "v").withColumn("r", F.spark_partition_id())
    assert ranged.filter("g = 'hot'").select("r").distinct().count() >= 4
    for group in (["g"], []):
        plan = ordering.quantiles(df, group, "v", [0.5], **CUT)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Exchange hashpartitioning(g, v" not in plan


def test_quantiles_keep_the_null_group(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(101)] + [("a", 1.0), ("a", 2.0)], "g string, v double")
    got = {r["g"]: (r["n"], r["q0"]) for r in ordering.quantiles(df, ["g"], "v", [0.5], **CUT).collect()}
    assert got == {None: (101, 50.0), "a": (2, 1.5)}


@pytest.mark.parametrize("bucket_rows", [1, 10, 10_000])
def test_sample_prefix_is_refined(spark, bucket_rows):
    df = spark.range(5000).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("s"))
    quotas = spark.createDataFrame([("hot", 777), ("cold", 5)], "s string, quota long")
    got = ordering.smallest_per_stratum(df, ["s"], quotas, ["id"], 4, bucket_rows=bucket_rows).collect()
    for stratum, n in (("hot", 777), ("cold", 5)):
        first = df.filter(F.col("s") == stratum).orderBy(ordering.hash_key(["id"], 4), "id").limit(n)
        assert {r["id"] for r in got if r["s"] == stratum} == {r["id"] for r in first.collect()}


def test_quantiles_match_numpy(spark, skewed):
    df, pdf = skewed
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for r in ordering.quantiles(df, ["g"], "v", probs, **CUT).collect():
        want = np.quantile(pdf[pdf.g == r["g"]].v, probs)
        assert [r[f"q{i}"] for i in range(5)] == pytest.approx(list(want))
    whole = ordering.quantiles(df, [], "v", [0.5], **CUT).first()
    assert whole["q0"] == pytest.approx(pdf.v.median()) and whole["n"] == len(pdf)


def test_average_rank_matches_pandas(spark, skewed):
    df, pdf = skewed
    got = ordering.average_rank(df, ["g"], "v", **CUT).toPandas()
    want = pdf.assign(rank=pdf.groupby("g").v.rank()).drop_duplicates(["g", "v"])
    both = got.merge(want, on=["g", "v"], suffixes=("", "_want"))
    assert len(both) == len(got) == len(want) and np.allclose(both["rank"], both["rank_want"])


def test_auc_and_ks_over_ranges(spark):
    rng = random.Random(5)
    rows = [(round(rng.random() + 0.2 * (i % 3 == 0), 2), int(i % 3 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "prob double, tag int")
    pos = np.array([p for p, t in rows if t]); neg = np.array([p for p, t in rows if not t])
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg)
    assert metrics.auc(df, **CUT).first()["auc"] == pytest.approx(want)
    got = assoc.ks_two_sample(df, "tag", ["prob"], **CUT).first()["statistic"]
    grid = np.unique(np.concatenate([pos, neg]))
    assert got == pytest.approx(max(abs((pos <= x).mean() - (neg <= x).mean()) for x in grid))


def test_stratified_sample_is_exact(spark):
    rows = [(i, "hot" if i % 3 else "cold") for i in range(6000)]
    df = spark.createDataFrame(rows, "id int, s string").repartition(7)
    quotas = spark.createDataFrame([("hot", 1234), ("cold", 5000), ("none", 3)], "s string, quota long")
    got = ordering.smallest_per_stratum(df, ["s"], quotas, ["id"], 1).toPandas()
    assert dict(got.s.value_counts()) == {"hot": 1234, "cold": 2000}
    by_hash = df.filter("s = 'hot'").orderBy(ordering.hash_key(["id"], 1), "id").limit(1234)
    assert set(got[got.s == "hot"].id) == {r["id"] for r in by_hash.collect()}
    zero = ordering.smallest_per_stratum(df, ["s"], quotas.withColumn("quota", F.lit(0).cast("long")), ["id"], 1)
    assert zero.count() == 0


def naive_alerts(pdf, quantile, per_day):
    out = []
    for _, day in pdf.groupby("dt"):
        day = day.assign(rank=day.prob.rank())
        day = day[day["rank"] >= len(day) * quantile]
        out.append(day.sort_values(["prob", "model", "serial_number"], ascending=[False, True, True]).head(per_day))
    return pd.concat(out)


@pytest.mark.parametrize("quantile,per_day", [(0.996, 40), (0.9, 3), (0.5, 7), (0.0, 1000)])
def test_alerts_equal_the_step_by_step_rule(spark, quantile, per_day):
    rng = random.Random(11)
    rows = []
    for d in range(5):
        for s in range(200 if d else 900):
            prob = 0.75 if rng.random() < 0.3 else round(rng.random(), 2)
            rows.append((s % 2 + 1, f"d{s}", date(2024, 1, 1) + timedelta(days=d), prob))
    pdf = pd.DataFrame(rows, columns=["model", "serial_number", "dt", "prob"])
    df = spark.createDataFrame(rows, "model int, serial_number string, dt date, prob double")
    got = rank.daily_alerts(df, quantile=quantile, per_day=per_day).toPandas()
    want = naive_alerts(pdf, quantile, per_day)
    key = ["dt", "model", "serial_number"]
    a, b = got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    assert len(a) == len(b) and (a[key].astype(str) == b[key].astype(str)).all().all() and np.allclose(a["rank"], b["rank"])


def brute_neighbours(points, k):
    ids = sorted(points)
    out = {}
    for i in ids:
        near = sorted((float(np.sqrt(((points[i] - points[j]) ** 2).sum())), j) for j in ids if j != i)[:k]
        out[i] = near
    return out


@pytest.mark.parametrize("block_rows,most_blocks", [(2048, 64), (40, 6), (25, 3), (10, 4096)])
def test_neighbours_equal_brute_force(spark, block_rows, most_blocks):
    rng = np.random.default_rng(2)
    points = {i: rng.normal(size=3) + 6 * (i % 3) for i in range(240)}
    for i in range(0, 90):  # a group of copies with more than a third of the rows
        points[i] = np.array([1.0, 1.0, 1.0])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in points.items()], "id long, v array<double>")
    got = neighbours.nearest_neighbours(df, "id", "v", 5, block_rows=block_rows, most_blocks=most_blocks).toPandas()
    want = brute_neighbours(points, 5)
    assert len(got) == 240 * 5
    for i, g in got.sort_values("rank").groupby("id"):
        assert list(g.neighbour) == [j for _, j in want[i]]
        assert list(g.distance) == pytest.approx([d for d, _ in want[i]])


def test_neighbours_leave_most_distances_out(spark):
    """Vectors of 16 numbers near a surface of three dimensions: a small part of all distances is worked out."""
    rng = np.random.default_rng(4)
    n, counter = 4000, spark.sparkContext.accumulator(0)
    flat = rng.normal(size=(n, 3))
    points = flat @ rng.normal(size=(3, 16)) + 0.001 * rng.normal(size=(n, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "id long, v array<double>")
    got = neighbours.nearest_neighbours(df, "id", "v", 5, block_rows=500, counter=counter).toPandas()
    d = neighbours.distances(points, points)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, 1)[:, :5]
    found = got.sort_values(["id", "rank"]).distance.to_numpy().reshape(n, 5)
    assert np.allclose(found, want) and 0 < counter.value < n * n / 5


def test_blocks_are_balanced():
    points = np.random.default_rng(5).normal(size=(4000, 8))
    nodes = neighbours.split_tree(points[:1000], 16)
    sizes = np.bincount(neighbours.leaf_of(nodes, points))
    assert len(sizes) == 16 and sizes.min() > 150 and sizes.max() < 350
    assert neighbours.leaf_of(neighbours.split_tree(np.ones((50, 2)), 8), np.ones((5, 2))).tolist() == [0] * 5


def test_neighbours_of_few_points(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [5.0])], "id int, v array<double>")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in neighbours.nearest_neighbours(df, "id", "v", 5).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 2, (3, 2): 1}


def test_neighbours_ask_a_few_rows_at_once(spark, monkeypatch):
    """However many rows a task has, only as many are held against all blocks as give a bounded number of pairs."""
    own = neighbours.distances

    def checked(a, b):
        from sys import _getframe

        assert _getframe(1).f_code.co_name != "run" or len(a) <= 10, "too many at once"  # against the centres of all blocks
        return own(a, b)

    monkeypatch.setattr(neighbours, "ASKED_AT_ONCE", 40, raising=False)
    monkeypatch.setattr(neighbours, "distances", checked)
    points = np.random.default_rng(3).normal(size=(400, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "id long, v array<double>").coalesce(1)
    got = neighbours.nearest_neighbours(df, "id", "v", 5, block_rows=100).toPandas()
    d = own(points, points)
    np.fill_diagonal(d, np.inf)
    assert np.allclose(got.sort_values(["id", "rank"]).distance.to_numpy().reshape(400, 5), np.sort(d, 1)[:, :5])


@pytest.mark.parametrize("shift,spread", [(0.0, 1.0), (1e7, 1.0), (-3.0, 1e-9)])
def test_neighbours_work_out_few_distances_by_differences(monkeypatch, shift, spread):
    """Points spread evenly over a sphere: no ball can be ruled out, but bounds of whole blocks leave few pairs."""
    rng = np.random.default_rng(6)
    points = rng.normal(size=(1200, 32))
    points = shift + spread * points / np.sqrt((points**2).sum(1))[:, None]
    points[1000:1100] = points[:100]
    own, worked_out = neighbours.distances, []

    def counted(a, b):
        worked_out.append(len(a) * len(b))
        return own(a, b)

    monkeypatch.setattr(neighbours, "distances", counted)
    weights = np.where(np.arange(1200) % 10 == 0, 3, 1)
    row, who, far, _ = neighbours.closest(points[:900], np.full(900, np.inf), points, weights, 6)
    assert sum(worked_out) < 900 * 1200 / 10 and len(row) < 900 * 30
    d = own(points[:900], points)
    for i in range(900):
        nearest = np.argsort(d[i], kind="stable")
        upto = d[i][nearest[np.searchsorted(np.cumsum(weights[nearest]), 6)]]
        assert sorted(who[row == i]) == np.flatnonzero(d[i] <= upto).tolist()
        assert np.array_equal(np.sort(far[row == i]), np.sort(d[i][d[i] <= upto]))


def test_smote_balances_and_interpolates(spark):
    rows = [(i, 1 if i < 10 else 0, float(i), None if i == 3 else 2.0 * i) for i in range(75)]
    df = spark.createDataFrame(rows, "id long, tag int, x double, y double")
    out = neighbours.smote_balance(df, "id", ["x", "y"]).toPandas()
    assert dict(out.tag.value_counts()) == {0: 65, 1: 65} and out.synthetic.sum() == 55
    made = out[out.synthetic]
    assert made.x.between(0, 9).all() and made.y.between(-1.234, 18).all() and made.x.nunique() > 30
    twice = neighbours.smote_balance(df.repartition(5), "id", ["x", "y"]).toPandas()
    assert sorted(map(tuple, twice.values.tolist())) == sorted(map(tuple, out.values.tolist()))


def test_approximate_boxplot_is_close(spark, sf):
    df = registry.labelled(spark, sf)
    exact = {(r["column"], r["flag"]): r["q50"] for r in profile.boxplot_stats(df, ["smart_4raw"], "flag").collect()}
    close = {(r["column"], r["flag"]): r["q50"] for r in profile.boxplot_stats_approx(df, ["smart_4raw"], "flag").collect()}
    assert exact.keys() == close.keys() and all(abs(exact[k] - close[k]) <= 1 for k in exact)


# --- plans -----------------------------------------------------------------------------------


def text(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_need_one_exchange(spark, sf):
    fitted = plan.FittedFeatures(list(S.SENSORS), [0.0, 10.0, 20.0, 30.0, 40.0])
    from panelspark.session import materialize

    cleaned = materialize(registry.powered(spark, sf))
    p = text(plan.build_features(cleaned, fitted, ["tag", "flag"]))
    assert len(re.findall(r"\bExchange\b", p)) == 1 and "hashpartitioning(model" in p
    assert len(re.findall(r"\+- Sort ", p)) <= 4
    assert "Python" not in p and "CartesianProduct" not in p and "NestedLoop" not in p


def test_filters_and_columns_reach_the_scan(spark, sf):
    from panelspark.operators import clean
    from panelspark.session import materialize

    stored = materialize(registry.panel(spark, sf))
    p = text(clean.of_model(clean.in_date_range(stored, "2024-01-05", "2024-01-09"), 1).select("serial_number", "smart_4raw"))
    assert "GreaterThanOrEqual(dt,2024-01-05)" in p and "EqualTo(model,1)" in p
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert "smart_1_normalized" not in schema


def test_bucketed_panel_needs_no_exchange(spark, sf):
    from panelspark.session import materialize, new_path
    from panelspark.sources import writers

    fitted = plan.FittedFeatures(list(S.SENSORS), [0.0, 10.0, 20.0, 30.0, 40.0])
    cleaned = materialize(registry.powered(spark, sf))
    bucketed = writers.bucket_panel(cleaned, "bucketed_panel", new_path(spark, "bucketed"), 8)
    made = plan.build_features(bucketed, fitted, ["tag", "flag"])
    assert not re.findall(r"\bExchange\b", text(made)) and "SelectedBucketsCount: 8 out of 8" in text(made)
    plain = plan.build_features(cleaned, fitted, ["tag", "flag"])
    assert made.exceptAll(plain).isEmpty() and made.count() == plain.count()
    spark.sql("DROP TABLE bucketed_panel")


def test_daily_top_is_limited_before_the_shuffle(spark, sf):
    from panelspark.session import materialize

    stored = materialize(registry.scored(spark, sf))
    p = text(rank.daily_alerts(stored.select("model", "serial_number", "dt", "prob")))
    assert p.count("WindowGroupLimit") >= 4 and "CartesianProduct" not in p


def test_sample_reads_wide_rows_without_a_shuffle(spark, sf):
    from panelspark.session import materialize

    stored = materialize(sampling_queries.rows(spark, sf))
    p = text(sampling.sample_by_bucket(stored, 0.3))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p and "Exchange hashpartitioning" not in p


def test_duplicates_fold_before_the_shuffle(spark, sf):
    from panelspark.operators import clean

    p = text(clean.dedupe_disk_day(registry.table(spark, sf, "lineitem"), ["l_suppkey", "l_shipdate"]))
    before_shuffle = p[p.index("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle
