"""One coreset for every number of clusters."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import cluster


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    centre = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 5], [30, 30, 30]])
    which = rng.choice(4, 12_000, p=[0.5, 0.3, 0.19, 0.01])
    x = (centre[which] + rng.normal(size=(12_000, 3))).round(2)
    x[:3000] = x[0]  # a quarter of the rows are copies
    data = [(0, float(a), float(b), None if i % 50 == 0 else float(c)) for i, (a, b, c) in enumerate(x)]
    return spark.createDataFrame(data, "tag int, a double, b double, c double").repartition(6).cache()


COLUMNS = ["a", "b", "c"]


def test_weights_stand_for_all_rows(rows):
    small = cluster.coreset(rows, COLUMNS, 1500).toPandas()
    whole = rows.toPandas()[COLUMNS].fillna(-1.234).to_numpy()
    assert 900 < len(small) < 1700 and small.weight.sum() == pytest.approx(12_000, rel=0.08)  # three deviations
    points, w = small[COLUMNS].to_numpy(), small.weight.to_numpy()
    for centres in (np.zeros((1, 3)), np.array([[0, 0, 0], [30, 30, 30]]), np.array([[0, 0, 0], [10, 0, 0], [0, 10, 5], [30, 30, 30]])):
        cost = [((p[:, None] - centres[None]) ** 2).sum(-1).min(1) for p in (whole, points)]
        assert (cost[1] * w).sum() == pytest.approx(cost[0].sum(), rel=0.08)
    again = cluster.coreset(rows.repartition(2, "a"), COLUMNS, 1500).toPandas()
    assert sorted(map(tuple, again.round(6).to_numpy().tolist())) == sorted(map(tuple, small.round(6).to_numpy().tolist()))


def test_centres_are_as_good_as_those_of_full_fits(rows):
    """Measured as k-means does, by squared distances over all rows, from the number of clusters that the rows have
    on; with fewer, k-means ends in one of several optima, whatever it is fitted on."""
    small = cluster.coreset(rows, COLUMNS, 1500).cache()
    whole = rows.fillna(-1.234).toPandas()[COLUMNS].to_numpy()

    def cost(centres):
        return ((whole[:, None] - np.array(centres)[None]) ** 2).sum(-1).min(1).sum()

    for k in (4, 6):
        full, part = (cluster.fit_centers(df, COLUMNS, k, weight=w, starts=4) for df, w in ((rows, None), (small, "weight")))
        assert cost(part) <= 1.15 * cost(full), k


def test_one_cluster_is_exact(rows):
    mean = rows.fillna(-1.234).agg(*[F.avg(c) for c in COLUMNS]).first()
    own = rows.fillna(-1.234).toPandas()[COLUMNS].to_numpy()
    told = {r.k: r.distortion for r in cluster.kmeans_elbow(rows, COLUMNS, (1, 4), size=1500).collect()}
    assert told[1] == pytest.approx(np.sqrt(((own - np.array(mean)) ** 2).sum(1)).mean()) and told[4] < told[1] / 2


def test_few_rows_are_all_taken(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (0, None), (1, 9.0)], "tag int, a double")
    assert sorted(map(tuple, cluster.coreset(df, ["a"]).collect())) == [(-1.234, 1.0), (1.0, 2.0), (9.0, 1.0)]
    assert cluster.coreset(df.limit(0), ["a"]).count() == 0
