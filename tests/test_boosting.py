"""Second-order boosting against a plain booster in floating point, row by row."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import boosting
from panelspark.operators.boosting import Boosted, FocalLoss, LogLoss, Params

FEATURES = ["a", "b", "c"]


def _data(n=500, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n).round(3), rng.integers(0, 6, n).astype(float), rng.exponential(size=n).round(3)], 1)
    y = (x[:, 0] + 0.4 * x[:, 1] - x[:, 2] + rng.normal(size=n) > 0.8).astype(float)
    return x, y


def _frame(spark, x, y, valid=None):
    rows = [(*map(float, r), int(t), "valid" if valid is not None and v else "train") for r, t, v in zip(x, y, valid if valid is not None else y, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, tag int, split string")


def _numeric(loss, margin, label):
    up, at, down = (loss.value(margin + d, label) for d in (1e-4, 0, -1e-4))
    return (up - down) / 2e-4, (up - 2 * at + down) / 1e-8


@pytest.mark.parametrize("loss", [LogLoss(), FocalLoss(0.25, 2.0), FocalLoss(0.7, 1.0), FocalLoss(0.5, 0.5)])
def test_derivatives(loss):
    margin, label = np.repeat(np.linspace(-6, 6, 61), 2), np.tile([0.0, 1.0], 61)
    g, h = loss.derivatives(margin, label)
    g2, h2 = _numeric(loss, margin, label)
    assert np.allclose(g, g2, atol=1e-6) and np.allclose(h, h2, atol=1e-4)
    far = np.array([-800.0, 800.0])
    for label in (0.0, 1.0):
        assert all(np.isfinite(v).all() for v in (*loss.derivatives(far, np.full(2, label)), loss.value(far, np.full(2, label))))


def test_focal_loss_is_the_column(spark):
    from panelspark.functions.scalar import focal_loss

    df = spark.createDataFrame([(float(m), t) for m in (-3, -0.5, 0, 2) for t in (0, 1)], "m double, t int")
    rows = df.select("m", "t", focal_loss("m", "t", 0.3, 1.7).alias("v")).collect()
    own = FocalLoss(0.3, 1.7).value(np.array([r.m for r in rows]), np.array([float(r.t) for r in rows]))
    assert np.allclose(own, [r.v for r in rows])


def _plain(x, y, w, edges, loss, params):
    """Trees grown node by node over lists of rows, every cut tried, in plain floating point."""
    margin, trees = np.full(len(y), params.start), []
    for _ in range(params.rounds):
        g, h = (v * w for v in loss.derivatives(margin, y))
        tree = {}

        def worth(rows):
            return g[rows].sum() ** 2 / (h[rows].sum() + params.l2)

        def grow(node, rows, depth):
            tree[node] = (-1, 0, -params.rate * g[rows].sum() / (h[rows].sum() + params.l2))
            if depth == params.depth:
                return
            best = (params.min_gain, None)
            for f, borders in enumerate(edges):
                for cut, border in enumerate(borders):
                    left, right = rows[x[rows, f] <= border], rows[x[rows, f] > border]
                    if min(len(left), len(right)) < params.min_rows or min(h[left].sum(), h[right].sum()) < params.min_hessian:
                        continue
                    gain = worth(left) + worth(right) - worth(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut, left, right))
            if best[1]:
                f, cut, left, right = best[1]
                tree[node] = (f, cut, 0.0)
                grow(2 * node + 1, left, depth + 1)
                grow(2 * node + 2, right, depth + 1)

        grow(0, np.arange(len(y)), 0)
        trees.append(tree)
        for i in range(len(y)):
            node = 0
            while tree[node][0] >= 0:
                f, cut, _ = tree[node]
                node = 2 * node + 1 + (x[i, f] > edges[f][cut])
            margin[i] += tree[node][2]
    return trees, margin


@pytest.mark.parametrize("loss", [LogLoss(), FocalLoss(0.25, 2.0)])
def test_against_plain_booster(spark, loss):
    x, y = _data()
    w = np.where(y > 0, 3.0, 1.0)
    params = Params(rounds=6, depth=3, rate=0.3, bins=16, min_rows=8, margin_every=2)
    df = _frame(spark, x, y).repartition(5)
    model = boosting.train_boosted(df, FEATURES, weight=F.when(F.col("tag") == 1, 3.0).otherwise(1.0), loss=loss, params=params)
    trees, margin = _plain(x, y, w, model.edges, loss, params)
    assert len(model.trees) == 6
    for got, want in zip(model.trees, trees, strict=True):
        for node, (f, cut, value) in want.items():
            assert (got.feature[node], got.cut[node] if f >= 0 else 0) == (f, cut)
            assert f >= 0 or abs(got.value[node] - value) < 1e-4
    assert np.allclose(model.margin(model.binned(list(x.T))), margin, atol=1e-3)
    assert abs(model.train_loss[-1] - np.average(loss.value(margin, y), weights=w)) < 1e-4
    assert model.train_loss == sorted(model.train_loss, reverse=True)


def test_focal_fit_lowers_the_focal_loss(spark):
    """The focal fit has the lower focal loss, the plain fit the lower cross entropy."""
    x, y = _data(1500)
    df, focal = _frame(spark, x, y), FocalLoss(0.25, 2.0)
    params = Params(rounds=15, depth=3, rate=0.5, bins=16)
    margins = {}
    for name, loss in (("focal", focal), ("log", LogLoss())):
        model = boosting.train_boosted(df, FEATURES, loss=loss, params=params)
        margins[name] = model.margin(model.binned(list(x.T)))
    assert focal.value(margins["focal"], y).mean() < focal.value(margins["log"], y).mean()
    assert LogLoss().value(margins["log"], y).mean() < LogLoss().value(margins["focal"], y).mean()


def test_prefix_and_early_stop(spark):
    x, y = _data(800)
    valid = np.arange(800) % 3 == 0
    df = _frame(spark, x, y, valid)
    params = Params(rounds=40, depth=3, rate=0.6, bins=16, min_rows=5)
    stopped = boosting.train_boosted(df, FEATURES, split="split", patience=3, params=params)
    n = len(stopped.trees)
    assert 0 < n < 40 and stopped.valid_loss[-1] == min(stopped.valid_loss)
    for rounds in (1, n):
        short = boosting.train_boosted(df.filter("split = 'train'"), FEATURES, params=Params(rounds=rounds, depth=3, rate=0.6, bins=16, min_rows=5))
        assert short.trees == stopped.prefix(rounds).trees
    bins = stopped.binned(list(x[valid].T))
    assert abs(LogLoss().value(stopped.margin(bins), y[valid]).mean() - stopped.valid_loss[-1]) < 1e-5


def test_layout_does_not_matter(spark):
    x, y = _data()
    df = _frame(spark, x, y)
    params = Params(rounds=4, depth=3, bins=16, min_rows=5)
    one = boosting.train_boosted(df.coalesce(1), FEATURES, params=params)
    other = boosting.train_boosted(df.repartition(7, "a"), FEATURES, edges=one.edges, params=params)
    assert one.trees == other.trees and one.train_loss == other.train_loss


def test_transform_and_store(spark, tmp_path):
    from pyspark.ml.functions import vector_to_array

    x, y = _data(200)
    df = _frame(spark, x, y).withColumn("c", F.when(F.col("c") > 0.1, F.col("c")))
    model = boosting.train_boosted(df, ["a", "c"], ["b"], loss=FocalLoss(), params=Params(rounds=3, depth=2, bins=8, min_rows=5))
    boosting.save_boosted(spark, model, str(tmp_path / "model"))
    loaded = boosting.load_boosted(spark, str(tmp_path / "model"))
    assert loaded == model
    out = loaded.transform(df, leaves=True).select("a", "b", "c", vector_to_array("probability")[1].alias("p"), vector_to_array("leaves").alias("leaves")).collect()
    assert len(out) == 200
    filled = [np.array([r.a for r in out]), np.array([-1.234 if r.c is None else r.c for r in out]), np.array([r.b for r in out])]
    margin = model.margin(model.binned(filled))
    assert np.allclose([r.p for r in out], 1 / (1 + np.exp(-margin)))
    assert all(len(r.leaves) == 3 and all(0 <= v < len(t.leaves()) for v, t in zip(r.leaves, model.trees, strict=True)) for r in out)
    assert abs(sum(model.importance.values()) - 1) < 1e-9


def test_nothing_to_learn(spark):
    empty = boosting.train_boosted(_frame(spark, np.zeros((0, 3)), np.zeros(0)), FEATURES, params=Params(rounds=3))
    same = boosting.train_boosted(_frame(spark, np.ones((50, 3)), np.zeros(50)), FEATURES, params=Params(rounds=3))
    assert empty.trees == [] and same.trees == [] and isinstance(same, Boosted)
