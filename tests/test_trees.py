"""Ensembles: a prefix is the shorter fit, early stopping fits once, either kind of model does every job."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelspark.operators import trees

FEATURES = ["a", "b", "c"]
SMALL = {"maxIter": 8, "maxDepth": 2}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 3)).round(3)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=400) > 0.5).astype(int)
    data = [(i, *map(float, r), int(t), "valid" if i % 4 == 0 else "train") for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id int, a double, b double, c double, tag int, split string").cache()


def _probabilities(model, df):
    return {r.id: r.p for r in model.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()}


@pytest.mark.parametrize("rounds", [1, 5])
def test_prefix_is_the_shorter_fit(rows, rounds, tmp_path):
    whole = trees.train_gbt(rows, FEATURES, **SMALL)
    short = trees.train_gbt(rows, FEATURES, **{**SMALL, "maxIter": rounds})
    cut = trees.prefix(whole, rounds)
    assert trees.tree_count(cut) == rounds and _probabilities(cut, rows) == _probabilities(short, rows)
    trees.save_model(cut, str(tmp_path / "m"))
    assert _probabilities(trees.load_model(str(tmp_path / "m")), rows) == _probabilities(short, rows)
    gains = [{r.feature: r.importance for r in trees.feature_importance(m, FEATURES).collect()} for m in (cut, short)]
    assert gains[0] == pytest.approx(gains[1])


def test_early_stopping_fits_once(rows, monkeypatch):
    fits = []
    plain = trees.Pipeline.fit
    monkeypatch.setattr(trees.Pipeline, "fit", lambda self, df: fits.append(1) or plain(self, df))
    model = trees.train_gbt(rows, FEATURES, split="split", patience=2, maxIter=15, maxDepth=4, stepSize=0.5)
    assert fits == [1]
    n = trees.tree_count(model)
    assert 0 < n < 15
    short = trees.train_gbt(rows.filter("split = 'train'"), FEATURES, maxIter=n, maxDepth=4, stepSize=0.5)
    assert _probabilities(model, rows) == _probabilities(short, rows)


def test_focal_model_does_every_job(rows, tmp_path):
    model = trees.train_gbt(rows, FEATURES, split="split", focal=(0.4, 1.5), maxIter=8, maxDepth=3, minInstancesPerNode=5, stepSize=0.4)
    assert trees.tree_count(model) == int(np.argmin(model.valid_loss)) + 1
    trees.save_model(model, str(tmp_path / "m"))
    assert _probabilities(trees.load_model(str(tmp_path / "m")), rows) == _probabilities(model, rows)
    assert [r.feature for r in trees.feature_importance(model, FEATURES).collect()]
    hot, _ = trees.leaf_one_hot(model, rows)
    ones = hot.select(F.aggregate(vector_to_array("leaf_features"), F.lit(0.0), lambda s, v: s + v).alias("n")).distinct().collect()
    assert [r.n for r in ones] == [float(trees.tree_count(model))]
    encoder, regression = trees.leaf_regression(model, rows, maxIter=5)
    scored = trees.score_leaf_regression(model, encoder, regression, rows)
    assert scored.filter("prob BETWEEN 0 AND 1").count() == rows.count()
