"""Search side by side with halving, folds read apart, whole fits saved, options of the training job."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelspark import registry
from panelspark.operators import split, trees
from panelspark.plans import training
from panelspark.registry import models
from panelspark.registry.evaluation import FOLD_TRAIN, FOLD_VALID, GAP, TRAIN, VALID
from panelspark.session import materialize

FEW = ["smart_1_normalized", "smart_4raw", "smart_5raw"]


@pytest.fixture(scope="module")
def folds(spark, sf):
    rows = models.rows(spark, sf).select(*models.INDEX, "flag", "tag", *FEW)
    return split.store_folds(split.time_series_folds(rows, FOLD_TRAIN, FOLD_VALID))


def test_halving_plan():
    assert trees.halving_plan(9, 27, 3) == [(9, 3), (3, 9), (1, 27)]
    assert trees.halving_plan(10, 9, 3) == [(10, 1), (4, 3), (2, 9)]
    assert trees.halving_plan(10, 9, None) == [(10, 9)] and trees.halving_plan(1, 9, 3) == [(1, 9)]


def test_a_fit_reads_its_fold_alone(spark, folds):
    one = folds.filter("fold = 1 AND split = 'valid'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan
    read = {r[0] for r in one.select(F.input_file_name()).distinct().collect()}
    assert read and all("/fold=1/split=valid/" in f for f in read)
    assert folds.select(*folds.columns).count() == sum(folds.filter(F.col("fold") == i).count() for i in range(len(FOLD_TRAIN)))


def test_halving_has_the_winner_of_the_full_search(folds):
    space = {"maxDepth": [1, 3], "stepSize": [0.1, 0.5]}
    args = (folds, FEW, [], space, {"maxIter": 4}, 4, 0.9, 10)
    full, _ = trees.cv_search(*args, parallel=1)
    fast, gains = trees.cv_search(*args, halving=2, parallel=4)
    full, fast = full.collect(), fast.collect()
    assert len(full) == len(fast) == 4 and {r.rung for r in full} == {0} and max(r.rung for r in fast) == 2
    assert sum(r.rung == 2 for r in fast) == 1
    tops = {r.params for r in full if r.f1 == full[0].f1}
    assert fast[0].params in tops and fast[0].f1 == full[0].f1
    assert [r.feature for r in gains.collect()][0] in FEW


def test_training_options(spark, sf):
    rows = materialize(models.rows(spark, sf), "rows")
    args = {"amount": 0.5, "gap": GAP, "quantile": 0.9, "per_day": 10, "maxIter": 4, "maxDepth": 2}
    model, quality = training.train(rows, TRAIN, VALID, top_features=2, focal=(0.25, 2.0), minInstancesPerNode=2, **args)
    assert len(model.features) <= 2 and quality.count() == 1
    model, quality = training.train(rows, TRAIN, VALID, space={"stepSize": [0.1, 0.3]}, draws=2, halving=None, **args)
    assert trees.trees_of(model).getOrDefault("stepSize") in (0.1, 0.3) and quality.count() == 1


def test_saved_fit(spark, sf):
    assert registry.QUERIES["saved_fit"](spark, sf).first().asDict() == {"differing": 0, "alerts": True}
