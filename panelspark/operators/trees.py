"""Boosted trees: training with early stopping, search, importance, leaves as features."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from itertools import zip_longest

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.boosting import Boosted, FocalLoss, Params, load_boosted, save_boosted, train_boosted
from panelspark.schema import EARLY_STOP_ROUNDS, MISSING_CATEGORY, MISSING_CONTINUOUS


def with_probability(df: DataFrame, name: str = "prob") -> DataFrame:
    """The probability of the positive class as a plain column."""
    return df.withColumn(name, vector_to_array("probability")[1])


def _assembly(continuous: Sequence[str], category: Sequence[str]) -> list:
    """Missing values filled, then one vector; both are stages, so a saved model carries them."""
    filled = [f"CAST(coalesce(`{c}`, {MISSING_CONTINUOUS}) AS DOUBLE) AS `__f_{c}`" for c in continuous]
    filled += [f"CAST(coalesce(`{c}`, {MISSING_CATEGORY}) AS DOUBLE) AS `__f_{c}`" for c in category]
    return [
        SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__"),
        VectorAssembler(inputCols=[f"__f_{c}" for c in [*continuous, *category]], outputCol="features"),
    ]


def balance_weight(df: DataFrame, label: str = "tag") -> float:
    """Weight of a positive row that makes both classes weigh the same."""
    row = df.agg(F.count_if(F.col(label) > 0).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    return row["n"] / row["p"] if row["p"] else 1.0


def train_gbt(
    df: DataFrame,
    continuous: Sequence[str],
    category: Sequence[str] = (),
    label: str = "tag",
    weight: Column | str | None = None,
    split: str | None = None,
    patience: int = EARLY_STOP_ROUNDS,
    leaves: bool = False,
    seed: int = 42,
    focal: tuple[float, float] | None = None,
    **params,
) -> PipelineModel | Boosted:
    """Fit boosted trees. ``split`` names a column whose ``valid`` rows steer early stopping: all rounds
    are fitted once on the other rows, and the trees up to the round that :func:`early_stop_round` finds
    on the validation losses stay (see :func:`prefix`). ``weight`` is a row weight (see :func:`balance_weight`).

    ``focal`` (alpha and gamma) trains on the focal loss itself, by :mod:`boosting`: the model then is a
    :class:`Boosted`, which the functions of this module and of the scoring plan take too."""
    if focal is not None:
        known = {"maxIter": "rounds", "maxDepth": "depth", "stepSize": "rate", "maxBins": "bins", "minInstancesPerNode": "min_rows"}
        own = Params(**{known.get(k, k): v for k, v in params.items()})
        return train_boosted(df, continuous, category, label, weight, split, FocalLoss(*focal), patience, params=own)
    if split is not None:
        own = {"label": label, "weight": weight, "leaves": leaves, "seed": seed}
        learn = df.filter(~F.col(split).eqNullSafe("valid"))
        model = train_gbt(learn, continuous, category, **own, **params)
        valid = df.filter(F.col(split) == "valid")
        if weight is not None:  # the loss is weighted as in the fit
            valid = valid.withColumn("__weight", F.col(weight) if isinstance(weight, str) else weight)
        losses = loss_by_round(model, valid)
        best, _ = early_stop_round(losses, patience)
        return prefix(model, best) if 0 < best < len(losses) else model
    gbt = GBTClassifier(labelCol=label, featuresCol="features", seed=seed, **params)
    rows = df
    if weight is not None:
        rows = rows.withColumn("__weight", F.col(weight) if isinstance(weight, str) else weight)
        gbt = gbt.setWeightCol("__weight")
    if leaves:
        gbt = gbt.setLeafCol("leaves")
    return Pipeline(stages=[*_assembly(continuous, category), gbt]).fit(rows)


def trees_of(model: PipelineModel) -> GBTClassificationModel:
    return next(s for s in model.stages if isinstance(s, GBTClassificationModel))


def tree_count(model: PipelineModel | Boosted) -> int:
    return len(model.trees) if isinstance(model, Boosted) else trees_of(model).getNumTrees


def prefix(model: PipelineModel | Boosted, rounds: int) -> PipelineModel | Boosted:
    """The first ``rounds`` trees as a model: boosting is greedy, so it is the fit of that many rounds."""
    if isinstance(model, Boosted):
        return model.prefix(rounds)
    whole = trees_of(model)
    own = whole._java_obj
    jvm = SparkContext._active_spark_context._gateway
    kept = jvm.new_array(jvm.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = jvm.new_array(jvm.jvm.double, rounds)
    for i in range(rounds):
        kept[i], weights[i] = own.trees()[i], own.treeWeights()[i]
    short = jvm.jvm.org.apache.spark.ml.classification.GBTClassificationModel(own.uid(), kept, weights)
    stage = GBTClassificationModel(short)
    whole._copyValues(stage)
    return PipelineModel([stage if s is whole else s for s in model.stages])


def loss_by_round(model: PipelineModel, df: DataFrame) -> list[float]:
    """Loss on ``df`` after each tree (a :class:`Boosted` knows those of its fit)."""
    if isinstance(model, Boosted):
        return model.valid_loss
    rows = df
    for stage in model.stages[:-1]:
        rows = stage.transform(rows)
    return trees_of(model).evaluateEachIteration(rows)


def early_stop_round(losses: Sequence[float], patience: int = EARLY_STOP_ROUNDS) -> tuple[int, float]:
    """Best round (from 1) and its loss, looking no further than ``patience`` rounds without gain."""
    best, at = float("inf"), 0
    for i, value in enumerate(losses, start=1):
        if value < best:
            best, at = value, i
        elif i - at >= patience:
            break
    return at, best


def feature_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """``(feature, importance)``, highest first. One row per feature."""
    own = isinstance(model, Boosted)
    gain = [model.importance[f] for f in features] if own else trees_of(model).featureImportances.toArray()
    spark = _session()
    rows = [(f, float(g)) for f, g in zip_longest(features, gain, fillvalue=0.0)]  # a prefix ends at its last used one
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def mean_importance(tables: Sequence[DataFrame]) -> DataFrame:
    """Importance averaged over several models."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature")


def select_topk_features(importance: DataFrame, k: int) -> list[str]:
    return [r["feature"] for r in importance.orderBy(F.desc("importance"), "feature").limit(k).collect()]


def _session():
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


# --- search ----------------------------------------------------------------------------------


def random_params(space: Mapping[str, object], fixed: Mapping[str, object], rounds: int, seed: int) -> list[dict]:
    """Parameter rows: a list is drawn from, a pair of numbers gives a uniform draw between them."""
    rng = random.Random(seed)
    rows = []
    for _ in range(rounds):
        drawn = {k: rng.uniform(*v) if isinstance(v, tuple) else rng.choice(v) for k, v in space.items()}
        rows.append({**fixed, **drawn})
    return rows


def halving_plan(draws: int, rounds: int, halving: int | None) -> list[tuple[int, int]]:
    """``(draws, rounds)`` of each rung: with ``halving`` h, each rung keeps one draw in h of the rung before and
    grows h times the trees, up to ``rounds``. Without it one rung has all draws in full."""
    if not halving or halving < 2 or draws <= 1:
        return [(draws, rounds)]
    kept = [draws]
    while kept[-1] > 1 and rounds // halving ** len(kept) >= 1:
        kept.append(-(-kept[-1] // halving))
    return [(n, max(1, rounds // halving ** (len(kept) - 1 - i))) for i, n in enumerate(kept)]


def _side_by_side(spark: SparkSession, jobs: Sequence, parallel: int) -> list:
    """Results of the calls in their order; each job has a pool of its own, so that under a fair scheduler a long
    fit does not hold up the others."""

    def run(n: int):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{n % parallel}")
        return jobs[n]()

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), range(len(jobs))))


def cv_search(
    folds: DataFrame,
    continuous: Sequence[str],
    category: Sequence[str],
    space: Mapping[str, object],
    fixed: Mapping[str, object],
    rounds: int,
    quantile: float,
    per_day: int,
    seed: int = 42,
    label: str = "tag",
    halving: int | None = None,
    parallel: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Random search over rows with ``fold`` and ``split``: results by mean alert F1, and importance
    averaged over all fits. One fold makes it a plain hold-out search.

    ``rounds`` parameter rows are drawn. ``parallel`` fits run at a time. With ``halving`` weak rows
    stop early (see :func:`halving_plan`); ``rung`` tells how far a row came, and only rows of the last rung
    have grown all their trees. A drawn or fixed ``focal`` trains on the focal loss.

    Each fit reads the rows of its fold alone if the table is stored by fold (:func:`split.store_folds`).
    """
    from panelspark.plans.scoring import evaluate_daily

    spark = folds.sparkSession
    numbers = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    drawn = dict(enumerate(random_params(space, fixed, rounds, seed)))
    gains: list[DataFrame] = []
    results: dict[int, tuple] = {}

    def fit(params: dict, n: int, share: float):
        own = {**params, "maxIter": max(1, round(params.get("maxIter", 20) * share))}
        fold = folds.filter(F.col("fold") == n)
        model = train_gbt(fold, continuous, category, label, split="split", seed=seed, **own)
        scored = with_probability(model.transform(fold.filter(F.col("split") == "valid")))
        quality = evaluate_daily(scored, "prob", quantile, per_day).first()
        gains.append(feature_importance(model, [*continuous, *category]))
        return tree_count(model), quality["precision"], quality["recall"], quality["f1"]

    alive, most = list(drawn), max([p.get("maxIter", 20) for p in drawn.values()], default=1)
    for rung, (kept, trees) in enumerate(halving_plan(rounds, most, halving)):
        alive = sorted(alive, key=lambda i: (-results[i][-1] if i in results else 0, i))[:kept]
        jobs = [(i, n) for i in alive for n in numbers]
        told = _side_by_side(spark, [partial(fit, drawn[i], n, trees / most) for i, n in jobs], parallel)
        for i in alive:
            own = [t for (j, _), t in zip(jobs, told, strict=True) if j == i]
            means = [sum(v or 0.0 for v in column) / len(own) for column in zip(*own, strict=True)]
            results[i] = (i, rung, str(sorted(drawn[i].items())), *map(float, means))
    table = spark.createDataFrame(list(results.values()), "round int, rung int, params string, trees double, precision double, recall double, f1 double")
    return table.orderBy(F.desc("rung"), F.desc("f1"), "round"), mean_importance(gains)


# --- leaves ----------------------------------------------------------------------------------


def _with_leaves(model: PipelineModel | Boosted, df: DataFrame) -> DataFrame:
    return model.transform(df, leaves=True) if isinstance(model, Boosted) else model.transform(df)


def leaf_columns(df: DataFrame, trees: int) -> DataFrame:
    """The leaf reached in each tree as columns ``leaf_0 …``."""
    leaves = vector_to_array("leaves")
    return df.withColumns({f"leaf_{i}": leaves[i] for i in range(trees)})


def leaf_encoder(trees: int) -> Pipeline:
    """One-hot block per tree, assembled to one sparse vector; each tree has its own offset."""
    names = [f"leaf_{i}" for i in range(trees)]
    blocks = [f"{n}_hot" for n in names]
    hot = OneHotEncoder(inputCols=names, outputCols=blocks, dropLast=False, handleInvalid="keep")
    return Pipeline(stages=[hot, VectorAssembler(inputCols=blocks, outputCol="leaf_features")])


def leaf_one_hot(model: PipelineModel, df: DataFrame) -> tuple[DataFrame, PipelineModel]:
    """Rows with the sparse one-hot vector of their leaves, and the fitted encoder."""
    trees = tree_count(model)
    rows = leaf_columns(_with_leaves(model, df), trees)
    encoder = leaf_encoder(trees).fit(rows)
    return encoder.transform(rows), encoder


def leaf_regression(model: PipelineModel, df: DataFrame, label: str = "tag", **params):
    """Logistic regression on the leaves of fitted trees: ``(encoder, regression)``."""
    rows, encoder = leaf_one_hot(model, df)
    slim = rows.select(label, "leaf_features")
    return encoder, LogisticRegression(labelCol=label, featuresCol="leaf_features", **params).fit(slim)


def score_leaf_regression(model: PipelineModel, encoder: PipelineModel, regression, df: DataFrame) -> DataFrame:
    rows = encoder.transform(leaf_columns(_with_leaves(model, df), tree_count(model)))
    scored = regression.transform(rows.drop("probability", "rawPrediction", "prediction"))
    return with_probability(scored).select(*df.columns, "prob")


def save_model(model: PipelineModel | Boosted, path: str) -> None:
    if isinstance(model, Boosted):
        save_boosted(_session(), model, path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | Boosted:
    """What :func:`save_model` wrote, of either kind."""
    folder = _session().sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    pipeline = folder.getFileSystem(_session().sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return PipelineModel.load(path) if pipeline else load_boosted(_session(), path)
