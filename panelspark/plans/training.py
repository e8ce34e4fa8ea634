"""Training job: sample, split, scale, fit, evaluate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import neighbours, sampling, split, trees
from panelspark.operators.boosting import Boosted
from panelspark.plans.scoring import evaluate_daily
from panelspark.schema import ALERT_QUANTILE, ALERTS_PER_DAY, column_roles
from panelspark.session import materialize


def train(
    features: DataFrame,
    train_span: tuple[str, str],
    valid_span: tuple[str, str],
    amount: float,
    method: str | None = "month",
    valid_amount: float | None = None,
    gap: tuple[str, str] | None = None,
    prior_before: str | None = None,
    train_model: int | None = None,
    valid_model: int | None = None,
    log: Sequence[str] = (),
    drop: Sequence[str] = (),
    balance: bool = False,
    upsample: bool = False,
    quantile: float = ALERT_QUANTILE,
    per_day: int = ALERTS_PER_DAY,
    seed: int = 42,
    focal: tuple[float, float] | None = None,
    space: Mapping[str, object] | None = None,
    draws: int = 10,
    halving: int | None = 3,
    top_features: int | None = None,
    **params,
) -> tuple[PipelineModel | Boosted, DataFrame]:
    """Fitted model and its quality on the validation span.

    ``log`` names columns to put on a logarithmic scale, ``balance`` weighs both classes alike and
    ``upsample`` adds synthetic faulty rows instead. ``focal`` trains on the focal loss. ``space`` is
    searched first, by ``draws`` parameter rows (see :func:`trees.cv_search`), and the best row taken;
    ``top_features`` then fits once more on so many features of greatest importance.
    """
    sampled = sampling.sampling_plan(
        features.drop(*drop), train_span, amount, method, valid_span, valid_amount, gap, prior_before, seed
    )
    parts = split.gap_time_split(sampled, train_span, valid_span, gap, prior_before, train_model, valid_model)
    if log:
        parts = split.scale_train_valid(parts, list(log), log=True, standard=False)
    parts = materialize(parts, "training")
    roles = column_roles(parts.drop("split"))
    weight = None
    if balance:
        weight = F.when(F.col("tag") == 1, F.lit(trees.balance_weight(parts.filter("split = 'train'")))).otherwise(1.0)
    rows = parts.select("split", "tag", *roles.features)
    if upsample:
        keyed = parts.filter("split = 'train'").withColumn("__key", F.concat_ws("|", "serial_number", "model", "dt"))
        made = neighbours.smote_balance(keyed, "__key", roles.continuous, roles.category, seed=seed)
        both = made.drop("synthetic").withColumn("split", F.lit("train"))
        rows = materialize(both.unionByName(rows.filter("split = 'valid'")), "upsampled")
    if focal is not None:
        params = {**params, "focal": focal}
    if space is not None:
        keyed = parts.select("serial_number", "model", "dt", "flag", "tag", "split", *roles.features).withColumn("fold", F.lit(0))
        found, _ = trees.cv_search(split.store_folds(keyed), roles.continuous, roles.category, space, params, draws, quantile, per_day, seed, halving=halving)
        params = trees.random_params(space, params, draws, seed)[found.first()["round"]]
    continuous, category = roles.continuous, roles.category
    for last in ([False, True] if top_features is not None else [True]):
        model = trees.train_gbt(rows, continuous, category, weight=weight, split="split", seed=seed, **params)
        if not last:
            best = set(trees.select_topk_features(trees.feature_importance(model, [*continuous, *category]), top_features))
            continuous, category = ([c for c in own if c in best] for own in (continuous, category))
    scored = trees.with_probability(model.transform(parts.filter("split = 'valid'")))
    return model, evaluate_daily(scored, "prob", quantile, per_day)
