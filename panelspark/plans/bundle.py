"""A whole fit in one folder: sensors, bins, scales, columns and model, enough to predict by itself."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from panelspark.operators import trees
from panelspark.operators.boosting import Boosted
from panelspark.plans.features import FittedFeatures, prediction_features
from panelspark.plans.scoring import predict_alerts


@dataclass
class Fit:
    """``features`` as :func:`training_features` fitted them, the model, the columns it reads, and those of
    them that it saw on a logarithmic scale."""

    features: FittedFeatures
    model: PipelineModel | Boosted
    continuous: list[str]
    category: list[str]
    log: list[str]
    window: int = 7

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the fit below ``path``; an older one there is replaced."""
        told = {"features": asdict(self.features), "continuous": self.continuous, "category": self.category, "log": self.log, "window": self.window}
        trees.save_model(self.model, f"{path}/model")
        spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/columns")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Fit:
        told = json.loads(spark.read.text(f"{path}/columns", wholetext=True).first()["value"])
        return Fit(**{**told, "features": FittedFeatures(**told["features"])}, model=trees.load_model(f"{path}/model"))

    def predict(self, panel: DataFrame, start: str, end: str, fixed_bins: bool = True, **cut) -> DataFrame:
        """The result file's rows for the days from ``start`` to ``end`` of a raw panel; earlier days feed the windows."""
        made = prediction_features(panel, self.features, start, end, self.window, fixed_bins=fixed_bins)
        absent = [c for c in self.columns if c not in made.columns]
        if absent:
            raise KeyError(f"the panel does not give the columns of the fit: {absent}")
        return predict_alerts(made, self.model, self.log, **cut)

    @property
    def columns(self) -> Sequence[str]:
        return [*self.continuous, *self.category]
