"""Scoring jobs: alerts from a score column, and their quality on labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import combine, metrics, rank
from panelspark.operators.encode import log_scale
from panelspark.schema import ALERT_QUANTILE, ALERTS_PER_DAY
from panelspark.session import materialize


def evaluate_daily(df: DataFrame, score: str = "prob", quantile: float = ALERT_QUANTILE, per_day: int = ALERTS_PER_DAY) -> DataFrame:
    """Accuracy, number of alerts, precision, recall and F1 of the first alert per disk.

    ``df`` holds index columns, ``tag`` (0/1), ``flag`` and the score. The few columns needed are
    written once, so that the model behind the score runs once, and so are the rows with their alerts.
    """
    keys = ["serial_number", "model", "dt"]
    slim = materialize(df.select(*keys, "tag", "flag", score), "scored")
    alerts = rank.first_alert_per_disk(rank.daily_alerts(slim.select(*keys, score), score, quantile, per_day))
    marked = alerts.select(*keys, F.lit(1).alias("pred"))
    rows = materialize(combine.merge_predictions(slim.drop(score), marked, keys), "evaluated")
    counted = metrics.accuracy(rows).withColumn("alerts", rows.agg(F.count_if(F.col("pred") == 1).alias("n")).scalar())
    f1 = metrics.alert_f1(rows).select(F.struct("precision", "recall", "f1").alias("s")).scalar()
    return counted.withColumn("s", f1).select("accuracy", "alerts", "s.precision", "s.recall", "s.f1")


def predict_alerts(features: DataFrame, model, use_log: list[str] | None = None, **cut) -> DataFrame:
    """Score every row with a fitted model and return the result file's rows.

    ``use_log`` names the columns the model saw on a logarithmic scale. Scores are written once, as
    finding the alerts reads them twice.
    """
    from panelspark.operators.trees import with_probability

    rows = log_scale(features, use_log) if use_log else features
    scored = with_probability(model.transform(rows)).select("serial_number", "model", "dt", "prob")
    return rank.submission(rank.daily_alerts(materialize(scored, "scored"), **cut))
