"""Quality of alerts and scores, each from one or two aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators import ordering
from panelspark.operators.label import in_failed_disks


def _ratio(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def alert_f1(df: DataFrame, strict_pair: bool = False) -> DataFrame:
    """Precision, recall and F1 of alerts; all 0 where one of them is undefined.

    Precision: alerts with ``tag`` = 1 among alerts. Recall: alerts on failed disks (model and serial
    looked up apart unless ``strict_pair``) per failure-day row.
    """
    alerts = df.filter(F.col("pred") == 1)
    failed = df.filter(F.col("flag") == 1)
    caught = in_failed_disks(alerts, failed, strict_pair).agg(F.count(F.lit(1)).alias("n"))
    counts = df.agg(
        F.count_if(F.col("pred") == 1).alias("alerts"),
        F.count_if((F.col("pred") == 1) & (F.col("tag") == 1)).alias("correct"),
        F.count_if(F.col("flag") == 1).alias("fault_days"),
    ).withColumn("caught", caught.scalar())
    p, r = F.try_divide("correct", "alerts"), F.try_divide("caught", "fault_days")
    f1 = F.try_divide(2 * p * r, p + r)
    defined = f1.isNotNull()
    return counts.select(
        F.when(defined, p).otherwise(0.0).alias("precision"),
        F.when(defined, r).otherwise(0.0).alias("recall"),
        F.when(defined, f1).otherwise(0.0).alias("f1"),
    )


def accuracy(df: DataFrame, label: str = "tag", pred: str = "pred") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("int")).alias("accuracy"))


def confusion_matrix(df: DataFrame, label: str = "tag", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str = "tag", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, and their plain and support-weighted means."""
    cells = confusion_matrix(df, label, pred)
    sides = cells.select(F.col("label").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")).unionByName(
        cells.select(F.col("pred").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit"))
    )
    sums = sides.groupBy("c").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    p, r = _ratio("hit", "called"), _ratio("hit", "support")
    per_class = sums.select(
        F.col("c").cast("string").alias("class"), p.alias("precision"), r.alias("recall"),
        _ratio(2 * p * r, p + r).alias("f1"), "support",
    )
    names = ["precision", "recall", "f1"]
    plain = per_class.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = per_class.agg(
        *[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names],
        F.sum("support").alias("support"),
    )
    return per_class.unionByName(plain.withColumn("class", F.lit("macro avg"))).unionByName(
        weighted.withColumn("class", F.lit("weighted avg"))
    )


def auc(df: DataFrame, score: str = "prob", label: str = "tag", ranges: int | None = None) -> DataFrame:
    """Exact area under the ROC curve, equal scores counting half.

    Each positive counts the negatives below it; scores are folded first and the negatives below a
    score are running totals, so no task orders the whole table.
    """
    scored = df.filter(F.col(score).isNotNull())
    folded = scored.groupBy(score).agg(
        F.count_if(F.col(label) > 0).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    below = ordering.running_totals(folded, [], score, ["neg"], ranges)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return below.agg(F.try_divide(F.try_divide(wins, F.sum("pos")), F.sum("neg")).alias("auc"))
