"""Splits and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import combine, metrics, rank, split
from panelspark.registry import labelled, query, rounded, scored
from panelspark.registry.ranking import first_cte
from panelspark.session import materialize

Q, CAP = 0.9, 10
TRAIN, GAP, VALID = ("2024-01-04", "2024-01-14"), ("2024-01-15", "2024-01-19"), ("2024-01-20", "2024-01-30")
PRIOR = "2024-01-04"


def evaluated(spark, sf):
    """Scored rows with a 0/1 ``tag`` and the alerts joined back."""
    df = scored(spark, sf).select("serial_number", "model", "dt", "flag", "prob", (F.col("tag") > 0).cast("int").alias("tag"))
    df = materialize(df, "scored")
    alerts = rank.first_alert_per_disk(rank.daily_alerts(df.select("serial_number", "model", "dt", "prob"), quantile=Q, per_day=CAP))
    return materialize(combine.merge_predictions(df, alerts.drop("prob").withColumn("pred", F.lit(1))), "evaluated")


EVAL = first_cte(Q, CAP) + """,
  e AS (SELECT s.serial_number, s.model, s.dt, s.flag, s.prob, CAST(s.tag > 0 AS INT) AS tag, coalesce(a.label, 0) AS pred
        FROM scored s LEFT JOIN firsts a USING (serial_number, model, dt))"""

F1_SQL = """c AS (SELECT count(*) FILTER (WHERE pred = 1) AS alerts, count(*) FILTER (WHERE pred = 1 AND tag = 1) AS correct,
        count(*) FILTER (WHERE flag = 1) AS fault_days,
        count(*) FILTER (WHERE pred = 1 AND model IN (SELECT model FROM e WHERE flag = 1)
                         AND serial_number IN (SELECT serial_number FROM e WHERE flag = 1)) AS caught FROM e),
  f AS (SELECT correct / alerts AS p, caught / fault_days AS r FROM c)
  SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM f"""


@query("alert_f1", f"WITH {EVAL}, {F1_SQL}", ("scored",))
def alert_f1(spark, sf):
    return rounded(metrics.alert_f1(evaluated(spark, sf)))


@query("accuracy", f"WITH {EVAL} SELECT round(avg(CAST(tag = pred AS INT)), 6) AS accuracy FROM e", ("scored",))
def accuracy(spark, sf):
    return rounded(metrics.accuracy(evaluated(spark, sf)))


@query("confusion_matrix", f"WITH {EVAL} SELECT tag AS label, pred, count(*) AS n FROM e GROUP BY 1, 2", ("scored",))
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(evaluated(spark, sf))


@query(
    "classification_report",
    f"""WITH {EVAL}, k AS (SELECT DISTINCT tag AS c FROM e UNION SELECT DISTINCT pred FROM e),
       s AS (SELECT c, (SELECT count(*) FROM e WHERE tag = c AND pred = c) AS hit, (SELECT count(*) FROM e WHERE pred = c) AS called,
             (SELECT count(*) FROM e WHERE tag = c) AS support FROM k),
       m AS (SELECT c, support, coalesce(hit / nullif(called, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r FROM s),
       f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM m)
       SELECT CAST(c AS VARCHAR) AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM f
       UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
       UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
         round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""",
    ("scored",),
)
def classification_report(spark, sf):
    return rounded(metrics.classification_report(evaluated(spark, sf)))


@query(
    "auc",
    """WITH r AS (SELECT tag > 0 AS hit, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2 AS rank FROM scored)
       SELECT round((sum(rank) FILTER (WHERE hit) - count(*) FILTER (WHERE hit) * (count(*) FILTER (WHERE hit) + 1) / 2)
         / count(*) FILTER (WHERE hit) / count(*) FILTER (WHERE NOT hit), 6) AS auc FROM r""",
    ("scored",),
)
def auc(spark, sf):
    return rounded(metrics.auc(scored(spark, sf)))


@query(
    "eval_daily",
    f"""WITH {EVAL}, {F1_SQL.replace("SELECT round(p, 6)", "SELECT (SELECT round(avg(CAST(tag = pred AS INT)), 6) FROM e) AS accuracy, (SELECT count(*) FROM e WHERE pred = 1) AS alerts, round(p, 6)")}""",
    ("scored",),
)
def eval_daily(spark, sf):
    from panelspark.plans.scoring import evaluate_daily

    df = scored(spark, sf).withColumn("tag", (F.col("tag") > 0).cast("int"))
    return rounded(evaluate_daily(df, quantile=Q, per_day=CAP))


_BASE = "base AS (SELECT serial_number, model, dt, flag, CAST(tag > 0 AS INT) AS tag, smart_1_normalized FROM labelled)"
GAP_ROWS = f"""(SELECT * FROM base WHERE dt BETWEEN DATE '{GAP[0]}' AND DATE '{GAP[1]}' AND tag = 1
   AND model IN (SELECT model FROM base WHERE flag = 1 AND dt BETWEEN DATE '{GAP[0]}' AND DATE '{GAP[1]}')
   AND serial_number IN (SELECT serial_number FROM base WHERE flag = 1 AND dt BETWEEN DATE '{GAP[0]}' AND DATE '{GAP[1]}'))"""


def base(spark, sf):
    return labelled(spark, sf).select(
        "serial_number", "model", "dt", "flag", (F.col("tag") > 0).cast("int").alias("tag"), "smart_1_normalized"
    )


@query(
    "gap_time_split",
    f"""WITH {_BASE} SELECT *, 'train' AS split FROM base WHERE dt BETWEEN DATE '{TRAIN[0]}' AND DATE '{TRAIN[1]}'
       UNION ALL SELECT *, 'train' FROM base WHERE dt < DATE '{PRIOR}' AND tag = 1
       UNION ALL SELECT *, 'train' FROM {GAP_ROWS}
       UNION ALL SELECT *, 'valid' FROM base WHERE dt BETWEEN DATE '{VALID[0]}' AND DATE '{VALID[1]}' AND model = 1""",
    ("labelled",),
)
def gap_time_split(spark, sf):
    return split.gap_time_split(materialize(base(spark, sf), "panel"), TRAIN, VALID, GAP, PRIOR, valid_model=1)


FOLD_TRAIN = [("2024-01-01", "2024-01-10"), ("2024-01-06", "2024-01-15"), ("2024-01-11", "2024-01-20")]
FOLD_VALID = [("2024-01-16", "2024-01-20"), ("2024-01-21", "2024-01-25"), ("2024-01-26", "2024-01-30")]


@query(
    "time_series_folds",
    " UNION ALL ".join(
        f"""SELECT {i} AS fold, '{name}' AS split, count(*) AS n, count(*) FILTER (WHERE tag > 0) AS faulty FROM labelled
            WHERE dt BETWEEN DATE '{s[0]}' AND DATE '{s[1]}'"""
        for i in range(3) for name, s in (("train", FOLD_TRAIN[i]), ("valid", FOLD_VALID[i]))
    ),
    ("labelled",),
)
def time_series_folds(spark, sf):
    rows = split.time_series_folds(labelled(spark, sf).select("dt", "tag"), FOLD_TRAIN, FOLD_VALID)
    return rows.groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tag") > 0).alias("faulty"))


@query(
    "scale_train_valid",
    f"""WITH b AS (SELECT serial_number, model, dt, log2(smart_4raw + 1) AS x, log2(smart_9raw + 1) AS y,
         CASE WHEN dt BETWEEN DATE '{TRAIN[0]}' AND DATE '{TRAIN[1]}' THEN 'train' ELSE 'valid' END AS split FROM labelled
         WHERE dt BETWEEN DATE '{TRAIN[0]}' AND DATE '{TRAIN[1]}' OR dt BETWEEN DATE '{VALID[0]}' AND DATE '{VALID[1]}'),
       s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM b WHERE split = 'train')
       SELECT serial_number, model, dt, split, round((x - mx) / sx, 6) + 0.0 AS smart_4raw, round((y - my) / sy, 6) + 0.0 AS smart_9raw
       FROM b CROSS JOIN s""",
    ("labelled",),
)
def scale_train_valid(spark, sf):
    df = labelled(spark, sf).select("serial_number", "model", "dt", "smart_4raw", "smart_9raw")
    both = split.gap_time_split(df, TRAIN, VALID)
    return rounded(split.scale_train_valid(both, ["smart_4raw", "smart_9raw"], log=True))
