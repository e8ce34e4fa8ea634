"""Daily ranks, cuts and alerts on a fixed score column."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import combine, rank
from panelspark.registry import query, rounded, scored
from panelspark.session import materialize

KEYS = "serial_number, model, dt, prob"
RANK = "rank() OVER (PARTITION BY dt ORDER BY prob) + (count(*) OVER (PARTITION BY dt, prob) - 1) / 2"


def ranked_cte(quantile: float) -> str:
    return f"""ranked AS (SELECT *, {RANK} AS rank FROM scored),
       cut AS (SELECT *, CAST(rank >= count(*) OVER (PARTITION BY dt) * {quantile} AS INT) AS label FROM ranked)"""


def alerts_cte(quantile: float, cap: int) -> str:
    return ranked_cte(quantile) + f""",
       alerts AS (SELECT * FROM cut WHERE label = 1
                  QUALIFY row_number() OVER (PARTITION BY dt ORDER BY prob DESC, model, serial_number) <= {cap})"""


def first_cte(quantile: float, cap: int) -> str:
    return alerts_cte(quantile, cap) + """,
       firsts AS (SELECT * FROM alerts QUALIFY row_number() OVER (PARTITION BY model, serial_number ORDER BY dt) = 1)"""


def _slim(spark, sf):
    """Scores written once: the rules below read them more than once."""
    return materialize(scored(spark, sf).select("serial_number", "model", "dt", "prob"), "scored")


@query("daily_avg_rank", f"SELECT serial_number, model, dt, round(prob, 6) AS prob, {RANK} AS rank FROM scored", ("scored",))
def daily_avg_rank(spark, sf):
    return rounded(rank.daily_average_rank(_slim(spark, sf)))


def _cut(q: float):
    def run(spark, sf):
        ranked = rank.daily_average_rank(_slim(spark, sf))
        return rounded(rank.quantile_cut_flag(ranked, q))

    return run


for _name, _q in (("quantile_cut_flag", 0.996), ("quantile_cut_flag_90", 0.9)):
    query(_name, f"WITH {ranked_cte(_q)} SELECT serial_number, model, dt, round(prob, 6) AS prob, rank, label FROM cut", ("scored",))(_cut(_q))


def _alerts(q: float, cap: int):
    def run(spark, sf):
        return rounded(rank.daily_alerts(_slim(spark, sf), quantile=q, per_day=cap))

    return run


def _score_daily(q: float, cap: int):
    def run(spark, sf):
        return rank.submission(rank.daily_alerts(_slim(spark, sf), quantile=q, per_day=cap))

    return run


for _suffix, _q, _cap in (("", 0.996, 40), ("_90_3", 0.9, 3)):
    query(
        f"topk_per_day{_suffix}",
        f"WITH {alerts_cte(_q, _cap)} SELECT serial_number, model, dt, round(prob, 6) AS prob, rank FROM alerts",
        ("scored",),
    )(_alerts(_q, _cap))
    query(
        f"score_daily{_suffix}",
        f"WITH {first_cte(_q, _cap)} SELECT 'A' AS manufacturer, model, serial_number, dt FROM firsts",
        ("scored",),
    )(_score_daily(_q, _cap))


@query(
    "first_alert_per_disk",
    f"WITH {first_cte(0.9, 10)} SELECT serial_number, model, dt, round(prob, 6) AS prob, rank FROM firsts",
    ("scored",),
)
def first_alert_per_disk(spark, sf):
    return rounded(rank.first_alert_per_disk(rank.daily_alerts(_slim(spark, sf), quantile=0.9, per_day=10)))


@query(
    "merge_predictions",
    f"""WITH {first_cte(0.9, 3)} SELECT s.serial_number, s.model, s.dt, s.tag, a.rank, coalesce(a.label, 0) AS pred
       FROM scored s LEFT JOIN firsts a USING (serial_number, model, dt)""",
    ("scored",),
)
def merge_predictions(spark, sf):
    df = materialize(scored(spark, sf).select("serial_number", "model", "dt", "tag", "prob"), "scored")
    alerts = rank.first_alert_per_disk(rank.daily_alerts(df.drop("tag"), quantile=0.9, per_day=3))
    marked = alerts.drop("prob").withColumn("pred", F.lit(1))
    return combine.merge_predictions(df.drop("prob"), marked)
