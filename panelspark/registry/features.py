"""Labels, calendar and rolling features."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import schema as S
from panelspark.operators import calendar, label, rolling
from panelspark.registry import dense, fault_log, labelled, panel, powered, query, r6, rounded
from panelspark.plans import features as plan
from panelspark.schema import POWER_ON_HOURS

SLIDING = [c for c in S.SENSORS if c not in S.NON_SLIDING_SENSORS]
FRAME = "OVER (PARTITION BY model, serial_number ORDER BY day ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
W7 = FRAME.format(n=6)


def _sql7(expr: str) -> str:
    """One expression per sliding column over the last seven calendar days, on observed days."""
    cols = ", ".join(expr.format(c=c, w=W7) for c in SLIDING)
    return f"SELECT * EXCLUDE (observed) FROM (SELECT serial_number, model, day AS dt, observed, {cols} FROM dense) WHERE observed"


def _rolling(spark, sf, made):
    df = dense(spark, sf, *SLIDING)
    out = df.select("serial_number", "model", "dt", "observed", *made)
    return rounded(calendar.observed_days(out))


def _label_sql(low: str, h: int) -> str:
    return f"""SELECT serial_number, model, dt,
 CAST(CASE WHEN {low} AND d <= {h} THEN fault_tag + 1 ELSE 0 END AS TINYINT) AS tag,
 CAST(CASE WHEN d = 0 THEN 1 ELSE 0 END AS TINYINT) AS flag,
 CAST(CASE WHEN d = {h} THEN 1 ELSE 0 END AS TINYINT) AS "30_day"
FROM (SELECT p.*, f.fault_tag, date_diff('day', p.dt, f.fault_time) AS d
      FROM panel p LEFT JOIN first_fault f USING (manufacturer, model, serial_number))"""


_LABELS = ["serial_number", "model", "dt", "tag", "flag", "30_day"]


@query("label_prefail_window", _label_sql("d >= 0", 30), ("panel", "first_fault"))
def label_prefail_window(spark, sf):
    return label.label_before_failure(panel(spark, sf), fault_log(spark, sf)).select(*_LABELS)


@query("label_prefail_window_7", _label_sql("d >= 0", 7), ("panel", "first_fault"))
def label_prefail_window_7(spark, sf):
    return labelled(spark, sf).select(*_LABELS)


@query("label_prefail_window_excl", _label_sql("d > 0", 30), ("panel", "first_fault"))
def label_prefail_window_excl(spark, sf):
    out = label.label_before_failure(panel(spark, sf), fault_log(spark, sf), lower_inclusive=False)
    return out.select(*_LABELS)


@query(
    "fault_history_semi",
    """SELECT serial_number, model, dt, tag, flag FROM labelled
       WHERE serial_number IN (SELECT serial_number FROM labelled WHERE flag = 1)
         AND model IN (SELECT model FROM labelled WHERE flag = 1)""",
    ("labelled",),
)
def fault_history_semi(spark, sf):
    return label.failed_disk_history(labelled(spark, sf)).select("serial_number", "model", "dt", "tag", "flag")


@query(
    "fault_history_semi_strict",
    """SELECT serial_number, model, dt, tag, flag FROM labelled
       WHERE (model, serial_number) IN (SELECT (model, serial_number) FROM labelled WHERE flag = 1)""",
    ("labelled",),
)
def fault_history_semi_strict(spark, sf):
    out = label.failed_disk_history(labelled(spark, sf), strict_pair=True)
    return out.select("serial_number", "model", "dt", "tag", "flag")


@query(
    "calendar_asof_fill",
    """SELECT serial_number, model, day AS dt, observed, smart_1_normalized, smart_195_normalized,
              CAST(CASE WHEN observed THEN tag ELSE 0 END AS TINYINT) AS tag FROM dense""",
    ("dense",),
)
def calendar_asof_fill(spark, sf):
    df = powered(spark, sf).select("serial_number", "model", "dt", "smart_1_normalized", "smart_195_normalized", "tag")
    out = calendar.fill_calendar(df, zero_columns=["tag"])
    return out.select("serial_number", "model", "dt", "observed", "smart_1_normalized", "smart_195_normalized", "tag")


@query(
    "restrict_to_observed_days",
    "SELECT serial_number, model, dt, smart_1_normalized, smart_195_normalized FROM powered",
    ("powered",),
)
def restrict_to_observed_days(spark, sf):
    return calendar.observed_days(dense(spark, sf, "smart_1_normalized", "smart_195_normalized"))


@query("rolling_min", _sql7("round(min({c}) {w}, 6) + 0.0 AS {c}_min_7"), ("dense",))
def rolling_min(spark, sf):
    return _rolling(spark, sf, rolling.rolling_stats(SLIDING, 7, ["min"]))


@query("rolling_max", _sql7("round(max({c}) {w}, 6) + 0.0 AS {c}_max_7"), ("dense",))
def rolling_max(spark, sf):
    return _rolling(spark, sf, rolling.rolling_stats(SLIDING, 7, ["max"]))


@query("rolling_std", _sql7("round(stddev_samp({c}) {w}, 6) + 0.0 AS {c}_std_7"), ("dense",))
def rolling_std(spark, sf):
    return _rolling(spark, sf, rolling.rolling_stats(SLIDING, 7, ["std"]))


@query("rolling_mean", _sql7("round(avg({c}) {w}, 6) + 0.0 AS {c}_mean_7"), ("dense",))
def rolling_mean(spark, sf):
    return _rolling(spark, sf, rolling.rolling_stats(SLIDING, 7, ["mean"]))


def _wide_window_sql() -> str:
    parts = []
    for n in (7, 14, 49):
        for fn, sql in (("min", "min"), ("max", "max"), ("std", "stddev_samp"), ("mean", "avg")):
            parts.append(f"round({sql}(smart_1_normalized) {FRAME.format(n=n - 1)}, 6) + 0.0 AS smart_1_normalized_{fn}_{n}")
    return (
        f"SELECT * EXCLUDE (observed) FROM (SELECT serial_number, model, day AS dt, observed, {', '.join(parts)} FROM dense)"
        " WHERE observed"
    )


@query("rolling_multi_window", _wide_window_sql(), ("dense",))
def rolling_multi_window(spark, sf):
    df = dense(spark, sf, "smart_1_normalized")
    kinds = ("min", "max", "std", "mean")
    cols = [c for n in (7, 14, 49) for c in rolling.rolling_stats(["smart_1_normalized"], n, kinds)]
    return rounded(calendar.observed_days(df.select("serial_number", "model", "dt", "observed", *cols)))


SHAPE = SLIDING


def _shape_sql(kind: str) -> str:
    def expr(c: str) -> str:
        x = f"CASE WHEN rn > 7 THEN {c} END"
        k = f"(CAST(count({x}) {W7} AS DOUBLE))"
        z = f"avg({x}) {W7}"
        # central moments from the raw values of the frame
        vals = f"list({x}) {W7}"
        if kind == "cv":
            return f"round(CASE WHEN avg({x}) {W7} <> 0 THEN stddev_samp({x}) {W7} / ({z}) END, 6) + 0.0 AS {c}_cv_7"
        return f"{vals} AS {c}_v, {k} AS {c}_k"

    if kind == "cv":
        body = ", ".join(expr(c) for c in SHAPE)
        return f"""SELECT * EXCLUDE (observed) FROM (
            SELECT serial_number, model, day AS dt, observed, {body}
            FROM (SELECT *, row_number() OVER (PARTITION BY model, serial_number ORDER BY day) AS rn FROM dense)) WHERE observed"""
    inner = ", ".join(expr(c) for c in SHAPE)
    fn, least = ("skewness", 3) if kind == "skew" else ("kurtosis", 4)
    outs = ", ".join(
        f"""round(CASE WHEN list_count(list_filter({c}_v, lambda v: v IS NOT NULL)) >= {least}
              AND list_var_pop({c}_v) > 1e-14 THEN list_{fn}({c}_v) END, 9) + 0.0 AS {c}_{kind}_7"""
        for c in SHAPE
    )
    return f"""SELECT serial_number, model, dt, {outs} FROM (
        SELECT serial_number, model, day AS dt, observed, {inner}
        FROM (SELECT *, row_number() OVER (PARTITION BY model, serial_number ORDER BY day) AS rn FROM dense)) WHERE observed"""


def _shape(spark, sf, kind):
    df = dense(spark, sf, *SHAPE)
    out = calendar.observed_days(rolling.shape_features(df, SHAPE, 7, [kind]))
    digits = 6 if kind == "cv" else 9  # ratios of small whole numbers often end in a 5 at the seventh digit
    return rounded(out.select("serial_number", "model", "dt", *[f"{c}_{kind}_7" for c in SHAPE]), digits=digits)


@query("rolling_skew", _shape_sql("skew"), ("dense",))
def rolling_skew(spark, sf):
    return _shape(spark, sf, "skew")


@query("rolling_kurt", _shape_sql("kurt"), ("dense",))
def rolling_kurt(spark, sf):
    return _shape(spark, sf, "kurt")


@query("rolling_cv", _shape_sql("cv"), ("dense",))
def rolling_cv(spark, sf):
    return _shape(spark, sf, "cv")


_LAG = "OVER (PARTITION BY model, serial_number ORDER BY day)"


@query(
    "period_diff",
    _sql7("round({c} - lag({c}, 7) " + _LAG + ", 6) + 0.0 AS {c}_diff_for_last_period_7"),
    ("dense",),
)
def period_diff(spark, sf):
    return _rolling(spark, sf, rolling.period_diff(SLIDING, 7))


@query(
    "shift_lag",
    "SELECT * EXCLUDE (observed) FROM (SELECT serial_number, model, day AS dt, observed, "
    + ", ".join(f"lag(smart_1_normalized, {p}) {_LAG} AS smart_1_normalized_diff_with_last_period_{p}" for p in range(1, 8))
    + " FROM dense) WHERE observed",
    ("dense",),
)
def shift_lag(spark, sf):
    df = dense(spark, sf, "smart_1_normalized")
    cols = rolling.shift_lag(["smart_1_normalized"], range(1, 8))
    return calendar.observed_days(df.select("serial_number", "model", "dt", "observed", *cols))


SLOPE_CTE = """
pairs AS (SELECT model, serial_number, smart_5raw AS y, smart_9raw AS h, min(day) AS day FROM dense
          WHERE smart_5raw IS NOT NULL AND smart_9raw IS NOT NULL GROUP BY 1, 2, 3, 4),
slopes AS (SELECT model, serial_number, day, CASE WHEN k = 7 AND v > 0 THEN s END AS slope FROM (
   SELECT model, serial_number, day, count(*) OVER f AS k, var_pop(floor(h / 24)) OVER f AS v,
          (7 * sum(floor(h / 24) * y) OVER f - sum(floor(h / 24)) OVER f * sum(y) OVER f)
          / nullif(7 * sum(floor(h / 24) * floor(h / 24)) OVER f - sum(floor(h / 24)) OVER f * sum(floor(h / 24)) OVER f, 0) AS s
   FROM pairs WINDOW f AS (PARTITION BY model, serial_number ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)))
"""


@query(
    "rolling_slope",
    "WITH " + SLOPE_CTE + """SELECT d.serial_number, d.model, d.day AS dt,
       round(s.slope, 9) + 0.0 AS smart_5raw_slope_for_last_duration_7
       FROM dense d LEFT JOIN slopes s USING (model, serial_number, day) WHERE d.observed""",
    ("dense",),
)
def rolling_slope(spark, sf):
    df = rolling.add_rolling_slope(dense(spark, sf, "smart_5raw", POWER_ON_HOURS), ["smart_5raw"], POWER_ON_HOURS, 7)
    out = calendar.observed_days(df).drop("smart_5raw", POWER_ON_HOURS)
    return rounded(out, digits=9)


@query(
    "forward_fill",
    f"""SELECT serial_number, model, dt, smart_195_normalized FROM (SELECT serial_number, model, day AS dt, observed,
        last_value(smart_195_normalized IGNORE NULLS) OVER (PARTITION BY model, serial_number ORDER BY day
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS smart_195_normalized FROM dense) WHERE observed""",
    ("dense",),
)
def forward_fill(spark, sf):
    return calendar.observed_days(rolling.forward_fill(dense(spark, sf, "smart_195_normalized"), ["smart_195_normalized"]))


@query(
    "last_n_per_disk",
    """SELECT serial_number, model, dt, smart_1_normalized FROM labelled
       WHERE (model, serial_number) IN (SELECT (model, serial_number) FROM labelled WHERE flag = 1)
       QUALIFY row_number() OVER (PARTITION BY model, serial_number ORDER BY dt DESC) <= 14""",
    ("labelled",),
)
def last_n_per_disk(spark, sf):
    failed = label.failed_disk_history(labelled(spark, sf), strict_pair=True)
    return rolling.last_n_per_disk(failed.select("serial_number", "model", "dt", "smart_1_normalized"), 14)


@query(
    "sequence_windows",
    """SELECT model, serial_number, first_dt, dt AS last_dt, tag, 20 AS steps, first_x, last_x, round(total, 6) + 0.0 AS total FROM (
        SELECT model, serial_number, dt, tag, count(*) OVER w AS k, min(dt) OVER w AS first_dt,
               first_value(smart_4raw) OVER w AS first_x, smart_9_normalized AS last_x,
               sum(smart_4raw) OVER w AS total FROM labelled
        WINDOW w AS (PARTITION BY model, serial_number ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE k = 20""",
    ("labelled",),
)
def sequence_windows(spark, sf):
    seq = rolling.sequence_windows(labelled(spark, sf), ["smart_4raw", "smart_9_normalized"], "tag", 20)
    total = F.aggregate("data", F.lit(0.0), lambda a, row: a + F.get(row, F.lit(0)))
    return seq.select(
        "model", "serial_number", "first_dt", "last_dt", "tag",
        F.size("data").alias("steps"),
        F.element_at("data", 1)[0].alias("first_x"),
        F.element_at("data", -1)[1].alias("last_x"),
        r6(total).alias("total"),
    )


# --- the whole feature table ------------------------------------------------------------------

EXTRA = ["smart_10_normalized", "smart_240raw"]  # one constant, one half empty: both get pruned
CONTINUOUS = [c for c in S.SENSORS if c not in S.ZERO_HEAVY_SENSORS] + list(S.COMBINED_SENSORS)
CATEGORIES = ["model_type", *[f"{c}_cate" for c in S.ZERO_HEAVY_SENSORS], "power_on_hours_in_day_unit_cate"]


def _feature_sql(edges: str, where: str = "true", labels: bool = True) -> str:
    """Categories, weighted sums, calendar, windows and forward fill, written out per column.

    ``edges`` is a query of ``e1, e2, e3, low, high``, the bin borders.
    """
    sums = []
    for name, weights in S.COMBINED_SENSORS.items():
        total = "(" + " + ".join(f"{w}::DOUBLE" for w in weights.values()) + ")"
        sums.append("(" + " + ".join(f"{c} * {w}::DOUBLE" for c, w in weights.items()) + f") / {total} AS {name}")
    d = "floor(smart_9raw / 24)"
    cats = ["CAST(CASE model WHEN 1 THEN 0 WHEN 2 THEN 1 END AS INT) AS model_type"]
    cats += [f"CASE WHEN {c} > 0 THEN 1 ELSE 0 END AS {c}_cate" for c in S.ZERO_HEAVY_SENSORS]
    cats.append(
        f"CASE WHEN {d} > low AND {d} <= high THEN CAST({d} > e1 AS INT) + CAST({d} > e2 AS INT) + CAST({d} > e3 AS INT) END"
        " AS power_on_hours_in_day_unit_cate"
    )
    sliding = [c for c in CONTINUOUS if c not in S.NON_SLIDING_SENSORS]
    f = "OVER f"
    made = [f"min({c}) {f} AS {c}_min_7" for c in sliding] + [f"max({c}) {f} AS {c}_max_7" for c in sliding]
    made += [f"stddev_samp({c}) {f} AS {c}_std_7" for c in sliding]
    made += [f"{c} - lag({c}, 7) OVER o AS {c}_diff_for_last_period_7" for c in sliding]
    names = CONTINUOUS + [f"{c}_{k}" for k in ("min_7", "max_7", "std_7", "diff_for_last_period_7") for c in sliding]
    names.append("smart_5raw_slope_for_last_duration_7")
    filled = ", ".join(
        f"round_even(last_value({n} IGNORE NULLS) OVER u * {f}, 0) / {f} + 0.0 AS {n}"
        for n in names
        for f in ["1e9" if "_slope_" in n else "1e6"]
    )
    tags = "CAST(tag > 0 AS TINYINT) AS tag, flag," if labels else ""
    keep = "tag, flag," if labels else ""
    cols = ", ".join(CATEGORIES)
    window = "PARTITION BY model, serial_number ORDER BY day"
    return f"""WITH edges AS ({edges}),
      prep AS (SELECT serial_number, model, dt, {tags} {", ".join(cats)}, * EXCLUDE (serial_number, model, dt, tag, flag), {", ".join(sums)}
               FROM powered CROSS JOIN edges),
      dense AS (SELECT d.day, d.day = p.dt AS observed, p.* FROM days d ASOF JOIN prep p
                ON d.model = p.model AND d.serial_number = p.serial_number AND d.day >= p.dt),
      {SLOPE_CTE},
      wide AS (SELECT dense.*, s.slope AS smart_5raw_slope_for_last_duration_7, {", ".join(made)}
               FROM dense LEFT JOIN slopes s ON s.model = dense.model AND s.serial_number = dense.serial_number AND s.day = dense.day
               WINDOW f AS (PARTITION BY dense.model, dense.serial_number ORDER BY dense.day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
                      o AS (PARTITION BY dense.model, dense.serial_number ORDER BY dense.day)),
      full_rows AS (SELECT serial_number, model, day AS dt, observed, {keep} {cols}, {filled} FROM wide
               WINDOW u AS ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT * EXCLUDE (observed) FROM full_rows WHERE observed AND {where}"""


FITTED_EDGES = """SELECT lo - (hi - lo) * 0.001 AS low, hi AS high, lo + (hi - lo) / 4 AS e1, lo + 2 * ((hi - lo) / 4) AS e2,
   lo + 3 * ((hi - lo) / 4) AS e3 FROM (SELECT min(floor(smart_9raw / 24)) AS lo, max(floor(smart_9raw / 24)) AS hi FROM powered)"""


def _feature_digits(df):
    """Six digits, nine for slopes (see ``_shape``), half-even: plain arithmetic, as decimal rounding of
    this many values would take longer than the features themselves."""
    def digits(n: str):
        f = F.lit(1e9 if "_slope_" in n else 1e6)
        return (F.rint(F.col(n) * f) / f + 0.0).alias(n)

    return df.select(*[digits(n) if t == "double" else F.col(n) for n, t in df.dtypes])


FIXED_EDGES = "SELECT -9999 AS low, 9999 AS high, 452.75 AS e1, 905.5 AS e2, 1358.25 AS e3"


@query("feature_table", _feature_sql(FITTED_EDGES), ("powered", "days"))
def feature_table(spark, sf):
    out, _ = plan.training_features(labelled(spark, sf), [*S.SENSORS, *EXTRA], missing="skip")
    return _feature_digits(out)


@query(
    "prediction_features",
    _feature_sql(FIXED_EDGES, "dt BETWEEN DATE '2024-01-25' AND DATE '2024-01-30'", labels=False),
    ("powered", "days"),
)
def prediction_features(spark, sf):
    fitted = plan.FittedFeatures(list(S.SENSORS), [])
    return _feature_digits(plan.prediction_features(panel(spark, sf), fitted, "2024-01-25", "2024-01-30"))


@query(
    "feature_null_percent",
    _feature_sql(FITTED_EDGES).replace("SELECT * EXCLUDE (observed) FROM full_rows WHERE observed AND true", "")
    + "".join(
        f"{' UNION ALL ' if i else ' '}SELECT '{c}' AS \"column\", round_even(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100, 2) AS null_percent"
        " FROM full_rows WHERE observed"
        for i, c in enumerate(["smart_5raw_slope_for_last_duration_7", "smart_4raw_diff_for_last_period_7", "smart_195_normalized_std_7"])
    ),
    ("powered", "days"),
)
def feature_null_percent(spark, sf):
    from panelspark.operators import clean

    out, _ = plan.training_features(labelled(spark, sf), missing="skip")
    return clean.null_percent(out, ["smart_5raw_slope_for_last_duration_7", "smart_4raw_diff_for_last_period_7", "smart_195_normalized_std_7"])
