"""Scalar functions and encodings over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import schema
from panelspark.functions import scalar
from panelspark.operators import encode, label
from panelspark.registry import fault_log, panel, query, r6, rounded, scored, table

INDEX = ["serial_number", "model", "dt"]


@query(
    "parse_yyyymmdd",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(ts AS DATE) END AS dt FROM events""",
)
def parse_yyyymmdd(spark, sf):
    raw = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "20241399").otherwise(F.date_format("ts", "yyyyMMdd")).alias("dt")
    )
    return raw.select("event_id", scalar.parse_yyyymmdd("dt").alias("dt"))


@query(
    "day_diff",
    """SELECT p.serial_number, p.model, p.dt, CAST(date_diff('day', p.dt, f.fault_time) AS INT) AS days FROM panel p
       JOIN first_fault f USING (manufacturer, model, serial_number)""",
    ("panel", "first_fault"),
)
def day_diff(spark, sf):
    faults = label.first_listed_fault(fault_log(spark, sf))
    rows = panel(spark, sf).join(faults, label.FAULT_KEY)
    return rows.select(*INDEX, scalar.day_diff("fault_time", "dt").alias("days"))


@query(
    "date_parts",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
       CAST(isodow(o_orderdate) - 1 AS INT) AS weekday FROM orders""",
)
def date_parts(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *scalar.year_month_weekday("o_orderdate"))


@query(
    "month_gap",
    """WITH m AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month FROM orders),
       g AS (SELECT *, CAST((1999 - year) * 12 + (1 - month) AS INT) AS gap FROM m),
       r AS (SELECT *, row_number() OVER (ORDER BY gap, year, month) AS up, row_number() OVER (ORDER BY gap DESC, year DESC, month DESC) AS down FROM g)
       SELECT a.year, a.month, a.gap, round(b.gap / (SELECT sum(gap) FROM g), 9) AS weight FROM r a JOIN r b ON a.up = b.down""",
)
def month_gap(spark, sf):
    return rounded(encode.month_weights(table(spark, sf, "orders"), 1999, 1, "o_orderdate"), digits=9)


@query(
    "date_range",
    """SELECT serial_number, model, strftime(day, '%Y%m%d') AS day FROM (SELECT serial_number, model,
       unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS day FROM panel GROUP BY 1, 2)""",
    ("panel",),
)
def date_range(spark, sf):
    spans = panel(spark, sf).groupBy("serial_number", "model").agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    days = spans.select("serial_number", "model", F.explode(scalar.date_range("a", "b")).alias("day"))
    return days.withColumn("day", scalar.compact_date("day"))


@query(
    "split_string",
    """SELECT dt, split_part(serial_number, '_', 1) AS prefix, CAST(split_part(serial_number, '_', 2) AS INT) AS number,
       CAST(split_part(CAST(dt AS VARCHAR), '-', 3) AS INT) AS day, starts_with(serial_number, 'disk_1') AS starts FROM panel""",
    ("panel",),
)
def split_string(spark, sf):
    return panel(spark, sf).select(
        "dt", scalar.name_part("serial_number", "_", 0).alias("prefix"),
        scalar.name_part("serial_number", "_", 1).cast("int").alias("number"),
        scalar.name_part(F.col("dt").cast("string"), "-", 2).cast("int").alias("day"),
        F.startswith("serial_number", F.lit("disk_1")).alias("starts"),
    )


@query(
    "log2p1",
    """SELECT serial_number, model, dt, round(CASE WHEN smart_1_normalized > -1 THEN log2(smart_1_normalized + 1) END, 6) + 0.0 AS x,
       round(log2(smart_4raw + 1), 6) + 0.0 AS y FROM panel""",
    ("panel",),
)
def log2p1(spark, sf):
    return panel(spark, sf).select(*INDEX, r6(scalar.log2p1("smart_1_normalized")).alias("x"), r6(scalar.log2p1("smart_4raw")).alias("y"))


@query(
    "safe_log",
    "SELECT serial_number, model, dt, round(CASE WHEN smart_5raw = 0 THEN 0 ELSE ln(smart_5raw) END, 6) + 0.0 AS x FROM panel",
    ("panel",),
)
def safe_log(spark, sf):
    return panel(spark, sf).select(*INDEX, r6(scalar.safe_log("smart_5raw")).alias("x"))


_SCALED = ["smart_1_normalized", "smart_195_normalized", "smart_10_normalized"]


@query(
    "standard_scale",
    "WITH s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in _SCALED)
    + " FROM panel WHERE dt < DATE '2024-01-20') SELECT serial_number, model, dt, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}" for c in _SCALED)
    + " FROM panel CROSS JOIN s",
    ("panel",),
)
def standard_scale(spark, sf):
    df = panel(spark, sf).select(*INDEX, *_SCALED)
    scaler = encode.fit_scaler(df.filter("dt < DATE '2024-01-20'"), _SCALED)
    return rounded(scaler.apply(df))


@query("power_on_days", "SELECT serial_number, model, dt, floor(smart_9raw / 24) AS days FROM panel", ("panel",))
def power_on_days(spark, sf):
    return panel(spark, sf).select(*INDEX, scalar.power_on_days("smart_9raw").alias("days"))


@query(
    "equal_width_cut",
    """WITH e AS (SELECT min(floor(smart_9raw / 24)) AS lo, (max(floor(smart_9raw / 24)) - min(floor(smart_9raw / 24))) / 4 AS w FROM panel)
       SELECT serial_number, model, dt, CAST(CASE WHEN d > lo + 3 * w THEN 3 WHEN d > lo + 2 * w THEN 2 WHEN d > lo + w THEN 1
       WHEN d IS NOT NULL THEN 0 END AS INT) AS code FROM (SELECT *, floor(smart_9raw / 24) AS d FROM panel) CROSS JOIN e""",
    ("panel",),
)
def equal_width_cut(spark, sf):
    df = panel(spark, sf)
    days = scalar.power_on_days("smart_9raw")
    edges = encode.fit_equal_width(df, days, schema.POWER_ON_DAY_BINS)
    return df.select(*INDEX, scalar.right_closed_cut(days, edges).alias("code"))


@query(
    "fixed_cut",
    """SELECT serial_number, model, dt, CASE WHEN h > -9999 AND h <= 9999 THEN CAST(h > 452.75 AS INT) + CAST(h > 905.5 AS INT)
       + CAST(h > 1358.25 AS INT) END AS code FROM (SELECT *, CASE WHEN smart_9raw > 2000 THEN 10000 ELSE smart_9raw END AS h FROM panel)""",
    ("panel",),
)
def fixed_cut(spark, sf):
    hours = F.when(F.col("smart_9raw") > 2000, 10000.0).otherwise(F.col("smart_9raw"))
    return panel(spark, sf).select(*INDEX, scalar.right_closed_cut(hours, schema.POWER_ON_DAY_EDGES).alias("code"))


@query(
    "gt_zero_flag",
    """SELECT serial_number, model, dt, CASE WHEN smart_197raw > 0 THEN 1 ELSE 0 END AS a, CASE WHEN smart_240raw > 0 THEN 1 ELSE 0 END AS b
       FROM panel""",
    ("panel",),
)
def gt_zero_flag(spark, sf):
    return panel(spark, sf).select(*INDEX, scalar.gt_zero_flag("smart_197raw").alias("a"), scalar.gt_zero_flag("smart_240raw").alias("b"))


@query(
    "map_values",
    """SELECT serial_number, model, dt, CASE model WHEN 1 THEN 0 WHEN 2 THEN 1 END AS model_type,
       CASE smart_199raw WHEN 1 THEN 10 WHEN 2 THEN 20 END AS partial FROM panel""",
    ("panel",),
)
def map_values(spark, sf):
    return panel(spark, sf).select(
        *INDEX, scalar.map_values("model", {1: 0, 2: 1}).alias("model_type"),
        scalar.map_values("smart_199raw", {1: 10, 2: 20}).alias("partial"),
    )


def _weighted_sql() -> str:
    outs = []
    for name, weights in schema.COMBINED_SENSORS.items():
        total = "(" + " + ".join(str(w) for w in weights.values()) + ")::DOUBLE"
        outs.append("round((" + " + ".join(f"{c} * {w}::DOUBLE" for c, w in weights.items()) + f") / {total}, 6) + 0.0 AS {name}")
    return f"SELECT serial_number, model, dt, {', '.join(outs)} FROM panel"


@query("weighted_sum", _weighted_sql(), ("panel",))
def weighted_sum(spark, sf):
    df = panel(spark, sf)
    return df.select(*INDEX, *[r6(scalar.weighted_sum(w, df.columns)).alias(n) for n, w in schema.COMBINED_SENSORS.items()])


@query(
    "rare_to_other",
    """WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1), k AS (SELECT p_size FROM c
       WHERE round_even(n / (SELECT count(*) FROM part), 3) > 0.02)
       SELECT p_partkey, CASE WHEN p_size IN (SELECT p_size FROM k) THEN CAST(p_size AS VARCHAR) ELSE 'other' END AS size FROM part""",
)
def rare_to_other(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"))
    return encode.rare_to_other(df, "size", limit=0.02)


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "one_hot",
    "SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS INT) AS c_mktsegment_{s}" for s in _SEGMENTS) + " FROM customer",
)
def one_hot(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return encode.one_hot_columns(df, encode.fit_vocabulary(df, ["c_mktsegment"], ["c_custkey"]))


@query(
    "numerical_encoding",
    """WITH f AS (SELECT arg_min(l_linestatus, (l_orderkey, l_linenumber)) AS first FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_returnflag = 'A' AS INT) AS l_returnflag_A,
       CAST(l_returnflag = 'N' AS INT) AS l_returnflag_N, CAST(l_returnflag = 'R' AS INT) AS l_returnflag_R,
       CAST(l_linestatus <> first AS INT) AS l_linestatus, 0 AS maker FROM lineitem CROSS JOIN f""",
)
def numerical_encoding(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", F.lit("A").alias("maker")
    )
    return encode.numerical_encoding(df, order=["l_orderkey", "l_linenumber"])


@query(
    "factorize",
    """WITH f AS (SELECT c_nationkey, min(c_custkey) AS k FROM customer GROUP BY 1),
       d AS (SELECT c_nationkey, CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS code FROM f)
       SELECT c_custkey, c_nationkey, code FROM customer JOIN d USING (c_nationkey)""",
)
def factorize(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return encode.factorize(df, "c_nationkey", "c_custkey")


@query(
    "focal_loss",
    """SELECT round(avg(-(0.25 * t + 0.75 * (1 - t)) * pow(1 - pt, 2) * ln(pt)), 6) AS focal_loss FROM (
       SELECT t, t * p + (1 - t) * (1 - p) AS pt FROM (SELECT CAST(tag > 0 AS DOUBLE) AS t, 1 / (1 + exp(-(4 * prob - 2))) AS p FROM scored))""",
    ("scored",),
)
def focal_loss(spark, sf):
    df = scored(spark, sf).select((F.col("prob") * 4 - 2).alias("score"), (F.col("tag") > 0).cast("double").alias("t"))
    return df.agg(r6(F.avg(scalar.focal_loss("score", "t", 0.25, 2.0))).alias("focal_loss"))


@query(
    "round_half_even",
    "SELECT serial_number, model, dt, round_even(smart_4raw / 8, 2) AS x, round_even(smart_1_normalized / 3, 5) AS y FROM panel",
    ("panel",),
)
def round_half_even(spark, sf):
    return panel(spark, sf).select(
        *INDEX, scalar.round_half_even(F.col("smart_4raw") / 8, 2).alias("x"),
        scalar.round_half_even(F.col("smart_1_normalized") / 3, 5).alias("y"),
    )
