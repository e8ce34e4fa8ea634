"""Filters, column choice, missing values, types."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import schema
from panelspark.operators import clean, label
from panelspark.registry import labelled, panel, powered, query, rounded, table

SENSORS = schema.SENSORS + ["smart_10_normalized", "smart_240raw"]


def stacked(columns, expr: str, source: str) -> str:
    """The same expression for each column, one row per column."""
    return "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", {expr.format(c=c)} FROM {source}" for c in columns)


@query(
    "date_range_filter",
    """SELECT serial_number, model, dt, smart_4raw FROM panel
       WHERE dt >= DATE '2024-01-08' AND dt <= DATE '2024-01-21'""",
    ("panel",),
)
def date_range_filter(spark, sf):
    out = clean.in_date_range(panel(spark, sf), "2024-01-08", "2024-01-21")
    return out.select("serial_number", "model", "dt", "smart_4raw")


@query("model_filter", "SELECT serial_number, model, dt, smart_4raw FROM panel WHERE model = 2", ("panel",))
def model_filter(spark, sf):
    return clean.of_model(panel(spark, sf), 2).select("serial_number", "model", "dt", "smart_4raw")


@query(
    "nonzero_power_filter",
    "SELECT serial_number, model, dt, smart_9raw FROM panel WHERE smart_9raw IS DISTINCT FROM 0",
    ("panel",),
)
def nonzero_power_filter(spark, sf):
    return clean.powered_on(panel(spark, sf)).select("serial_number", "model", "dt", "smart_9raw")


@query(
    "binarize_label",
    "SELECT serial_number, model, dt, CAST(tag <> 0 AS TINYINT) AS tag FROM labelled",
    ("labelled",),
)
def binarize_label(spark, sf):
    return label.binarize_label(labelled(spark, sf)).select("serial_number", "model", "dt", "tag")


@query(
    "drop_columns",
    "SELECT * EXCLUDE (manufacturer, smart_10_normalized, smart_240raw) FROM panel",
    ("panel",),
)
def drop_columns(spark, sf):
    return panel(spark, sf).drop("manufacturer", "smart_10_normalized", "smart_240raw")


@query("select_columns_by_name", "SELECT dt, serial_number, model, COLUMNS('.*_normalized') FROM panel", ("panel",))
def select_columns_by_name(spark, sf):
    df = panel(spark, sf)
    return df.select("dt", "serial_number", "model", *schema.columns_with_token(df, "normalized"))


def _roles_sql() -> str:
    roles = {"dt": "index", "serial_number": "index", "model": "index", "manufacturer": "category"}
    roles |= {c: "continuous" for c in SENSORS} | {"tag": "label", "flag": "label", "30_day": "label"}
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", '{r}' AS role, count(\"{c}\") AS filled FROM labelled" for c, r in roles.items()
    )


@query("column_roles", _roles_sql(), ("labelled",))
def column_roles(spark, sf):
    df = labelled(spark, sf)
    roles = schema.column_roles(df)
    by_column = {c: r for r in ("index", "category", "continuous", "label") for c in getattr(roles, r)}
    filled = clean.per_column(df, df.columns, {"filled": lambda c: F.count(c)})
    role = F.element_at(F.create_map(*[F.lit(x) for pair in by_column.items() for x in pair]), F.col("column"))
    return filled.select("column", role.alias("role"), "filled")


@query(
    "select_by_dtype",
    "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
def select_by_dtype(spark, sf):
    df = table(spark, sf, "lineitem")
    nominal = schema.columns_of_type(df)
    return df.groupBy(*nominal).agg(F.count(F.lit(1)).alias("n"))


@query(
    "predicate_mask",
    """SELECT count(*) AS n, round(min(smart_1_normalized), 6) AS low, round(max(smart_1_normalized), 6) AS high,
       round(avg(smart_1_normalized), 6) AS mean FROM labelled
       WHERE smart_5raw >= 1 AND tag = 0 AND (smart_197raw > 0 OR smart_198raw > 0)""",
    ("labelled",),
)
def predicate_mask(spark, sf):
    mask = "smart_5raw >= 1 AND tag = 0 AND (smart_197raw > 0 OR smart_198raw > 0)"
    x = "smart_1_normalized"
    out = labelled(spark, sf).filter(mask).agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean")
    )
    return rounded(out)


@query(
    "null_ratio_prune",
    "SELECT *, null_percent >= 30 AS drop FROM ("
    + stacked(SENSORS, "round_even(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100, 2) AS null_percent", "powered")
    + ")",
    ("powered",),
)
def null_ratio_prune(spark, sf):
    out = clean.null_percent(powered(spark, sf), SENSORS)
    return out.withColumn("drop", F.col("null_percent") >= schema.NULL_PERCENT_LIMIT)


@query(
    "all_null_prune",
    "SELECT serial_number, model, dt, smart_4raw, smart_240raw FROM panel",
    ("panel",),
)
def all_null_prune(spark, sf):
    df = panel(spark, sf).select("serial_number", "model", "dt", "smart_4raw", "smart_240raw")
    df = df.withColumn("smart_241raw", F.lit(None).cast("double"))
    return df.drop(*clean.fit_null_prune(df, all_null_only=True))


@query(
    "distinct_count_prune",
    "SELECT *, distinct_values <= 1 AS drop FROM ("
    + stacked(SENSORS, "count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS distinct_values", "powered")
    + ")",
    ("powered",),
)
def distinct_count_prune(spark, sf):
    return clean.distinct_counts(powered(spark, sf), SENSORS).withColumn("drop", F.col("distinct_values") <= schema.DISTINCT_LIMIT)


@query(
    "small_std_prune",
    "SELECT *, std <= 1 AS drop FROM ("
    + stacked(SENSORS, "round_even(stddev_samp({c}), 2) AS std", "powered")
    + ")",
    ("powered",),
)
def small_std_prune(spark, sf):
    return clean.small_std(powered(spark, sf), SENSORS)


@query(
    "pruned_panel",
    "SELECT * EXCLUDE (smart_10_normalized, smart_240raw, manufacturer) FROM powered",
    ("powered",),
)
def pruned_panel(spark, sf):
    df = powered(spark, sf)
    gone = set(clean.fit_distinct_prune(df, SENSORS)) | set(clean.fit_null_prune(df))
    return df.drop("manufacturer", *gone)


@query(
    "correct_types",
    """SELECT serial_number, CAST(model AS TINYINT) AS model, dt, CAST(smart_4raw AS TINYINT) AS smart_4raw,
       CAST(smart_9raw AS SMALLINT) AS smart_9raw, CAST(smart_1_normalized AS FLOAT) AS smart_1_normalized,
       CAST(tag AS TINYINT) AS tag FROM labelled""",
    ("labelled",),
)
def correct_types(spark, sf):
    raw = labelled(spark, sf).select(
        "serial_number", "model", F.date_format("dt", "yyyyMMdd").cast("int").alias("dt"),
        F.col("smart_4raw").cast("long").alias("smart_4raw"), F.col("smart_9raw").cast("long").alias("smart_9raw"),
        "smart_1_normalized", F.col("tag").cast("int").alias("tag"),
    )
    return clean.correct_types(raw)


@query(
    "dedupe_disk_day",
    """SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_quantity FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber) = 1""",
)
def dedupe_disk_day(spark, sf):
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    return clean.dedupe_disk_day(df, ["l_suppkey", "l_shipdate"], ["l_orderkey", "l_linenumber"])


@query("distinct_rows", "SELECT DISTINCT smart_5raw, smart_9raw FROM panel", ("panel",))
def distinct_rows(spark, sf):
    return panel(spark, sf).select("smart_5raw", "smart_9raw").distinct()


@query(
    "fill_mean",
    """SELECT serial_number, model, dt, round(coalesce(smart_195_normalized, avg(smart_195_normalized) OVER ()), 6) + 0.0
       AS smart_195_normalized FROM panel""",
    ("panel",),
)
def fill_mean(spark, sf):
    df = panel(spark, sf).select("serial_number", "model", "dt", "smart_195_normalized")
    return rounded(clean.fill_mean(df, ["smart_195_normalized"]))


@query(
    "fill_constant",
    """SELECT serial_number, model, dt, coalesce(smart_195_normalized, CAST(-1.234 AS DOUBLE)) AS smart_195_normalized,
       coalesce(CASE WHEN smart_240raw = 1 THEN 1 END, 0) AS c_cate FROM panel""",
    ("panel",),
)
def fill_constant(spark, sf):
    df = panel(spark, sf).select(
        "serial_number", "model", "dt", "smart_195_normalized",
        F.when(F.col("smart_240raw") == 1, 1).alias("c_cate"),
    )
    return clean.fill_constant(df, ["smart_195_normalized"], ["c_cate"])


@query(
    "missing_strategy_replace",
    """SELECT serial_number, model, dt, coalesce(smart_195_normalized, 0) AS smart_195_normalized,
       coalesce(smart_240raw, 0) AS smart_240raw FROM panel""",
    ("panel",),
)
def missing_strategy_replace(spark, sf):
    df = panel(spark, sf).select("serial_number", "model", "dt", "smart_195_normalized", "smart_240raw")
    return clean.missing_strategy(df, "replace")


@query(
    "missing_strategy_drop_samples",
    """SELECT serial_number, model, dt, smart_195_normalized, smart_240raw FROM panel
       WHERE smart_195_normalized IS NOT NULL AND smart_240raw IS NOT NULL""",
    ("panel",),
)
def missing_strategy_drop_samples(spark, sf):
    df = panel(spark, sf).select("serial_number", "model", "dt", "smart_195_normalized", "smart_240raw")
    return clean.missing_strategy(df, "drop_samples")


@query("missing_strategy_drop_features", "SELECT serial_number, model, dt, smart_4raw FROM panel", ("panel",))
def missing_strategy_drop_features(spark, sf):
    df = panel(spark, sf).select("serial_number", "model", "dt", "smart_195_normalized", "smart_240raw", "smart_4raw")
    return clean.missing_strategy(df, "drop_features")


@query(
    "drop_null_rows",
    "SELECT serial_number, model, dt, smart_195_normalized FROM panel WHERE smart_195_normalized IS NOT NULL",
    ("panel",),
)
def drop_null_rows(spark, sf):
    df = panel(spark, sf).select("serial_number", "model", "dt", "smart_195_normalized")
    return df.na.drop(subset=["smart_195_normalized"])
