"""Joins on keys and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import clean, combine
from panelspark.registry import labelled, panel, query, table

INDEX = ["serial_number", "model", "dt"]


@query(
    "rejoin_labels",
    "SELECT p.serial_number, p.model, p.dt, p.smart_4raw, l.tag, l.flag FROM panel p LEFT JOIN labelled l USING (serial_number, model, dt)",
    ("labelled",),
)
def rejoin_labels(spark, sf):
    features = panel(spark, sf).select(*INDEX, "smart_4raw")
    return combine.rejoin_labels(features, labelled(spark, sf).select(*INDEX, "tag", "flag"), INDEX)


@query(
    "merge_features",
    """SELECT a.serial_number, a.model, a.dt, a.smart_4raw, b.smart_1_normalized FROM panel a
       JOIN (SELECT * FROM panel WHERE dt >= DATE '2024-01-10') b USING (serial_number, model, dt)""",
    ("panel",),
)
def merge_features(spark, sf):
    raw = panel(spark, sf).select(*INDEX, "smart_4raw")
    normalized = clean.in_date_range(panel(spark, sf), "2024-01-10").select(*INDEX, "smart_1_normalized")
    return combine.merge_features(raw, normalized, INDEX)


@query(
    "enrich_dims",
    """SELECT c_custkey, c_nationkey, n_name, n_regionkey, r_name FROM customer
       LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def enrich_dims(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    out = combine.enrich(customer, (nation, "c_nationkey"), (region, "n_regionkey"))
    return out.select("c_custkey", "c_nationkey", "n_name", "n_regionkey", "r_name")


@query(
    "column_concat",
    """SELECT serial_number, model, dt, smart_4raw, smart_4raw * 2 AS twice, CAST(smart_5raw > 0 AS INT) AS any_error FROM panel""",
    ("panel",),
)
def column_concat(spark, sf):
    return panel(spark, sf).select(
        *INDEX, "smart_4raw", (F.col("smart_4raw") * 2).alias("twice"), (F.col("smart_5raw") > 0).cast("int").alias("any_error")
    )


@query(
    "anti_keys",
    """SELECT DISTINCT model, serial_number FROM labelled l WHERE NOT EXISTS
       (SELECT 1 FROM labelled f WHERE f.tag > 0 AND f.model = l.model AND f.serial_number = l.serial_number)""",
    ("labelled",),
)
def anti_keys(spark, sf):
    df = labelled(spark, sf)
    return combine.keys_only_in(df, df.filter("tag > 0"), ["model", "serial_number"])


@query(
    "union_by_name",
    """SELECT serial_number, model, dt, smart_4raw, NULL AS smart_1_normalized FROM panel WHERE dt < DATE '2024-01-10'
       UNION ALL SELECT serial_number, model, dt, NULL, smart_1_normalized FROM panel WHERE dt >= DATE '2024-01-10'""",
    ("panel",),
)
def union_by_name(spark, sf):
    df = panel(spark, sf)
    early = df.filter("dt < DATE '2024-01-10'").select(*INDEX, "smart_4raw")
    late = df.filter("dt >= DATE '2024-01-10'").select(*INDEX, "smart_1_normalized")
    return combine.union_all(early, late)


@query(
    "intersect_keys",
    """SELECT model, serial_number FROM labelled WHERE tag > 0 INTERSECT
       SELECT model, serial_number FROM labelled WHERE dt >= DATE '2024-01-20'""",
    ("labelled",),
)
def intersect_keys(spark, sf):
    df = labelled(spark, sf)
    return combine.keys_in_both(df.filter("tag > 0"), df.filter("dt >= DATE '2024-01-20'"), ["model", "serial_number"])


@query(
    "except_keys",
    """SELECT model, serial_number FROM labelled EXCEPT SELECT model, serial_number FROM labelled WHERE flag = 1""",
    ("labelled",),
)
def except_keys(spark, sf):
    df = labelled(spark, sf)
    return combine.keys_except(df, df.filter("flag = 1"), ["model", "serial_number"])
