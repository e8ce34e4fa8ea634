"""A sensor panel and fault log derived from an ``events`` table.

One SQL text per view, valid in Spark SQL and in ANSI engines: a user is a disk, a day a reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PANEL_SQL = """
SELECT concat('disk_', user_id) AS serial_number, CAST(user_id % 2 + 1 AS INT) AS model, 'A' AS manufacturer,
 CAST(ts AS DATE) AS dt,
 CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS smart_1_normalized,
 CAST(round(min(value), 4) AS DOUBLE) AS smart_3_normalized,
 CAST(round(max(value), 4) AS DOUBLE) AS smart_7_normalized,
 CAST(100 - user_id % 3 AS DOUBLE) AS smart_9_normalized,
 CAST(100 - count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS smart_187_normalized,
 CAST(max(extract(hour FROM ts)) AS DOUBLE) AS smart_189_normalized,
 CAST(min(extract(hour FROM ts)) AS DOUBLE) AS smart_191_normalized,
 CAST(max(extract(minute FROM ts)) AS DOUBLE) AS smart_193_normalized,
 CASE WHEN (user_id + extract(day FROM CAST(ts AS DATE))) % 7 = 0 THEN NULL
      ELSE CAST(round(max(value), 4) AS DOUBLE) END AS smart_195_normalized,
 CAST(count(*) AS DOUBLE) AS smart_4raw,
 CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS smart_5raw,
 CAST(CASE WHEN user_id % 25 = 0 AND extract(day FROM CAST(ts AS DATE)) = 1 THEN 0
      ELSE 24 * (user_id % 60) + 24 * extract(day FROM CAST(ts AS DATE)) + max(extract(hour FROM ts))
      END AS DOUBLE) AS smart_9raw,
 CAST(count(*) FILTER (WHERE event_type = 'view') AS DOUBLE) AS smart_12raw,
 CAST(count(*) FILTER (WHERE event_type = 'signup') AS DOUBLE) AS smart_184raw,
 CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS smart_188raw,
 CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS smart_192raw,
 CAST(20 + extract(day FROM CAST(ts AS DATE)) % 5 AS DOUBLE) AS smart_194raw,
 CAST(count(*) FILTER (WHERE value > 100) AS DOUBLE) AS smart_197raw,
 CAST(count(*) FILTER (WHERE value > 200) AS DOUBLE) AS smart_198raw,
 CAST(count(DISTINCT event_type) AS DOUBLE) AS smart_199raw,
 CAST(100 AS DOUBLE) AS smart_10_normalized,
 CASE WHEN (user_id + extract(day FROM CAST(ts AS DATE))) % 2 = 0 THEN NULL
      ELSE CAST(1 AS DOUBLE) END AS smart_240raw
FROM events GROUP BY user_id, CAST(ts AS DATE)
"""

FAULT_SQL = """
SELECT 'A' AS manufacturer, CAST(user_id % 2 + 1 AS INT) AS model, concat('disk_', user_id) AS serial_number,
 CAST(ts AS DATE) AS fault_time, CAST(user_id % 7 AS INT) AS tag, event_id AS list_order
FROM events WHERE event_type = 'error' AND value >= 150
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PANEL_SQL.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def fault_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FAULT_SQL.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
