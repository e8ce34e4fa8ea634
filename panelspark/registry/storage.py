"""Scans, sinks and the alert stream. Whatever is written goes to the session's shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import rank
from panelspark.registry import fault_log, labelled, panel, query, r6, scored
from panelspark.registry.ranking import first_cte
from panelspark.session import new_path
from panelspark.sources import readers, writers
from panelspark.streaming import alerts as stream

INDEX = ["serial_number", "model", "dt"]
SMALL = ["smart_1_normalized", "smart_4raw", "smart_5raw"]
NULLS = "smart_195_normalized"
CSV_SQL = "SELECT serial_number, model, dt, smart_1_normalized, smart_4raw, smart_5raw, smart_195_normalized FROM panel"
SMALL_SQL = "SELECT serial_number, model, dt, smart_1_normalized, smart_4raw, smart_5raw FROM panel"


def _csv_rows(spark, sf, *more):
    """Rows as the original files have them: a leading index without a name, sensors in another order
    than ours, one that nobody asks for, and NaN where the panel has NULL."""
    sensors = [F.coalesce(F.col(c).cast("string"), F.lit("NaN")).alias(c) for c in (*reversed(SMALL), NULLS, "smart_12raw")]
    rows = panel(spark, sf).withColumn("day", F.date_format("dt", "yyyyMMdd"))
    number = F.monotonically_increasing_id().alias(" ")
    return rows.select(number, "serial_number", *sensors, "manufacturer", "model", F.col("day").alias("dt"), *[F.col("day").alias(c) for c in more])


@query("scan_csv_panel", CSV_SQL, ("panel",))
def scan_csv_panel(spark, sf):
    path = new_path(spark, "panel-csv")
    _csv_rows(spark, sf).write.option("header", True).csv(path)
    return readers.scan_csv_panel(spark, path, [*SMALL, NULLS]).select(*INDEX, *SMALL, NULLS)


@query("scan_daily_files", CSV_SQL + " WHERE dt BETWEEN DATE '2024-01-11' AND DATE '2024-01-13'", ("panel",))
def scan_daily_files(spark, sf):
    path = new_path(spark, "daily-csv")
    rows = _csv_rows(spark, sf, "day")
    rows.hint("rebalance", "day").write.partitionBy("day").option("header", True).csv(path)
    return readers.scan_daily_files(
        spark, path, "2024-01-11", "2024-01-13", [*INDEX, *SMALL, NULLS], [*SMALL, NULLS], pattern="day={day}"
    )


@query("scan_day_partitions", SMALL_SQL + " WHERE dt BETWEEN DATE '2024-01-11' AND DATE '2024-01-13'", ("panel",))
def scan_day_partitions(spark, sf):
    path = new_path(spark, "daily")
    panel(spark, sf).select(*INDEX, *SMALL).hint("rebalance", "dt").write.partitionBy("dt").parquet(path)
    return readers.scan_day_partitions(spark, path, "2024-01-11", "2024-01-13").select(*INDEX, *SMALL)


@query("scan_columns", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem")
def scan_columns(spark, sf):
    return readers.scan_columns(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_shipdate"])


@query(
    "load_panel",
    "SELECT 'train' AS source, serial_number, model, dt, smart_4raw FROM panel"
    " UNION ALL SELECT 'predict', serial_number, model, dt, smart_4raw FROM panel WHERE dt BETWEEN DATE '2024-01-29' AND DATE '2024-01-30'",
    ("panel",),
)
def load_panel(spark, sf):
    store, drop = new_path(spark, "store"), new_path(spark, "drop")
    panel(spark, sf).select(*INDEX, *SMALL).write.parquet(store)
    rows = _csv_rows(spark, sf, "day")
    rows.hint("rebalance", "day").write.partitionBy("day").option("header", True).csv(drop)
    wanted = [*INDEX, "smart_4raw"]
    train = readers.load_panel(spark, store, True, columns=wanted)
    predict = readers.load_panel(spark, drop, False, "2024-01-29", "2024-01-30", wanted, SMALL, pattern="day={day}")
    return train.withColumn("source", F.lit("train")).unionByName(predict.withColumn("source", F.lit("predict")))


@query("scan_fault_log", "SELECT manufacturer, model, serial_number, fault_time, tag FROM fault", ("fault",))
def scan_fault_log(spark, sf):
    first, second = new_path(spark, "faults"), new_path(spark, "faults")
    log = fault_log(spark, sf)
    cols = ["manufacturer", "model", "serial_number", "fault_time", "tag"]
    early = F.col("fault_time") < F.lit("2024-01-16").cast("date")
    log.filter(early).select(*cols).write.option("header", True).csv(first)
    log.filter(~early).select(*cols, F.lit("k").alias("key")).write.option("header", True).csv(second)
    return readers.scan_fault_log(spark, first, second).select(*cols)


@query("write_panel", SMALL_SQL.replace(" FROM panel", ", tag, CAST(strftime(dt, '%Y%m') AS INT) AS month FROM labelled"), ("labelled",))
def write_panel(spark, sf):
    path = new_path(spark, "panel")
    df = labelled(spark, sf).select(*INDEX, *SMALL, "tag")
    half = F.col("dt") < F.lit("2024-01-16").cast("date")
    writers.write_panel(df.filter(half), path)
    writers.write_panel(df.filter(~half), path)
    return spark.read.parquet(path)


@query(
    "store_panel",
    """SELECT serial_number, model, dt, smart_1_normalized, CASE WHEN dt >= DATE '2024-01-16' THEN smart_4raw END AS smart_4raw,
       CASE WHEN dt < DATE '2024-01-16' THEN smart_195_normalized END AS smart_195_normalized,
       CAST(strftime(dt, '%Y%m%d') AS INT) AS period FROM panel""",
    ("panel",),
)
def store_panel(spark, sf):
    """The first half lacks one sensor, the second another; the first is written twice."""
    path = new_path(spark, "store")
    df = panel(spark, sf).select(*INDEX, "smart_1_normalized", "smart_4raw", "smart_195_normalized")
    early = F.col("dt") < F.lit("2024-01-16").cast("date")
    writers.store_panel(df.filter(early).drop("smart_4raw"), path, "yyyyMMdd")
    writers.store_panel(df.filter(~early).drop("smart_195_normalized"), path, "yyyyMMdd")
    writers.store_panel(df.filter(early).drop("smart_4raw"), path, "yyyyMMdd")
    return writers.read_store(spark, path)


@query(
    "write_test_panel",
    """SELECT serial_number, CAST(model AS TINYINT) AS model, dt, CAST(smart_1_normalized AS FLOAT) AS smart_1_normalized,
       CAST(smart_195_normalized AS FLOAT) AS smart_195_normalized FROM panel""",
    ("panel",),
)
def write_test_panel(spark, sf):
    path = new_path(spark, "test-panel")
    df = panel(spark, sf).select(
        "serial_number", "model", F.date_format("dt", "yyyyMMdd").alias("dt"), "smart_1_normalized", "smart_195_normalized", "smart_240raw"
    )
    writers.write_test_panel(df, path)
    return spark.read.parquet(path)


@query("write_features", SMALL_SQL, ("panel",))
def write_features(spark, sf):
    path = new_path(spark, "features")
    writers.write_features(panel(spark, sf).select(*INDEX, *SMALL), path)
    return spark.read.parquet(path)


@query("write_sample", SMALL_SQL + " WHERE model = 1", ("panel",))
def write_sample(spark, sf):
    path = new_path(spark, "sample")
    df = panel(spark, sf).select(*INDEX, *SMALL)
    writers.write_sample(df.filter("model = 1"), path)
    writers.write_sample(df, path)  # changes nothing: the sample exists
    return spark.read.parquet(path)


@query(
    "write_submission",
    f"WITH {first_cte(0.9, 3)} SELECT 'A' AS manufacturer, model, serial_number, dt FROM firsts",
    ("scored",),
)
def write_submission(spark, sf):
    path = new_path(spark, "submission")
    df = scored(spark, sf).select(*INDEX, "prob")
    writers.write_submission(rank.submission(rank.daily_alerts(df, quantile=0.9, per_day=3)), path)
    return spark.read.schema(stream.ALERT_SCHEMA).csv(path)


@query(
    "write_sequences",
    """SELECT model, serial_number, dt AS last_dt, tag, 20 AS steps, round(total, 6) + 0.0 AS total FROM (
        SELECT model, serial_number, dt, tag, count(*) OVER w AS k, sum(smart_1_normalized) OVER w AS total FROM labelled
        WINDOW w AS (PARTITION BY model, serial_number ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE k = 20""",
    ("labelled",),
)
def write_sequences(spark, sf):
    path = new_path(spark, "sequences")
    writers.write_sequences(labelled(spark, sf), path, ["smart_4raw", "smart_1_normalized"], "tag", 20)
    total = F.aggregate("data", F.lit(0.0), lambda a, row: a + row[1])
    return spark.read.parquet(path).select("model", "serial_number", "last_dt", "tag", F.size("data").alias("steps"), r6(total).alias("total"))


@query("slice_to_csv", SMALL_SQL, ("panel",))
def slice_to_csv(spark, sf):
    path = new_path(spark, "slices")
    writers.slice_to_csv(panel(spark, sf).select(*INDEX, *SMALL), path)
    types = "serial_number string, model int, smart_1_normalized double, smart_4raw double, smart_5raw double, dt date"
    return spark.read.schema(types).csv(path, header=True)


@query(
    "split_raw_normalized",
    """SELECT r.serial_number, r.model, r.dt, r.smart_4raw, r.smart_240raw, n.smart_1_normalized, n.smart_3_normalized
       FROM panel r JOIN panel n USING (serial_number, model, dt)""",
    ("panel",),
)
def split_raw_normalized(spark, sf):
    df = panel(spark, sf).select(*INDEX, "smart_4raw", "smart_240raw", "smart_1_normalized", "smart_3_normalized")
    df = df.withColumn("smart_241raw", F.lit(None).cast("double"))
    raw, normalized = writers.split_raw_normalized(df, INDEX)
    paths = [new_path(spark, "raw"), new_path(spark, "normalized")]
    raw.write.parquet(paths[0])
    normalized.write.parquet(paths[1])
    return spark.read.parquet(paths[0]).join(spark.read.parquet(paths[1]), INDEX)


def _stream_score(df):
    user = F.split_part("serial_number", F.lit("_"), F.lit(2)).cast("int")
    return df.select(*INDEX, (((user * 37 + F.dayofmonth("dt") * 101) % 97).cast("double") / 97).alias("prob"))


@query(
    "stream_daily_alerts",
    f"WITH {first_cte(0.9, 3)} SELECT 'A' AS manufacturer, model, serial_number, dt FROM firsts",
    ("scored",),
)
def stream_daily_alerts(spark, sf):
    """Every day comes in several files and several batches; the result equals the batch job."""
    drop, out, state = new_path(spark, "drops"), new_path(spark, "alerts"), new_path(spark, "state")
    df = panel(spark, sf).select(*INDEX, "smart_4raw")
    df.repartition("serial_number").write.option("header", True).csv(drop)  # a file has rows of all days
    stream.stream_daily_alerts(spark, drop, df.schema, out, state, _stream_score, 0.9, 3, files_per_batch=3).awaitTermination()
    return stream.read_alerts(spark, out).select("manufacturer", "model", "serial_number", "dt")
