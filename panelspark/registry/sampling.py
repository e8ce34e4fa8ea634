"""Down-sampling, random splits and ordered tops."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import scalar
from panelspark.operators import profile, sampling
from panelspark.registry import labelled, query, table
from panelspark.registry.evaluation import GAP, PRIOR, TRAIN, VALID
from panelspark.session import materialize

SEED = 42
KEY = ["serial_number", "model", "dt"]
HASH = "md5(concat_ws('|', serial_number, model, dt, 42))"
UNIT = "CAST(CAST('0x' || substr({h}, 1, 8) AS BIGINT) AS DOUBLE) / 4294967296"
COLS = "serial_number, model, dt, flag, tag"


def rows(spark, sf):
    """Labelled rows with a power-on bucket (none for long-running disks) and a cluster-like label,
    written once, as a sample counts its strata before it picks."""
    days = scalar.power_on_days("smart_9raw")
    df = labelled(spark, sf).select(
        *KEY, "flag", (F.col("tag") > 0).cast("int").alias("tag"),
        F.when(days < 80, F.floor(days / 20).cast("int")).alias("power_on_hours_in_day_unit_cate"),
        (F.col("smart_4raw").cast("int") % 3).alias("cluster_label"),
    )
    return materialize(df, "labelled")


ROWS = """rows AS (SELECT serial_number, model, dt, flag, CAST(tag > 0 AS INT) AS tag,
    CASE WHEN floor(smart_9raw / 24) < 80 THEN CAST(floor(floor(smart_9raw / 24) / 20) AS INT) END AS power_on_hours_in_day_unit_cate,
    CAST(smart_4raw AS INT) % 3 AS cluster_label FROM labelled)"""


def picked(source: str, strata: str, quota: str) -> str:
    """The rows with the smallest hashes of each stratum."""
    part = f"PARTITION BY {strata}" if strata else ""
    return f"""(SELECT {COLS} FROM (SELECT *, row_number() OVER ({part} ORDER BY {HASH}, serial_number, model, dt) AS rn FROM {source})
        WHERE rn <= {quota})"""


def _sample(spark, sf, fn, *args):
    normal = sampling.split_by_label(rows(spark, sf))[1]
    return fn(normal, *args, seed=SEED, key=KEY).select(*KEY, "flag", "tag")


@query(
    "sample_by_month",
    f"""WITH {ROWS}, n AS (SELECT * FROM rows WHERE tag = 0)
       SELECT * FROM {picked("(SELECT *, year(dt) AS y, month(dt) AS m FROM n)", "y, m",
       "floor(floor(0.3 * (SELECT count(*) FROM n)) / (SELECT count(DISTINCT (year(dt), month(dt))) FROM n))")}""",
    ("labelled",),
)
def sample_by_month(spark, sf):
    return _sample(spark, sf, sampling.sample_by_month, 0.3)


@query(
    "sample_by_bucket",
    f"""WITH {ROWS}, n AS (SELECT * FROM rows WHERE tag = 0 AND power_on_hours_in_day_unit_cate IS NOT NULL)
       SELECT * FROM {picked("n", "power_on_hours_in_day_unit_cate",
       "floor(floor(0.3 * (SELECT count(*) FROM n)) * (1.0::DOUBLE / (SELECT count(DISTINCT power_on_hours_in_day_unit_cate) FROM n)))")}""",
    ("labelled",),
)
def sample_by_bucket(spark, sf):
    return _sample(spark, sf, sampling.sample_by_bucket, 0.3)


@query(
    "sample_by_cluster",
    f"""WITH {ROWS}, n AS (SELECT *, count(*) OVER (PARTITION BY cluster_label) AS k FROM rows WHERE tag = 0)
       SELECT * FROM {picked("n", "cluster_label", "floor(500 * (k / (SELECT count(*) FROM n)))")}""",
    ("labelled",),
)
def sample_by_cluster(spark, sf):
    return _sample(spark, sf, sampling.sample_by_cluster, 500)


@query(
    "sample_negative",
    f"""WITH {ROWS}, v AS (SELECT * FROM rows WHERE dt BETWEEN DATE '{VALID[0]}' AND DATE '{VALID[1]}')
       SELECT * FROM {picked("(SELECT * FROM v WHERE tag = 0)", "", "floor(0.25 * (SELECT count(*) FROM v))")}""",
    ("labelled",),
)
def sample_negative(spark, sf):
    span = rows(spark, sf).filter(f"dt BETWEEN DATE '{VALID[0]}' AND DATE '{VALID[1]}'")
    return sampling.sample_negatives(span, 0.25, SEED, KEY).select(*KEY, "flag", "tag")


@query(
    "sampling_plan",
    f"""WITH {ROWS}, v AS (SELECT * FROM rows WHERE dt BETWEEN DATE '{VALID[0]}' AND DATE '{VALID[1]}'),
       t AS (SELECT * FROM rows WHERE dt BETWEEN DATE '{TRAIN[0]}' AND DATE '{TRAIN[1]}'), n AS (SELECT * FROM t WHERE tag = 0),
       g AS (SELECT * FROM rows WHERE dt BETWEEN DATE '{GAP[0]}' AND DATE '{GAP[1]}')
       SELECT {COLS} FROM v WHERE tag = 1
       UNION ALL SELECT * FROM {picked("(SELECT * FROM v WHERE tag = 0)", "", "floor(0.25 * (SELECT count(*) FROM v))")}
       UNION ALL SELECT {COLS} FROM t WHERE tag = 1
       UNION ALL SELECT {COLS} FROM rows WHERE dt < DATE '{PRIOR}' AND tag = 1
       UNION ALL SELECT {COLS} FROM g WHERE tag = 1 AND model IN (SELECT model FROM g WHERE flag = 1)
                 AND serial_number IN (SELECT serial_number FROM g WHERE flag = 1)
       UNION ALL SELECT * FROM {picked("(SELECT *, year(dt) AS y, month(dt) AS m FROM n)", "y, m",
       "floor(floor(0.3 * (SELECT count(*) FROM n)) / (SELECT count(DISTINCT (year(dt), month(dt))) FROM n))")}""",
    ("labelled",),
)
def sampling_plan(spark, sf):
    out = sampling.sampling_plan(
        rows(spark, sf), TRAIN, 0.3, "month", VALID, 0.25, GAP, PRIOR, SEED, KEY
    )
    return out.select(*KEY, "flag", "tag")


@query(
    "sample_disks",
    f"""WITH {ROWS} SELECT {COLS} FROM rows WHERE (model, serial_number) IN (SELECT (model, serial_number) FROM rows WHERE tag <> 0)
       OR {UNIT.format(h="md5(concat_ws('|', model, serial_number, 42))")} < 0.5""",
    ("labelled",),
)
def sample_disks(spark, sf):
    return sampling.sample_disks(rows(spark, sf), 0.5, SEED).select(*KEY, "flag", "tag")


@query("sample_fraction", f"WITH {ROWS} SELECT {COLS} FROM rows WHERE {UNIT.format(h=HASH)} < 0.6", ("labelled",))
def sample_fraction(spark, sf):
    return sampling.sample_fraction(rows(spark, sf), 0.6, SEED, KEY).select(*KEY, "flag", "tag")


@query(
    "random_split",
    f"WITH {ROWS} SELECT {COLS}, CASE WHEN {UNIT.format(h=HASH)} < 0.8 THEN 'train' ELSE 'test' END AS split FROM rows",
    ("labelled",),
)
def random_split(spark, sf):
    return sampling.random_split(rows(spark, sf), 0.8, SEED, KEY).select(*KEY, "flag", "tag", "split")


@query("sort_by_date", "SELECT serial_number, model, dt, flag FROM labelled ORDER BY dt, model, serial_number", ("labelled",))
def sort_by_date(spark, sf):
    return labelled(spark, sf).select(*KEY, "flag").orderBy("dt", "model", "serial_number")


@query(
    "topk",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 30",
)
def topk(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return profile.top_rows(df, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 30)
