"""Counts, distributions, drift and association statistics."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from panelspark import schema
from panelspark.operators import assoc, profile, sketches
from panelspark.registry import fault_log, labelled, panel, query, rounded, table
from panelspark.session import new_path

COLS = schema.SENSORS


def _faulty(spark, sf):
    """The labelled panel with a 0/1 ``tag``."""
    return labelled(spark, sf).withColumn("tag", (F.col("tag") > 0).cast("int"))


FAULTY = "faulty AS (SELECT * REPLACE (CAST(tag > 0 AS INT) AS tag) FROM labelled)"


def long_sql(columns, source: str, *keep: str) -> str:
    extra = "".join(f", {k}" for k in keep)
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value{extra} FROM {source}" for c in columns)


@query(
    "records_per_month",
    "SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, count(*) AS n FROM orders GROUP BY 1, 2",
)
def records_per_month(spark, sf):
    return profile.records_per_month(table(spark, sf, "orders"), "o_orderdate")


@query(
    "faults_per_month_by_model",
    f"""WITH {FAULTY} SELECT CAST(year(dt) AS INT) AS year, CAST(month(dt) AS INT) AS month,
       count(*) FILTER (WHERE tag = 1 AND model = 1) AS model_one, count(*) FILTER (WHERE tag = 1 AND model = 2) AS model_two
       FROM faulty GROUP BY 1, 2""",
    ("labelled",),
)
def faults_per_month_by_model(spark, sf):
    return profile.faults_per_month_by_model(_faulty(spark, sf))


@query(
    "fault_vs_normal_per_month",
    f"""WITH {FAULTY} SELECT CAST(year(dt) AS INT) AS year, CAST(month(dt) AS INT) AS month,
       count(*) FILTER (WHERE tag = 1) AS fault_disk, count(*) FILTER (WHERE tag = 0) AS normal_disk FROM faulty GROUP BY 1, 2""",
    ("labelled",),
)
def fault_vs_normal_per_month(spark, sf):
    return profile.fault_vs_normal_per_month(_faulty(spark, sf))


@query(
    "fault_ratio_by_weekday",
    f"""WITH {FAULTY} SELECT CAST(isodow(dt) - 1 AS INT) AS weekday, count(*) FILTER (WHERE tag = 1) AS fault_disk,
       count(*) FILTER (WHERE tag = 0) AS normal_disk,
       round_even(count(*) FILTER (WHERE tag = 1) / count(*) FILTER (WHERE tag = 0), 7) AS ratio
       FROM faulty WHERE dt >= DATE '2024-01-02' AND dt <= DATE '2024-01-29' GROUP BY 1""",
    ("labelled",),
)
def fault_ratio_by_weekday(spark, sf):
    df = _faulty(spark, sf).filter("dt >= DATE '2024-01-02' AND dt <= DATE '2024-01-29'")
    return profile.fault_ratio_by_weekday(df)


@query(
    "fault_type_matrix",
    "SELECT strftime(fault_time, '%Y-%m') AS month, "
    + ", ".join(f"count(*) FILTER (WHERE tag = {k}) AS tag_{k}" for k in range(7))
    + ", count(*) AS n FROM fault GROUP BY 1",
    ("fault",),
)
def fault_type_matrix(spark, sf):
    return profile.fault_type_matrix(fault_log(spark, sf))


@query("value_counts", "SELECT tag, count(*) AS n FROM labelled GROUP BY 1", ("labelled",))
def value_counts(spark, sf):
    return profile.value_counts(labelled(spark, sf), "tag")


@query(
    "describe",
    f"""SELECT "column", count(value) AS count, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS std,
       round(min(value), 6) + 0.0 AS min, round(quantile_cont(value, 0.25), 6) + 0.0 AS q25, round(quantile_cont(value, 0.5), 6) + 0.0 AS q50,
       round(quantile_cont(value, 0.75), 6) + 0.0 AS q75, round(max(value), 6) + 0.0 AS max
       FROM ({long_sql(COLS, "panel")}) GROUP BY 1""",
    ("panel",),
)
def describe(spark, sf):
    return rounded(profile.describe(panel(spark, sf), COLS))


@query(
    "boxplot_stats",
    f"""SELECT "column", flag, count(value) AS n, round(min(value), 6) + 0.0 AS min, round(quantile_cont(value, 0.25), 6) + 0.0 AS q25,
       round(quantile_cont(value, 0.5), 6) + 0.0 AS q50, round(quantile_cont(value, 0.75), 6) + 0.0 AS q75, round(max(value), 6) + 0.0 AS max
       FROM ({long_sql(COLS, "labelled", "flag")}) GROUP BY 1, 2""",
    ("labelled",),
)
def boxplot_stats(spark, sf):
    return rounded(profile.boxplot_stats(labelled(spark, sf), COLS, "flag"))


@query(
    "null_counts_by_label",
    "SELECT tag, " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in COLS + ["smart_240raw"]) + " FROM labelled GROUP BY 1",
    ("labelled",),
)
def null_counts_by_label(spark, sf):
    return profile.null_counts_by_label(labelled(spark, sf), COLS + ["smart_240raw"])


@query(
    "records_per_disk_hist",
    """WITH c AS (SELECT l_suppkey, count(*) AS records FROM lineitem GROUP BY 1),
       b AS (SELECT min(records) AS lo, max(records) AS hi FROM c)
       SELECT CAST(least(floor((records - lo) / ((hi - lo) / 10)), 9) AS INT) AS bin, count(*) AS disks FROM c CROSS JOIN b GROUP BY 1""",
)
def records_per_disk_hist(spark, sf):
    return profile.records_per_disk_histogram(table(spark, sf, "lineitem"), keys=["l_suppkey"])


def _density_sql(transform: str) -> str:
    return f"""WITH v AS (SELECT "column", {transform} AS value, dt < DATE '2024-01-16' AS early FROM ({long_sql(COLS, "panel", "dt")})),
       k AS (SELECT * FROM v WHERE value IS NOT NULL),
       b AS (SELECT "column", min(value) AS lo, max(value) AS hi, count(*) FILTER (WHERE early) AS na, count(*) FILTER (WHERE NOT early) AS nb FROM k GROUP BY 1)
       SELECT "column", CAST(CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / 50)), 49) ELSE 0 END AS INT) AS bin,
       round(count(*) FILTER (WHERE early) / any_value(na), 6) AS first_share, round(count(*) FILTER (WHERE NOT early) / any_value(nb), 6) AS second_share
       FROM k JOIN b USING ("column") GROUP BY 1, 2"""


def _density(spark, sf, log):
    df = panel(spark, sf)
    return rounded(profile.density_profile(df.filter("dt < DATE '2024-01-16'"), df.filter("dt >= DATE '2024-01-16'"), COLS, 50, log))


@query("density_profile", _density_sql("value"), ("panel",))
def density_profile(spark, sf):
    return _density(spark, sf, False)


@query("density_profile_log", _density_sql("CASE WHEN value = 0 THEN 0 WHEN value > 0 THEN ln(value) END"), ("panel",))
def density_profile_log(spark, sf):
    return _density(spark, sf, True)


@query(
    "sketch_profile",
    f"""SELECT "column", count(*) AS rows, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 4) + 0.0 AS std,
       min(value) AS min, max(value) AS max, true AS quantiles_close, true AS distinct_close
       FROM ({long_sql(COLS, "(SELECT * FROM panel WHERE dt BETWEEN DATE '2024-01-06' AND DATE '2024-01-25')")}) GROUP BY 1""",
    ("panel",),
)
def sketch_profile(spark, sf):
    """A span's profile from stored daily sketches; the sketched parts are held against the rows: quantiles within
    1 % of the rank, distinct values within 3 %."""
    df, path = panel(spark, sf), new_path(spark, "sketches")
    sketches.store_sketches(sketches.sketch_periods(df, COLS, "yyyyMMdd"), path)
    told = sketches.profile_of(sketches.merge_sketches(sketches.read_sketches(spark, path, 20240106, 20240125)))
    span = profile.stacked(df.filter("dt BETWEEN '2024-01-06' AND '2024-01-25'"), COLS).join(told, "column")
    share = lambda hit: F.count_if(hit) / F.count("value")
    close = [
        (share(F.col("value") < F.col(f"q{i}")) - 0.01 <= p) & (share(F.col("value") <= F.col(f"q{i}")) + 0.01 >= p) for i, p in enumerate((0.25, 0.5, 0.75))
    ]
    exact = F.count_distinct("value")
    held = span.groupBy("column").agg(
        (close[0] & close[1] & close[2]).alias("quantiles_close"),
        (F.abs(exact - F.first("distinct")) <= F.greatest(F.lit(1), exact * 0.03)).alias("distinct_close"),
    )
    return told.join(held, "column").select("column", "rows", "n", F.round("mean", 6).alias("mean"), F.round("std", 4).alias("std"), "min", "max", "quantiles_close", "distinct_close")


@query(
    "minmax_distinct_compare",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS dataset, "column", count(DISTINCT value) + max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS distinct_values,
            max(value) AS max, min(value) AS min FROM ({long_sql(COLS, f"(SELECT * FROM panel WHERE dt {cond})")}) GROUP BY 2"""
        for name, cond in (("first", "< DATE '2024-01-16'"), ("second", ">= DATE '2024-01-16'"))
    ),
    ("panel",),
)
def minmax_distinct_compare(spark, sf):
    df = panel(spark, sf)
    return profile.minmax_distinct(df.filter("dt < DATE '2024-01-16'"), df.filter("dt >= DATE '2024-01-16'"), COLS)


@query(
    "class_balance",
    """SELECT count(*) FILTER (WHERE tag > 0) AS positives, count(*) FILTER (WHERE tag = 0) AS negatives,
       round_even(count(*) FILTER (WHERE tag > 0) / count(*) FILTER (WHERE tag = 0), 5) AS ratio FROM labelled""",
    ("labelled",),
)
def class_balance(spark, sf):
    return profile.class_balance(labelled(spark, sf))


@query(
    "category_share",
    """WITH l AS (SELECT 'p_brand' AS "column", p_brand AS value FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part
                  UNION ALL SELECT 'p_type', p_type FROM part),
       n AS (SELECT "column", count(*) AS total, count(DISTINCT value) AS k FROM l GROUP BY 1)
       SELECT "column", value, round_even(count(*) / any_value(total), 3) AS share FROM l JOIN n USING ("column")
       WHERE k >= 5 GROUP BY 1, 2 HAVING round_even(count(*) / any_value(total), 3) > 0.005""",
)
def category_share(spark, sf):
    return profile.category_share(table(spark, sf, "part"), ["p_brand", "p_size", "p_type"])


@query(
    "disk_class_counts",
    """WITH d AS (SELECT model, serial_number, max(tag) > 0 AS f FROM labelled GROUP BY 1, 2)
       SELECT count(*) FILTER (WHERE f) AS fault_disks, count(*) FILTER (WHERE NOT f) AS normal_disks,
       round(count(*) FILTER (WHERE f) / count(*) FILTER (WHERE NOT f), 6) AS ratio FROM d""",
    ("labelled",),
)
def disk_class_counts(spark, sf):
    return rounded(profile.disk_class_counts(labelled(spark, sf)))


@query("crosstab", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def crosstab(spark, sf):
    return profile.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


NOMINAL = ["l_returnflag", "l_linestatus", "l_linenumber"]
PAIRS = list(itertools.permutations(NOMINAL, 2))


def _entropy_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b, s_x, s_xy FROM
      (SELECT -sum(p * ln(p)) AS s_x FROM (SELECT count(*) / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY {a})),
      (SELECT sum(pxy * ln(py / pxy)) AS s_xy FROM (SELECT count(*) / (SELECT count(*) FROM lineitem) AS pxy, {b} AS y FROM lineitem GROUP BY {a}, {b}) c
       JOIN (SELECT count(*) / (SELECT count(*) FROM lineitem) AS py, {b} AS y FROM lineitem GROUP BY {b}) d USING (y))"""


_ENTROPY = " UNION ALL ".join(_entropy_sql(a, b) for a, b in PAIRS)


@query("conditional_entropy", f"SELECT col_a, col_b, round(s_xy, 6) + 0.0 AS conditional_entropy FROM ({_ENTROPY})")
def conditional_entropy(spark, sf):
    return rounded(assoc.entropies(table(spark, sf, "lineitem"), PAIRS).select("col_a", "col_b", "conditional_entropy"))


@query("theils_u", f"SELECT col_a, col_b, round((s_x - s_xy) / s_x, 6) + 0.0 AS theils_u FROM ({_ENTROPY})")
def theils_u(spark, sf):
    return rounded(assoc.entropies(table(spark, sf, "lineitem"), PAIRS).select("col_a", "col_b", "theils_u"))


def _cramer_sql(source: str, a: str, b: str) -> str:
    """All cells of the table, empty ones too, with the continuity correction where it is 2×2."""
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b, chi2, sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1))
      / least(k - (k - 1) * (k - 1) / (n - 1) - 1, r - (r - 1) * (r - 1) / (n - 1) - 1)) AS v FROM (
      SELECT any_value(t.n) AS n, any_value(t.r) AS r, any_value(t.k) AS k,
        sum(CASE WHEN t.r = 2 AND t.k = 2 THEN pow(abs(coalesce(o, 0) - e) - least(0.5, abs(coalesce(o, 0) - e)), 2) / e
            ELSE pow(coalesce(o, 0) - e, 2) / e END) AS chi2
      FROM (SELECT x.v AS x, y.v AS y, x.c * y.c / t.n AS e FROM
             (SELECT {a} AS v, count(*) AS c FROM {source} GROUP BY 1) x,
             (SELECT {b} AS v, count(*) AS c FROM {source} GROUP BY 1) y, (SELECT count(*) AS n FROM {source}) t) g
      LEFT JOIN (SELECT {a} AS x, {b} AS y, count(*) AS o FROM {source} GROUP BY 1, 2) c USING (x, y),
      (SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT {a}) AS r, count(DISTINCT {b}) AS k FROM {source}) t)"""


@query(
    "cramers_v",
    "SELECT col_a, col_b, round(chi2, 6) + 0.0 AS chi2, round(v, 6) + 0.0 AS cramers_v FROM ("
    + " UNION ALL ".join(_cramer_sql("lineitem", a, b) for a, b in itertools.combinations(NOMINAL, 2))
    + ")",
)
def cramers_v(spark, sf):
    return rounded(assoc.cramers_v(table(spark, sf, "lineitem"), list(itertools.combinations(NOMINAL, 2))))


@query(
    "cramers_v_two_by_two",
    "SELECT col_a, col_b, round(chi2, 6) + 0.0 AS chi2, round(v, 6) + 0.0 AS cramers_v FROM (" + _cramer_sql("labels", "quality", "toxic") + ")",
)
def cramers_v_two_by_two(spark, sf):
    return rounded(assoc.cramers_v(table(spark, sf, "labels"), [("quality", "toxic")]))


def _eta_sql(source: str, category: str, columns, fill: str = "coalesce({c}, 0)") -> str:
    return " UNION ALL ".join(
        f"""SELECT '{category}' AS category, '{c}' AS "column", CASE WHEN b = 0 THEN 0 ELSE sqrt(b / t) END AS eta FROM (
            SELECT sum(n * pow(m - g, 2)) AS b, any_value(t) AS t FROM (SELECT count(*) AS n, avg({fill.format(c=c)}) AS m FROM {source} GROUP BY {category}),
            (SELECT avg({fill.format(c=c)}) AS g, var_pop({fill.format(c=c)}) * count(*) AS t FROM {source}))"""
        for c in columns
    )


ETA_COLS = schema.SENSORS


@query(
    "correlation_ratio",
    f"SELECT category, \"column\", round(eta, 6) + 0.0 AS eta FROM ({_eta_sql('labelled', 'tag', ETA_COLS)})",
    ("labelled",),
)
def correlation_ratio(spark, sf):
    return rounded(assoc.correlation_ratio(labelled(spark, sf), "tag", ETA_COLS))


P_COLS = schema.SENSORS


def _pearson_sql(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM {source}" for a, b in itertools.combinations(columns, 2)
    )


@query("pearson", f"SELECT col_a, col_b, round(r, 6) + 0.0 AS r FROM ({_pearson_sql('panel', P_COLS)})", ("panel",))
def pearson(spark, sf):
    return rounded(assoc.pearson(panel(spark, sf), list(itertools.combinations(P_COLS, 2))))


A_NUM = ["l_quantity", "l_extendedprice", "l_discount"]
A_NOM = ["l_returnflag", "l_linestatus"]


def _associations_sql(theil: bool) -> str:
    if theil:
        nom = " UNION ALL ".join(
            f"SELECT col_a, col_b, 'theils_u' AS measure, (s_x - s_xy) / s_x AS value FROM ({_entropy_sql(a, b)})"
            for a, b in itertools.permutations(A_NOM, 2)
        )
    else:
        v = _cramer_sql("lineitem", *A_NOM)
        nom = f"SELECT col_a, col_b, 'cramers_v' AS measure, v AS value FROM ({v}) UNION ALL SELECT col_b, col_a, 'cramers_v', v FROM ({v})"
    eta = " UNION ALL ".join(_eta_sql("lineitem", c, A_NUM, "{c}") for c in A_NOM)
    r = _pearson_sql("lineitem", A_NUM)
    diag = " UNION ALL ".join(f"SELECT '{c}', '{c}', 'self', 1" for c in A_NUM + A_NOM)
    return f"""SELECT col_a, col_b, measure, round(value, 6) + 0.0 AS value FROM ({nom}
       UNION ALL SELECT category, "column", 'eta', eta FROM ({eta}) UNION ALL SELECT "column", category, 'eta', eta FROM ({eta})
       UNION ALL SELECT col_a, col_b, 'pearson', r FROM ({r}) UNION ALL SELECT col_b, col_a, 'pearson', r FROM ({r})
       UNION ALL {diag})"""


@query("associations", _associations_sql(False))
def associations(spark, sf):
    return rounded(assoc.associations(table(spark, sf, "lineitem").select(*A_NUM, *A_NOM)))


@query("associations_theils_u", _associations_sql(True))
def associations_theils_u(spark, sf):
    return rounded(assoc.associations(table(spark, sf, "lineitem").select(*A_NUM, *A_NOM), theil_u=True))


KS_COLS = schema.SENSORS


@query(
    "ks_two_sample",
    f"""WITH v AS (SELECT "column", value, tag > 0 AS hit FROM ({long_sql(KS_COLS, "labelled", "tag")}) WHERE value IS NOT NULL),
       e AS (SELECT "column", count(*) FILTER (WHERE hit) OVER (PARTITION BY "column" ORDER BY value) AS a,
              count(*) FILTER (WHERE NOT hit) OVER (PARTITION BY "column" ORDER BY value) AS b,
              count(*) FILTER (WHERE hit) OVER (PARTITION BY "column") AS n1, count(*) FILTER (WHERE NOT hit) OVER (PARTITION BY "column") AS n2 FROM v),
       d AS (SELECT "column", n1, n2, max(abs(a / n1 - b / n2)) AS statistic FROM e GROUP BY 1, 2, 3),
       z AS (SELECT *, statistic * sqrt(n1 * n2 / (n1 + n2)) AS z FROM d)
       SELECT "column", n1, n2, round(statistic, 6) + 0.0 AS statistic,
       round(least(1, greatest(0, 2 * (SELECT sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * z * z)) FROM range(1, 200) t(k)))), 6) + 0.0 AS p_value FROM z""",
    ("labelled",),
)
def ks_two_sample(spark, sf):
    df = labelled(spark, sf).withColumn("tag", (F.col("tag") > 0).cast("int"))
    return rounded(assoc.ks_two_sample(df, "tag", KS_COLS))
