"""Named queries over the driver's tables, each with the SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import calendar, clean, label
from panelspark.sources.standin import FAULT_SQL, PANEL_SQL, fault_log, panel, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# The stand-in panel spans 30 days, so registered queries label with a 7-day horizon.
HORIZON = 7

_CTES = {
    "panel": PANEL_SQL,
    "fault": FAULT_SQL,
    "first_fault": """SELECT manufacturer, model, serial_number, arg_min(fault_time, list_order) AS fault_time,
        arg_min(tag, list_order) AS fault_tag FROM fault GROUP BY 1, 2, 3""",
    "labelled": """SELECT p.*,
        CAST(CASE WHEN date_diff('day', p.dt, f.fault_time) BETWEEN 0 AND 7 THEN f.fault_tag + 1 ELSE 0 END AS TINYINT) AS tag,
        CAST(CASE WHEN date_diff('day', p.dt, f.fault_time) = 0 THEN 1 ELSE 0 END AS TINYINT) AS flag,
        CAST(CASE WHEN date_diff('day', p.dt, f.fault_time) = 7 THEN 1 ELSE 0 END AS TINYINT) AS "30_day"
        FROM panel p LEFT JOIN first_fault f USING (manufacturer, model, serial_number)""",
    "powered": "SELECT * FROM labelled WHERE smart_9raw IS NULL OR smart_9raw <> 0",
    "days": """SELECT model, serial_number, CAST(unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS DATE) AS day
        FROM powered GROUP BY model, serial_number""",
    "dense": """SELECT d.day, d.day = p.dt AS observed, p.* FROM days d ASOF JOIN powered p
        ON d.model = p.model AND d.serial_number = p.serial_number AND d.day >= p.dt""",
    "scored": """SELECT *, CAST((CAST(split_part(serial_number, '_', 2) AS INT) * 37 + extract(day FROM dt) * 101) % 97 AS DOUBLE) / 97
        AS prob FROM labelled""",
}
_NEEDS = {
    "panel": [],
    "fault": [],
    "first_fault": ["fault"],
    "labelled": ["panel", "first_fault"],
    "powered": ["labelled"],
    "days": ["powered"],
    "dense": ["days"],
    "scored": ["labelled"],
}


def with_views(sql: str, *views: str) -> str:
    """Prefix ``sql`` with the named views and all they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS[name]:
            add(need)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    text = sql.strip()
    head = ",\n".join(f"{n} AS ({_CTES[n].strip()})" for n in order)
    if not head:
        return text
    if text[:5].upper() == "WITH ":
        return f"WITH {head},\n{text[5:]}"
    return f"WITH {head}\n{text}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn

    return register


def r6(c: Column | str) -> Column:
    """Six digits, so that engines that add in another order still agree."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating-point column."""
    return df.select(
        *[F.round(F.col(n).cast("double"), digits).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes]
    )


def labelled(spark: SparkSession, sf: str, horizon: int = HORIZON) -> DataFrame:
    return label.label_before_failure(panel(spark, sf), fault_log(spark, sf), horizon)


def powered(spark: SparkSession, sf: str) -> DataFrame:
    return clean.powered_on(labelled(spark, sf))


def dense(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    df = powered(spark, sf)
    if columns:
        df = df.select("serial_number", "model", "dt", *columns)
    return calendar.fill_calendar(df)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled panel with a fixed score column, for queries that need no model."""
    user = F.split_part("serial_number", F.lit("_"), F.lit(2)).cast("int")
    return labelled(spark, sf).withColumn(
        "prob", ((user * 37 + F.dayofmonth("dt") * 101) % 97).cast("double") / 97
    )


__all__ = [
    "HORIZON", "ORACLE", "QUERIES", "dense", "fault_log", "labelled", "panel", "powered", "query", "r6",
    "rounded", "scored", "table", "with_views",
]


def load_all() -> None:
    """Import every module that registers queries."""
    from panelspark.registry import (  # noqa: F401
        cleaning,
        evaluation,
        features,
        joins,
        models,
        profiling,
        ranking,
        sampling,
        scalars,
        storage,
    )
