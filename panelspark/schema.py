"""Column names, fixed values and column roles of the sensor panel."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# Sensor choice, thresholds and weights that results depend on.
# ---------------------------------------------------------------------------------------------
NORMALIZED_SENSORS = [
    "smart_1_normalized",
    "smart_3_normalized",
    "smart_7_normalized",
    "smart_9_normalized",
    "smart_187_normalized",
    "smart_189_normalized",
    "smart_191_normalized",
    "smart_193_normalized",
    "smart_195_normalized",
]
RAW_SENSORS = [
    "smart_4raw",
    "smart_5raw",
    "smart_9raw",
    "smart_12raw",
    "smart_184raw",
    "smart_188raw",
    "smart_192raw",
    "smart_194raw",
    "smart_197raw",
    "smart_198raw",
    "smart_199raw",
]
ZERO_HEAVY_SENSORS = ["smart_184raw", "smart_188raw", "smart_197raw", "smart_198raw"]
SLOPE_SENSORS = ["smart_5raw"]
POWER_ON_HOURS = "smart_9raw"
NON_SLIDING_SENSORS = ["smart_9raw", "smart_9_normalized", "smart_187_normalized"]
ERROR_WEIGHTS = {
    "smart_1_normalized": 0.0016,
    "smart_5raw": 0.025,
    "smart_184raw": 0.0035,
    "smart_187_normalized": 0.018,
    "smart_195_normalized": 0.004,
    "smart_197raw": 0.019,
    "smart_198raw": 0.019,
}
SEEK_WEIGHTS = {
    "smart_7_normalized": 0.0053,
    "smart_189_normalized": 0.00099,
    "smart_191_normalized": 0.0058,
    "smart_194raw": 0.0011,
}
DEGRADATION_WEIGHTS = {
    "smart_3_normalized": 0.0049,
    "smart_9_normalized": 0.006,
    "smart_192raw": 0.0068,
    "smart_193_normalized": 0.00097,
}
COMBINED_SENSORS = {
    "err_weight": ERROR_WEIGHTS,
    "seek_err_weight": SEEK_WEIGHTS,
    "degradation_err_weight": DEGRADATION_WEIGHTS,
}
POWER_ON_DAY_EDGES = [-9999.0, 452.75, 905.5, 1358.25, 9999.0]
POWER_ON_DAY_BINS = 4
MISSING_CONTINUOUS = -1.234
MISSING_CATEGORY = 0
NULL_PERCENT_LIMIT = 30.0
DISTINCT_LIMIT = 1
FAULT_HORIZON_DAYS = 30
ALERT_QUANTILE = 0.996
ALERTS_PER_DAY = 40
EARLY_STOP_ROUNDS = 5
# ---------------------------------------------------------------------------------------------

SENSORS = NORMALIZED_SENSORS + RAW_SENSORS
DISK_KEY = ["model", "serial_number"]
INDEX_COLUMNS = ["dt", "serial_number", "model"]
LABEL_COLUMNS = ["tag", "flag", "30_day"]

FAULT_SCHEMA = T.StructType(
    [
        T.StructField("manufacturer", T.StringType()),
        T.StructField("model", T.IntegerType()),
        T.StructField("serial_number", T.StringType()),
        T.StructField("fault_time", T.StringType()),
        T.StructField("tag", T.IntegerType()),
    ]
)


def panel_schema(sensors: list[str] | None = None) -> T.StructType:
    """Names and types of the columns wanted from a sensor CSV."""
    fields = [
        T.StructField("dt", T.StringType()),
        T.StructField("manufacturer", T.StringType()),
        T.StructField("model", T.IntegerType()),
        T.StructField("serial_number", T.StringType()),
    ]
    fields += [T.StructField(c, T.DoubleType()) for c in (SENSORS if sensors is None else sensors)]
    return T.StructType(fields)


@dataclass(frozen=True)
class ColumnRoles:
    """Columns of a table split by what they are used for."""

    index: list[str] = field(default_factory=list)
    category: list[str] = field(default_factory=list)
    continuous: list[str] = field(default_factory=list)
    label: list[str] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return self.category + self.continuous


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def column_roles(df: DataFrame, categories: list[str] | None = None) -> ColumnRoles:
    """Index and label columns by name, numbers as continuous, the rest as categories.

    Derived category codes are plain integers in Spark, so their names come in ``categories``;
    by default any column ending in ``_cate`` or named ``model_type``.
    """
    if categories is None:
        categories = [c for c in df.columns if c.endswith("_cate") or c == "model_type"]
    index, category, continuous, label = [], [], [], []
    for f in df.schema.fields:
        if f.name in INDEX_COLUMNS:
            index.append(f.name)
        elif f.name in LABEL_COLUMNS:
            label.append(f.name)
        elif f.name not in categories and isinstance(f.dataType, _NUMERIC):
            continuous.append(f.name)
        else:
            category.append(f.name)
    return ColumnRoles(index, category, continuous, label)


def columns_of_type(df: DataFrame, types: tuple[type, ...] = (T.StringType, T.BooleanType)) -> list[str]:
    """Names of the columns whose Spark type is one of ``types`` (nominal columns by default)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types)]


def columns_with_token(df: DataFrame, token: str = "normalized", keep: bool = True) -> list[str]:
    """Columns with (or without) ``token`` among the ``_``-separated parts of their name."""
    return [c for c in df.columns if (token in c.split("_")) == keep]
