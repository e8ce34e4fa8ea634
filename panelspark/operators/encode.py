"""Fitted encodings: bins, scaling, vocabularies, codes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import scalar
from panelspark.operators import clean, ordering, profile
from panelspark.schema import columns_of_type


def fit_equal_width(df: DataFrame, value: Column | str, bins: int) -> list[float]:
    """Edges of ``bins`` equal-width right-closed bins over the data; one row of statistics is read."""
    v = F.col(value) if isinstance(value, str) else value
    row = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if row["lo"] is None:
        raise ValueError("cannot cut a column without values")
    return scalar.equal_width_edges(row["lo"], row["hi"], bins)


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations fitted on training data."""

    mean: dict[str, float]
    std: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(self.mean[c])) / F.lit(self.std[c]) for c in self.mean})


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    # A column without spread is only centred; one without values stays NULL whatever is used.
    return Scaler({c: row[f"m_{c}"] or 0.0 for c in columns}, {c: row[f"s_{c}"] or 1.0 for c in columns})


def log_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: scalar.log2p1(c) for c in columns})


def month_weights(df: DataFrame, year: int, month: int, date: str = "dt") -> DataFrame:
    """Decay weight of each calendar month of the data: ``(year, month, gap, weight)``.

    Months are ordered by their gap to ``year``-``month`` and the gaps handed out in reverse, so the
    nearest month gets the largest, divided by the sum of all gaps.
    """
    months = df.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(
        F.first(scalar.month_gap(F.make_date(F.year(date), F.month(date), F.lit(1)), year, month)).alias("gap")
    )
    listed = months.agg(F.sort_array(F.collect_list(F.struct("gap", "year", "month"))).alias("m"), F.sum("gap").alias("total"))
    return listed.select("m", "total", F.posexplode("m").alias("i", "e")).select(
        "e.year", "e.month", "e.gap",
        F.try_divide(F.element_at("m", -F.col("i") - 1)["gap"], F.col("total")).alias("weight"),
    )


def factorize(df: DataFrame, column: str, order: str, code: str = "code") -> DataFrame:
    """Number the values of a column in order of first appearance; NULL gets −1."""
    firsts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.min(order).alias("__first"))
        .withColumn("__one", F.lit(1))
    )
    codes = ordering.running_totals(firsts, [], "__first", ["__one"]).select(column, F.col("__one_before").cast("int").alias(code))
    return df.join(codes, column, "left").withColumn(code, F.coalesce(code, F.lit(-1)))


def rare_to_other(df: DataFrame, column: str, limit: float = 0.005) -> DataFrame:
    """Replace values outside the frequent ones by ``other``. The frequent ones hold more than
    ``limit`` of the rows each, so there are fewer than 1/``limit`` of them; Spark sees their size."""
    kept = profile.category_share(df, [column], limit=limit, least_categories=0).select(
        F.col("value").alias(column), F.lit(True).alias("__kept")
    )
    return (
        df.join(kept, column, "left")
        .withColumn(column, F.when(F.col("__kept"), F.col(column)).otherwise(F.lit("other")))
        .select(*df.columns)
    )


def fit_vocabulary(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> dict[str, list[str]]:
    """Values of each category column in order of first appearance, for the dense forms, where each value
    becomes an output column. For many values use :func:`fit_codes` and :func:`sparse_one_hot`, which keep them
    in a table."""
    text = df.select(F.struct(*order).alias("__o"), *[F.col(c).cast("string").alias(c) for c in columns])
    rows = (
        text.unpivot(["__o"], list(columns), "column", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.min("__o").alias("first"))
        .orderBy("first")
        .collect()
    )
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        out[r["column"]].append(r["value"])
    return out


def fit_codes(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Code table ``column, value, code, size``: values of each column numbered from 0 in order of first appearance,
    and their number. Of any length; nothing of it comes to the driver."""
    text = df.select(F.struct(*order).alias("__o"), *[F.col(c).cast("string").alias(c) for c in columns])
    firsts = (
        text.unpivot(["__o"], list(columns), "column", "value").filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.min("__o").alias("__first")).withColumn("__one", F.lit(1).cast("long"))
    )
    placed = ordering.running_totals(firsts.withColumn("__at", F.struct("__first", "value")), ["column"], "__at", ["__one"])
    sizes = firsts.groupBy("column").agg(F.count(F.lit(1)).alias("size"))
    return placed.join(sizes, "column").select("column", "value", F.col("__one_before").cast("int").alias("code"), F.col("size").cast("int").alias("size"))


def add_codes(df: DataFrame, codes: DataFrame, columns: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Add ``<column><suffix>``: the value's code; NULL and values that were not fitted get -1. Spark sees the
    size of the code table and joins accordingly."""
    out = df
    for c in columns:
        own = codes.filter(F.col("column") == c).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        joined = out.join(own, F.col(c).cast("string") == F.col("__value"), "left")
        out = joined.withColumn(f"{c}{suffix}", F.coalesce("__code", F.lit(-1))).drop("__value", "__code")
    return out


def sparse_one_hot(df: DataFrame, codes: DataFrame, columns: Sequence[str], name: str = "one_hot") -> DataFrame:
    """Add ``name``: one sparse vector with a place for each value of each column; a column that is NULL or has
    a value that was not fitted adds nothing. Only the number of values per column is known to the driver."""
    sizes = {r["column"]: r["size"] for r in codes.select("column", "size").distinct().collect()}
    used = [c for c in columns if sizes.get(c)]
    coded = add_codes(df, codes, used, "__c")
    # One place more per column takes the values without a code; it is the encoder's last category, which it drops.
    places = {c: F.when(F.col(f"{c}__c") < 0, F.lit(sizes[c])).otherwise(F.col(f"{c}__c")).cast("double") for c in used}
    kinds = {c: NominalAttributes(sizes[c] + 1) for c in used}
    coded = coded.select("*", *[p.alias(f"{c}__p", metadata=kinds[c].metadata(f"{c}__p")) for c, p in places.items()])
    hot = OneHotEncoder(inputCols=[f"{c}__p" for c in used], outputCols=[f"{c}__h" for c in used], dropLast=True)
    whole = VectorAssembler(inputCols=[f"{c}__h" for c in used], outputCol=name)
    if not used:
        return df.withColumn(name, F.lit(None).cast(VectorUDT()))
    return Pipeline(stages=[hot, whole]).fit(coded).transform(coded).select(*df.columns, name)


@dataclass(frozen=True)
class NominalAttributes:
    """How many values a column of codes can take, as column metadata, so that no fit has to look."""

    values: int

    def metadata(self, name: str) -> dict:
        return {"ml_attr": {"type": "nominal", "name": name, "num_vals": self.values}}


def one_hot_columns(df: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """Replace each column by one 0/1 column per value of its fitted vocabulary."""
    keep = [F.col(c) for c in df.columns if c not in vocabulary]
    dummies = [d for c, values in vocabulary.items() for d in scalar.one_hot(F.col(c).cast("string"), sorted(values), c)]
    return df.select(*keep, *dummies)


def numerical_encoding(
    df: DataFrame,
    order: Sequence[str],
    nominal: Sequence[str] | str | None = "auto",
    drop_single_label: bool = False,
    missing: str = "replace",
    missing_value: float = 0.0,
) -> DataFrame:
    """Numbers only: a nominal column with one value becomes 0 (or is dropped), with two values a
    0/1 code by first appearance, with more a set of 0/1 columns; numeric columns stay."""
    df = clean.missing_strategy(df, missing, missing_value)
    if nominal is None:
        return df
    if nominal == "auto":
        nominal = columns_of_type(df)
    elif nominal == "all":
        nominal = df.columns
    vocabulary = fit_vocabulary(df, list(nominal), order)
    out: list[Column] = []
    for c in df.columns:
        if c not in vocabulary:
            out.append(F.col(c))
            continue
        values, text = vocabulary[c], F.col(c).cast("string")
        if len(values) == 1:
            if not drop_single_label:
                out.append(F.lit(0).alias(c))
        elif len(values) == 2:
            out.append(F.when(text == values[0], 0).when(text == values[1], 1).otherwise(-1).alias(c))
        else:
            out.extend(scalar.one_hot(text, sorted(values), c))
    return df.select(*out)
