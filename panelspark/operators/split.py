"""Time-ordered splits with a gap, folds, and scaling fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import clean, combine, encode
from panelspark.operators.sampling import confirmed_faults, split_by_label
from panelspark.session import new_path

Span = tuple[str, str]


def gap_time_split(
    df: DataFrame,
    train: Span,
    valid: Span,
    gap: Span | None = None,
    prior_before: str | None = None,
    train_model: int | None = None,
    valid_model: int | None = None,
    strict_pair: bool = False,
) -> DataFrame:
    """Rows of both spans with a ``split`` column, ``train`` or ``valid``.

    Rows between the spans would leak labels, so of the ``gap`` only rows of disks confirmed to fail
    in it enter the training side; ``prior_before`` adds faulty rows from before that day. Each part
    is a date filter of the same table and reads only its own date partitions.
    """
    parts = [clean.in_date_range(df, *train)]
    if prior_before:
        parts.append(split_by_label(df.filter(F.col("dt") < F.lit(prior_before).cast("date")))[0])
    if gap:
        parts.append(confirmed_faults(clean.in_date_range(df, *gap), strict_pair))
    training = clean.of_model(combine.union_all(*parts), train_model)
    validation = clean.of_model(clean.in_date_range(df, *valid), valid_model)
    return training.withColumn("split", F.lit("train")).unionByName(validation.withColumn("split", F.lit("valid")))


def time_series_folds(df: DataFrame, train: Sequence[Span], valid: Sequence[Span]) -> DataFrame:
    """Rows repeated for each fold they belong to, with ``fold`` and ``split``.

    The folds are a short list of date ranges, so a row finds its folds by itself and one scan
    serves all of them.
    """
    if len(train) != len(valid):
        raise ValueError("train and valid need one span per fold")
    day = F.col("dt")
    entries = []
    for i, (t, v) in enumerate(zip(train, valid)):
        for span, name in ((t, "train"), (v, "valid")):
            inside = day.between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date"))
            entries.append(F.when(inside, F.struct(F.lit(i).alias("fold"), F.lit(name).alias("split"))))
    hits = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return df.withColumn("__f", F.explode(hits)).select(*df.columns, "__f.fold", "__f.split")


def store_folds(folds: DataFrame) -> DataFrame:
    """The rows of :func:`time_series_folds` written by ``fold`` and ``split``, so that a filter on them reads
    the files of that fold alone."""
    path = new_path(folds.sparkSession, "folds")
    folds.write.partitionBy("fold", "split").parquet(path)
    return folds.sparkSession.read.schema(folds.schema).parquet(path)


def scale_train_valid(df: DataFrame, columns: Sequence[str], log: bool = False, standard: bool = True) -> DataFrame:
    """Scale a table with a ``split`` column, with statistics of its training rows."""
    if log:
        df = encode.log_scale(df, columns)
    if standard:
        df = encode.fit_scaler(df.filter(F.col("split") == "train"), columns).apply(df)
    return df
