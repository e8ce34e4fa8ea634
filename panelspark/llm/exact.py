"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import SPACE, Scratch, anonymous, text_of, with_row

PREFIX_CHARS = 64


def without_space(text: Column) -> Column:
    """Normal form under which texts are compared: every white space character deleted."""
    return F.regexp_replace(text, SPACE, "")


def find_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", hash_all: bool = False) -> DataFrame:
    """One row per input row: ``__row, key, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their normal forms are. Rows are grouped by length, those of groups with
    several rows by a hash of the first characters, and only what survives both is hashed in full
    (``text_sha256`` is null for the others, unless ``hash_all`` asks for it). Of equal texts the row
    with most code points stays, then the smallest key (null last), then the first row. Null text is
    empty text; rows without text are copies of each other. Repeated rows are copies too.

    Groups are folded by partial aggregates before any shuffle; the one join by content carries
    slim rows, and Spark splits a hot key of it. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    own = docs.select(F.col(key).alias("c0"), F.col(text).alias("c1"))
    return _find(with_row(own, scratch), scratch, "c0", "c1", hash_all).withColumnRenamed("c0", key)


def _find(addressed: DataFrame, scratch: Scratch, key: str, text: str, hash_all: bool) -> DataFrame:
    plain = addressed.select(F.col(key).alias("__key"), text_of(text).alias("__text"), "__row")
    normal = without_space(F.col("__text"))
    rows = plain.select(
        "__row", "__key", F.length("__text").alias("__chars"), F.length(normal).alias("__length"),
        F.xxhash64(F.substring(normal, 1, PREFIX_CHARS)).alias("__prefix"),
        (F.sha2(normal, 256) if hash_all else normal).alias("__full"),
    )
    if hash_all:
        rows = scratch.write(rows, "rows")
    prefixes = rows.groupBy("__length", "__prefix").agg(F.count(F.lit(1)).alias("__n"))
    prefixes = scratch.write(prefixes, "prefixes")
    shared_length = prefixes.groupBy("__length").agg(F.sum("__n").alias("__m")).filter("__m > 1").select("__length")
    survivors = prefixes.join(shared_length, "__length", "left_semi").filter("__n > 1")
    survivors = survivors.select("__length", "__prefix", F.lit(True).alias("__alive"))
    marked = rows.join(survivors, ["__length", "__prefix"], "left")
    if not hash_all:
        full = F.when(F.col("__alive"), F.sha2("__full", 256))
        marked = scratch.write(marked.withColumn("__full", full), "hashed")
    best = F.min(F.struct((-F.col("__chars")).alias("__less"), F.col("__key").isNull().alias("__none"), "__key", "__row"))
    groups = (
        marked.filter("__alive").groupBy("__length", "__full")
        .agg(F.count(F.lit(1)).alias("__n"), best.alias("__best")).filter("__n > 1")
    )
    told = marked.join(groups, ["__length", "__full"], "left")
    alone = F.col("__n").isNull()
    return told.select(
        "__row",
        F.col("__key").alias(key),
        F.when(alone, F.col("__key")).otherwise(F.col("__best.__key")).alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("__best.__row") == F.col("__row"))).alias("kept"),
        F.col("__full").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    scratch = Scratch(docs.sparkSession, "exact")
    own, names = anonymous(docs)
    addressed = with_row(own, scratch)
    gone = _find(addressed, scratch, names[key], names[text], False).filter(~F.col("kept")).select("__row")
    return addressed.join(gone, "__row", "left_anti").select(*own.columns).toDF(*docs.columns)
