"""Stages that turn raw documents into packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; each result is
written to the shared folder and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import exact, mixing, neardup, packing, quality
from panelspark.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose probability of label 1 is lower are rejected.
LEAST_QUALITY = 0.3
#: No source is drawn more often; every document is drawn at least once.
MOST_REPEATS = 2.0


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject. It is fitted on the labelled rows of
    ``docs`` (a bounded sample of them); without both labels nothing is rejected."""
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    if not any(model.weights[:-1]):
        return docs
    return quality.add_score(docs, model, name="__score").filter(F.col("__score") >= LEAST_QUALITY).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact.drop_copies(docs.select(*COLUMNS))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (5-word shingles, similarity 0.8), the smallest doc_id."""
    return neardup.drop_near_duplicates(docs.select(*COLUMNS))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources again, up to ``MOST_REPEATS`` in the mean."""
    return mixing.mix_rows(docs.select(*COLUMNS), max_repeats=MOST_REPEATS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens; one row per piece of a drawn document."""
    return packing.pack(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing_sources", mixing_sources),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the tokenizer and the packing have no SQL form; see tests/llm for the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
