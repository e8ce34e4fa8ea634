"""The registered queries of this subpackage: thin, over whole tables, by the operators beside it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import alignment, dialogue, exact, leaks, mixing, neardup, orderhash, packing, ppm, quality, substring, tokens, urls
from panelspark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op9_exact_dedup", r"""
    WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
            sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
            first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id FROM n)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.find_copies(table(spark, sf_dir, "documents"), hash_all=True).drop("__row")


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.filter(quality.remainder("doc_id", 5) != 0).select("doc_id", "quality")
    model = quality.fit(docs, known)
    scored = quality.add_score(docs.select("doc_id", "text"), model).drop("text")
    return scored.select(
        "doc_id", (quality.remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op1_mixing_sources")
def op1_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(table(spark, sf_dir, "documents"), max_repeats=2.0).drop("row")


@query("op2_order_minhash")
def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.edit_and_compare(table(spark, sf_dir, "documents"))


@query("op3_url_filters")
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    return urls.judge(table(spark, sf_dir, "pages"), rules)


@query("op5_ngram_jaccard_join")
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "n_links", "n_linked_texts", (F.col("first") == F.col("__row")).alias("kept"))


@query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), window=35)


@query("op4_ppm_scoring")
def op4_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), quality.remainder("doc_id", 7) != 2, order=5)


@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.damaged_report(table(spark, sf_dir, "conversations"))


@query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.aligned_documents(table(spark, sf_dir, "documents"), *paths)


@query("op13_secret_scan")
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.report(leaks.find_secrets(table(spark, sf_dir, "documents")))
