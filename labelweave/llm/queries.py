"""Registered queries of the operators: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import (
    bpe_count, byte_cnn, class_lm, conversation_repair, line_dedup, line_quality, nb_linear, order_join, phrase_index,
    raking, token_alignment, url_reputation, warc,
)
from labelweave.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
URL_RULES = (
    ("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"),
)
TOKENIZER = "byte_bpe_50k.json"


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@functools.cache
def vocabulary(name: str = TOKENIZER) -> str:
    """Content of a public vocabulary file, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of pages: the labels of the document of the same number; bad if of low quality or toxic."""
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False))) | (F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"),
        F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), bad).alias("bad"),
    )


@query
def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicated(table(spark, sf_dir, "pages"))


@query
def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.score_lines(table(spark, sf_dir, "documents"))


@query
def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), page_labels(spark, sf_dir), URL_RULES)


@query
def op6_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb_linear.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return digest.drop("n_near_items")


@query
def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.identify(table(spark, sf_dir, "documents"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of documents: the label of the vector of the same number."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic"))


@query
def op10_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mixture(table(spark, sf_dir, "documents"), topics(spark, sf_dir))


@query
def op9_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_join.linked(table(spark, sf_dir, "documents"))


@query
def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(table(spark, sf_dir, "documents"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path(TOKENIZER), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.alignment(table(spark, sf_dir, "documents"), a, b)


@query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("kept_text")
