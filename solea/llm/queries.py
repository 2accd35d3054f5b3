"""Registered queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solea.llm import divergence, hard_negatives
from solea.llm.bpe import Vocabulary, token_digests
from solea.llm.html_text import extract_main_text
from solea.llm.jaccard import similar_classes
from solea.llm.mixing import mix_order
from solea.llm.near_vectors import near_vectors
from solea.llm.neighbours import nearest_neighbours
from solea.llm.pii import find_personal_data
from solea.llm.pseudo_likelihood import pseudo_likelihood
from solea.llm.quality import score_quality
from solea.llm.repeats import repeat_digests
from solea.llm.token_counts import PieceModel, count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@lru_cache(maxsize=2)
def vocabulary(name: str = "word_bpe_49k.json") -> Vocabulary:
    return Vocabulary.read(public_tokenizers.path(name))


@_register
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"), vocabulary())


@_register
def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


@_register
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@_register
def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(_table(spark, sf_dir, "documents"), width=3, percent=90)


@_register
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


@_register
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_order(_table(spark, sf_dir, "documents"))


@_register
def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(_table(spark, sf_dir, "documents"), length=200)


@_register
def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(_table(spark, sf_dir, "documents"))


@_register
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


@_register
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@lru_cache(maxsize=2)
def piece_model(name: str = "piece_bpe_32k.model") -> PieceModel:
    return PieceModel.read(public_tokenizers.path(name))


@_register
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), piece_model(), limit=4096)


@_register
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"), least_documents=3, top=200, scale=10**9)


@_register
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


ORACLES |= {"op12_divergence": divergence.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
