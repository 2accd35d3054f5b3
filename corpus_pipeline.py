"""A training corpus from the documents: good texts only, one of each group of near copies, personal data hidden, sources mixed, tokens."""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solea.llm.bpe import Vocabulary, add_ids_and_decoded
from solea.llm.jaccard import similar_classes
from solea.llm.mixing import mixed, place_in_mix
from solea.llm.pii import redact
from solea.llm.quality import keep_good
from solea.session import new_folder

ORACLE_SQL = None  # boosted trees, similarity components, span classifiers and BPE are beyond SQL; tests hold each stage against brute force


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 and more): that with the smallest id.

    Documents without words link with nothing and stay, and so do those without an id. Rows of equal id and text count once.
    """
    groups = similar_classes(docs, width=5, percent=80, lead=0.45)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    once = docs.join(kept, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return once.union(docs.where("doc_id IS NULL"))


def personal_data_hidden(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind."""
    return redact(docs)


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents in the order of the mix; each source's share of any stretch follows its target weight."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token ids, their number, the text that they decode to, and slot and position in the mix.

    Files are not read back in the order they were written in, so the place is worked out again: it depends on ids and sources only.
    """
    vocabulary = Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))
    encoded = add_ids_and_decoded(place_in_mix(docs.select("doc_id", "source", "text")), vocabulary)
    place = F.col("__slot").alias("slot"), F.col("__position").alias("position")
    return encoded.select("doc_id", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), "decoded_text", *place)


STAGES = [
    ("quality classifier", good_texts),
    ("n-gram Jaccard join", one_of_each),
    ("PII", personal_data_hidden),
    ("mixing sources", sources_mixed),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages after each other; each one's documents are written to the shared folder and read again by the next. Rows are in the order of the mix."""

    def apply(docs: DataFrame, stage) -> DataFrame:
        path = new_folder(spark, "corpus-stage")
        stage[1](spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return reduce(apply, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet")).orderBy("position")
