"""A training corpus from raw documents: toxic and unidentifiable texts go, copies and near copies go, the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import ship
from quarry.llm import exact_dedup, jaccard_join, language_crf, packing, toxicity
from quarry.llm.common import Scratch, documents


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.3 or more; learns from the labelled documents outside the held-out quarter."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_remainder(4) != 2)
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, labels))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose words' likeliest languages have a mean probability below two fifths."""
    ship(spark)
    return language_crf.keep_identified(docs, language_crf.fit_language_crf(docs.where(_remainder(3) != 1)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the document of largest id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.75 or more of their 5-word shingles, the one of smallest id stays."""
    ship(spark)
    return jaccard_join.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens."""
    ship(spark)
    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("best_fit_packing", pack),
]
#: The first two stages are learned models and the last one is a heuristic over tokens: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again as the next stage's input."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
