"""A corpus pipeline of five operators: each stage works on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import exact_dedup, langid, mixing, packing
from sigloom.llm import near_copies as near_copies_
from sigloom.llm.queries import tokenizer_path
from sigloom.sources.staging import remove, scratch, shared_dir

LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the fitted model knows; those without a letter, with a low score or little above a text in none of them go."""
    model = langid.fit(docs)
    return langid.keep_identified(docs, model, LEAST_SCORE, lift=langid.least_lift(docs, model))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked by a similarity of 0.8 or more in 5-word shingles the one with the smallest id."""
    return near_copies_.drop_near_copies(docs, shingle=5, least=0.8)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixing.mix_documents(docs)


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix in sequences of 1024 ids."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("near_copies", near_copies), ("mixing", mixing_sources), ("packing", packing_sequences)]

#: Language identification is fitted, fingerprints need XXH64 and ids a tokenizer: SQL cannot say what run() returns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage keeps for itself goes when it has written its rows, and those when the next one has read them."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
