"""Documents to packed training sequences, stage by stage.

Every stage works on all rows that the one before kept; its result is written as Parquet and read
again. All but the last return the columns of ``documents``."""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siteloom.llm import jaccard, langid, mixing, packing, quality  # noqa: E402
from siteloom.llm.queries import TOKENIZER, language_profiles, training_fold  # noqa: E402
from siteloom.session import checkpoint_dir, ship_package  # noqa: E402
from siteloom.sources.tables import table  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are mostly content."""
    ship_package(spark)
    model = quality.fit_model(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model, keep=True)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: not far below what the training texts of it score."""
    ship_package(spark)
    profiles = language_profiles(docs)
    return langid.identified(docs, profiles, langid.low_scores(training_fold(docs), profiles))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    ship_package(spark)
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated probabilities. Columns that this stage does not read go along,
    whatever their names."""
    read = ("doc_id", "text", "source", "lang")
    own = [c if c in read else f"_given_{i}" for i, c in enumerate(docs.columns)]
    counted = mixing.with_tokens(docs.toDF(*own)).withColumn("topic", mixing.topic_of("text"))
    return mixing.mixed(counted).filter("kept").select(own).toDF(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    ship_package(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("mixing", mix),
    ("best_fit_packing", best_fit_packing),
]
#: Line labelling and n-gram ranking cannot be said in SQL; tests hold run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
