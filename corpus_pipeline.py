"""Documents to a mixed, encoded training corpus, in five stages; each reads what the one before has written."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.bpe import bpe_round_trip
from tablescope.llm.minhash import deduplicated
from tablescope.llm.mixing import mix
from tablescope.llm.quality import quality_scores
from tablescope.llm.scratch import Scratch
from tablescope.llm.toxicity import toxicity_scores
from tablescope.llm.workers import importable

TOXIC_FROM = 0.5
GOOD_FROM = 0.7
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def _every_label() -> Column:
    return F.lit(True)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic."""
    train, labels = _labelled(spark, sf_dir)
    return toxicity_scores(docs, train, labels, _every_label(), COLUMNS).filter(F.col("score") < TOXIC_FROM).drop("score")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good."""
    train, labels = _labelled(spark, sf_dir)
    return quality_scores(docs, train, labels, _every_label(), COLUMNS).filter(F.col("score") >= GOOD_FROM).drop("score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near-duplicates (shingles of five words, similarity of 0.8)."""
    importable(spark)
    return deduplicated(docs, Scratch(spark, "near_dedup"), keep=COLUMNS[2:]).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    importable(spark)
    mixed = mix(docs.select(*COLUMNS), Scratch(spark, "mixing"), keep=("text", "lang", "n_chars"))
    return mixed.filter("repeats > 0").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text, and of the bytes that its ids decode to."""
    importable(spark)
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ("doc_id", "lang", "source", "n_chars"))


STAGES = [("toxicity", toxicity), ("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("mixing", mixing), ("byte-level BPE", encoding)]

# Classifiers and byte-level BPE cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs
