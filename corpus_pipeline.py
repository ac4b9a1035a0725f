"""The corpus pipeline: language, near copies, benchmark leaks, mixture, shards, each stage one operator of ``stepwise.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.llm import decontam, langid, mixing, neardup, shards
from stepwise.llm.textbuf import spread_files, stored
from stepwise.session import ensure_checkpoint_dir, ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; without a letter, or mostly words like none of them, they go.

    The model is learned from the labelled documents of the stage's input.
    """
    ship_package(spark)
    docs = spread_files(docs)
    rest = [c for c in docs.columns if c.lower() != "text"]
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    found = langid.predict(packed, langid.train(docs))
    return found.where(langid.accepted(found)).select(*[F.col(f"row.`{c}`") if c in rest else F.col("text").alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    return neardup.deduplicated(spread_files(docs))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of the benchmark."""
    ensure_checkpoint_dir(spark)
    return decontam.clean(spread_files(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, as often as it takes them."""
    ensure_checkpoint_dir(spark)
    return mixing.mixture(spread_files(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document of the mixture."""
    ensure_checkpoint_dir(spark)
    return shards.shard(spread_files(docs))


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("mixture", mixture), ("sharding", sharding)]

#: Expectation-maximisation and consistent sampling have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
