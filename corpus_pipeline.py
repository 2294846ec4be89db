"""Corpus preparation: stages over documents, each calling one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import decontamination, mixing, near_copies, sharding, toxicity
from helixframe.llm.common import materialize, table


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(docs, docs.columns)


STAGES = [("toxicity", detoxify), ("near-duplicates", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]
#: The models, graph components and seeded shuffles have no SQL form; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
