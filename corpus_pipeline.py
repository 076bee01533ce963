"""A corpus pipeline of the operators in ``sondeo.llm``; every stage takes and, but for the last, returns documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sondeo.llm import decontaminate, mixing, ngram_join, quality, sharding
from sondeo.llm.common import in_file_order, stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return docs.where(quality.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near copies."""
    return ngram_join.representatives(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return docs.where(~decontaminate.leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture of their sources."""
    return mixing.write_order(mixing.mix(docs))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, as read from files, with their shard and their slot in it: by the order of the files."""
    return sharding.shard(in_file_order(docs, "_position"), order="_position")


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", near_unique),
    ("benchmark decontamination", without_leaks),
    ("source mix", mixed),
    ("sharding", sharded),
]

#: Trained and greedy stages are not SQL; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each on what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "_"))
    return docs
