"""Corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage reads what its predecessor wrote and returns a DataFrame; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import decontamination, mixing, sharding, simhash, toxicity
from strandgraph.llm.common import table
from strandgraph.plans.lineage import discard, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the smallest doc_id stays."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in training order, as often as their source's target takes them."""
    return mixing.training_order(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Globally shuffled shards of equal counts: the documents with shard and slot, in this order within each file."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    return sharding.shuffled_shards(docs, size=size).sortWithinPartitions("shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The stages train a classifier and shuffle by hashes that SQL does not have; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    The last one lies in a folder per shard, in slot order within each file. The folder of a stage goes once its
    successor is written, the last one's stays.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path, result = f"{base}/{k}-{name}", stage(spark, docs, sf_dir)
        if stage is shard:
            sharding.write_shards(result, path)
        else:
            result.write.parquet(path)
        if k:
            discard(docs)
        docs = spark.read.schema(result.schema).parquet(path).select(*result.columns)
    return docs
