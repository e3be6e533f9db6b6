"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame.  :func:`run` writes every
stage's result as Parquet into the folder all executors share and reads it again, so a
lost executor costs at most the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarifflow.llm import exact_dedup, mixing, packing, simhash, toxicity
from tarifflow.llm.common import set_aside, stage


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not call toxic."""
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    inner, names, own = set_aside(docs)
    return toxicity.score(inner, model, text=names["text"]).where("predicted = 0").select(own)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts."""
    return exact_dedup.deduplicate(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set whose fingerprints differ in few bits."""
    return simhash.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mixture; those of scarce sources come again."""
    inner, names, own = set_aside(docs)
    mixed = mixing.mix(inner, source=names["source"], id_col=names["doc_id"], text=names["text"])
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(own)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 4096."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("simhash near-dedup", simhash_stage),
    ("mix sources", mixing_stage),
    ("pack sequences", packing_stage),
]

# Neither the scores nor the fingerprints and token ids can be written in SQL; tests
# compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
