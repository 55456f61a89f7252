"""The corpus pipeline: five stages from raw documents to balanced shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and reread as the next stage's documents; all but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliomill.llm import decontam, langid, mixing, sharding, shingles, simhash
from foliomill.llm.scratch import discard, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised (operator 8)."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates.

    First those of equal or nearly equal fingerprints go (operator 2 with its own limits), then
    of what is left those whose five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    return shingles.keep_one(materialize(simhash.keep_one(docs)))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark is found (operator 4)."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mixture near the target weights; no document is taken twice (operator 7)."""
    return mixing.keep_selected(docs, share=0.9, epochs=1)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document that is left; related ones share a shard as far as there is room (operator 3).

    Equal texts are gone by now, so documents are linked by their least five-word shingle.
    """
    return sharding.assign(docs, group=sharding.least_shingle()).drop("linked")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: SQL can't express the language model and the fingerprints; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)  # only what a stage wrote is deleted, never the input
    return STAGES[-1][1](spark, docs, sf_dir)
