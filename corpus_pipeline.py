"""From raw documents to shards: a pipeline of five stages over the table `documents`.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the columns of
`documents`. Null texts and empty ones pass the filters: they are not toxic, near nothing and leak nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdpeak.llm import decontamination, jaccard, mixing, sharding, toxicity
from crowdpeak.llm.store import free_name, settle

#: SQL can't express a trained classifier; tests compare the stages with plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score reaches the threshold of their language."""
    model, limits = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, name="toxicity_score")
    return scored.where(~toxicity.rejected(F.col("toxicity_score"), F.col("lang"), limits)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id (nulls last). Rows are told apart by id
    and text, so a repeated or null id neither drops nor saves another text; texts without words all stay."""
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage aligned with an item of the benchmark, whatever their id."""
    key, = free_name(docs, "leak_key")
    keyed = docs.withColumn(key, jaccard.row_key(docs))
    leaks = decontamination.find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=key)
    return keyed.join(leaks.select(F.col("carried").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as its source's budget asks for."""
    return mixing.mixed_rows(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their place in it."""
    return sharding.shard(docs, 8)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. Between stages the rows are cut from their lineage in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
