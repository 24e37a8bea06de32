"""A corpus pipeline: quality rules, near-duplicates, decontamination, source mixture, token shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept.  Every stage's result is written as Parquet in the shared
folder and read again, which cuts the lineage: a lost executor costs a stage's
tasks, not those of the stages before it.

1. quality rules: documents that the rules reject go;
2. n-gram Jaccard join: of each class of near-duplicates one document stays,
   that of the least doc_id;
3. benchmark decontamination: documents that a benchmark item leaks into go;
4. source mixture: documents come as often as their source's weight asks for,
   in the order of the mixture;
5. token shards: the mixture is encoded and written, by identifier, with its
   order beside; the rows returned are what the files hold, one for each
   document of the mixture.

A stage's own tables go as soon as its result is written; shards stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataq.llm import decontaminate, jaccard_join, mixture, quality, token_shards
from strataq.llm._store import Scope, drop, kept


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_shards.shard_documents(docs, ordered=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixture),
    ("token-ID / binary output", token_output),
]
#: SQL has neither the tokenizer nor the mixture's hashes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES):
        with Scope(spark) as scope:
            table = kept(stage(spark, docs, sf_dir), f"pipeline-{k}")
            docs = scope.keep(table)
        drop(spark, *done)  # what only this stage has read
        done = [table[1]]
    return docs
