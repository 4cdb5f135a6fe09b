"""Corpus pipeline: five operators in turn over ``documents``.

Each stage gets the rows that the stage before kept, written as Parquet and read again, and returns rows with
the same columns; the last adds the shard.  Rows are decided one by one: rows without an id, or with another row's, are examined too.
A later read need not keep the order of the mixing stage, so the last stage places the rows again and sorts each shard by the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomtable.llm.decontaminate import rows_without_benchmark
from loomtable.llm.minhash import one_of_each
from loomtable.llm.mixing import mixed, mixed_order
from loomtable.llm.queries import (
    SHARDS, WEIGHTS, benchmark_hits_sql, near_duplicate_sql, quality_rules_sql, shard_sql)
from loomtable.llm.rules import passing
from loomtable.llm.sharding import placed
from loomtable.llm.tables import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the one with the smallest id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    return rows_without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that mixes the sources to their weights."""
    return mixed_order(docs, WEIGHTS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the shard that each goes to, sorted by shard, then in the order of the mix."""
    mix = mixed(docs, WEIGHTS).select("row.*", F.col("slot").alias("_mix_slot"), F.col("place").alias("_mix_place"))
    order = ["shard", "_mix_slot", "_mix_place"]
    return placed(mix, "doc_id", SHARDS).repartitionByRange(*order).sortWithinPartitions(*order).drop("_mix_slot", "_mix_place")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]

ORACLE_SQL = f"""with recursive {quality_rules_sql('documents')},
passed as (select d.* from documents d join judged j using (doc_id) where j.kept),
{near_duplicate_sql('passed', 80)},
single as (select d.* from passed d join near using (doc_id) where component_id = doc_id),
{benchmark_hits_sql('single')}
select *, {shard_sql('doc_id')} as shard from single where doc_id not in (select doc_id from hits)"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
