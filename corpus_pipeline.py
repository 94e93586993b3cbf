"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, source
mix, shards. Each stage takes (spark, docs, sf_dir), works on all that the one
before kept, and its result is written as Parquet and read again for the next.
All stages but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyfold.llm.common import stage
from keyfold.llm.decontaminate import decontaminated
from keyfold.llm.mixing import mixed
from keyfold.llm.sharding import shard_stage
from keyfold.llm.simhash import deduplicated
from keyfold.llm.toxicity import without_toxic
from keyfold.sources.tables import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney models reject go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document of the least id stays."""
    return deduplicated(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents made of them go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    return mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it."""
    return shard_stage(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages),
          ("source_mix", source_mix), ("shards", shards)]

#: The stages learn models and run iterations that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
