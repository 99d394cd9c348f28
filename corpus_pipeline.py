"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of documents.
Columns that documents has besides its own pass through every stage with their values, whatever their names, but for slot, shard and map_version, which the last one
sets. An empty table passes as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import decontaminate, fertility, mixing, neardup, sharding
from folioflow.llm.common import materialize, settled, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents inside the fertility bands of their language and length.

    Null, empty and blank texts are rejected; a null language counts as its script; rows with a null id and repeated rows are judged like any other; texts of any
    length are measured whole; a measure on the band's end is inside.
    """
    return fertility.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, that of the least id.

    Texts without a word and rows with a null id are no one's copy and stay; rows repeating the kept id stay together.
    """
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of ``benchmark``.

    All rows of an affected id go; rows with a null id can't be named and stay; null texts match nothing; an empty benchmark removes nothing.
    """
    return decontaminate.remove_affected(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of ``mixing.BUDGET`` of the tokens, at target shares of source, language and topic.

    Null values are values of their own; null ids hash like the empty string; repeated rows are kept or dropped together.
    """
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with slot, shard and map_version, by a map of the corpus' own.

    Records with a null id are placed by their text; repeated rows share a slot.
    """
    return sharding.shard_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mix_sources", mix_sources), ("shard", shard)]

#: Tokenisation and MinHash are not expressible in SQL; the stages are tested against a brute-force version in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's result is written; what was written on the way to it, and the result before it, are deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    name, stage = STAGES[-1]
    return materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
