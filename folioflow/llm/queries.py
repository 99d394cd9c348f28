"""The operators' queries over the whole test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fertility, fixity, mixing, neardup, pii, ranking, sharding, substrings, urlfilter
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "slot", "shard", "map_version")


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("band", fertility.group_of())
    measured = fertility.materialize(fertility.with_measures(docs.select("doc_id", "band", "text",
                fertility.text_key())).select("doc_id", "band", fertility.TEXT_KEY, "n_tokens", *fertility.MEASURES), "fertility")
    return fertility.judged(measured, fertility.bands(measured)).where("reason IS NULL").drop("reason", fertility.TEXT_KEY)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicates(table(spark, sf_dir, "documents"))


def op4_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_and_cut(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def mixing_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets, what the tokens allow of them, and what ``op7_mixing`` draws in expectation."""
    return mixing.marginals_report(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.verdicts(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "action", "entry")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return fixity.audit(fixity.archived(pages), fixity.archived(fixity.second_replica(pages)), content="record")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_fertility, op3_minhash,
        op4_bradley_terry, op5_pii, op6_substrings, op7_mixing, op8_url_filter, op9_decontamination, op10_fixity,
        mixing_marginals)}

ORACLES: dict[str, str] = {"op1_sharding": sharding.oracle(), "op7_mixing": mixing.oracle(),
    "mixing_marginals": mixing.marginals_oracle(), "op8_url_filter": urlfilter.oracle(), "op10_fixity": fixity.oracle()}
