"""The corpus pipeline: language, near-duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns
of `documents`. The steps are models and exact set comparisons that SQL can't express, so ORACLE_SQL is None and the tests
compare each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlake.llm.common import materialize, table
from spanlake.llm.op4_sharding import shard_texts
from spanlake.llm.op6_neardup import drop_near_duplicates
from spanlake.llm.op7_language import keep_identified
from spanlake.llm.op8_mixing import apply_mix
from spanlake.llm.op9_decontamination import drop_leaks
from spanlake.sources.scratch import rest_driver


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language go on; `und` ones, without text or without a letter, are rejected."""
    rest_driver(spark)  # the other stages do so where they write their first table
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates goes on, the one with the least id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark are dropped."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: 0, 1 or 2 times."""
    return apply_mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place there."""
    return shard_texts(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
