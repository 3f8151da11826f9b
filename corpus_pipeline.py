"""A training corpus from ``documents``: quality, near-duplicates, decontamination, mix, shards.

Every stage takes all rows that its predecessor kept and returns them with all their
columns, whatever these are called; empty tables give empty tables.  What a stage does with
nulls, empty or very long texts, ties and repeated rows is in its docstring and that of its
operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, mixing, quality, sharding, simhash
from tessera.llm._cluster import cut


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.3 or more go on.

    Null and empty texts have the share of good labels as their score; rows without a doc_id are judged by their text;
    repeated rows are judged one by one, and so all go or all stay.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (sets of five-word shingles, similarity 0.8 or more) goes on.

    It is the one with the least doc_id; rows without one come last.  Documents without words are one group.  Of rows that
    agree in doc_id and text one stays; rows of one doc_id with different texts are different documents.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item go on.

    Null and empty texts overlap with nothing; repeated rows all go or all stay; items without an id count like others.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    A null source is a source of its own; null texts have size 0 and are sampled with the rate of their source; repeated
    rows are sampled one by one.
    """
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``shard`` and ``slot``; columns of these names are replaced.

    Repeated rows get places of their own; rows without a doc_id are numbered by their text.
    """
    return sharding.place(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: The classifier and the fingerprints aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
