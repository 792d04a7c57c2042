"""From raw documents to packed sequences: five stages, each one operator, each written as Parquet and read again.

Defined cases, beside those of the operators: an empty table passes every stage as one; further columns pass all stages but the last; rows that share
an id are one document to the second stage, which keeps one of them; rows without an id can't be told apart there and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimgraph.llm.common import Stage, table
from claimgraph.llm.decontaminate import without_contaminated
from claimgraph.llm.language import keep_identified
from claimgraph.llm.near_duplicates import one_of_each
from claimgraph.llm.packing import pack
from claimgraph.llm.substrings import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (null, empty, no letters) go; so do all if none could be learned."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the smallest id."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a repeated window go from all but its first place; n_chars follows. Every document stays, also one that loses all its words."""
    cut = without_repeats(docs)
    return cut.selectExpr(*[f"cast(coalesce(char_length(text), 0) AS {t}) AS n_chars" if c == "n_chars" else f"`{c}`" for c, t in docs.dtypes])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null items and an empty benchmark reject nothing."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The stages learn a model, follow sampled hashes and search; SQL can't express them. Tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Stage(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
