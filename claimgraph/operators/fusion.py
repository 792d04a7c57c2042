"""Fusing ranked lists, and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, SEEDS, CITED = 60, 10, 20


def rrf(lists: DataFrame, k: int = RRF_K, top: int | None = SEEDS) -> DataFrame:
    """(query_id, rank, id, score) from (query_id, list, pos, id).

    In a list only an id's first place counts, and ranks have no gaps. Ties keep the order of first appearance: list, then place.
    """
    once = lists.groupBy("query_id", "list", "id").agg(F.min("pos").alias("pos"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "list").orderBy("pos")))
    first = F.min(F.struct("list", "r")).alias("first")
    fused = ranked.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("r"))), 9).alias("score"), first)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first"))
    out = fused.withColumn("rank", rank)
    return (out if top is None else out.filter(F.col("rank") <= top)).select("query_id", "rank", "id", "score")


def citations(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """(answer_id, n, fact...) for (answer_id, fact_ids): the first 20 ids in order, unknown ones dropped, numbered from 1."""
    cited = answers.select("answer_id", F.posexplode(F.slice("fact_ids", 1, CITED)).alias("pos", "id")).join(facts, "id")
    return cited.withColumn("n", F.row_number().over(Window.partitionBy("answer_id").orderBy("pos"))).drop("pos")
