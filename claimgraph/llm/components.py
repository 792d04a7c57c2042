"""Connected components of a link table by alternating stars, in Spark joins and counts only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.common import Stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of ``links``: comp is the smallest node that can be reached. Rows with nulls are ignored.

    Each round links a node's larger neighbours, and then its smaller ones, to its smallest neighbour, until every component is
    a star; the number of rounds grows with the logarithm of the longest path, and links that are stars already take none. Edges of a round are written and read back.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = Stage(edges, "edges")
    while _open_ends(state.df):
        both = state.df.unionByName(state.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = Stage(linked, "edges")
        state.drop()
        state = new
    stars = state.df.groupBy("u").agg(F.min("v").alias("comp"))
    return stars.select(F.col("u").alias("node"), "comp").unionByName(stars.select(F.col("comp").alias("node"), "comp").distinct())


def _open_ends(edges: DataFrame) -> int:
    """How many nodes have two smaller neighbours, or a smaller and a larger one. Edges are distinct and go from the larger node, so none is left once all are stars."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).filter("ups > 1 or ups = 1 and least = 0").count()
