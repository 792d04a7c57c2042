"""Views of facts in time. Bounds are ISO prefixes (``2019``, ``2026-03``, ``2026-03-15``) and compare as strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holds(as_of: str | None = None, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    """Currently open, or valid on a date: from inclusive, to exclusive, open bounds everywhere."""
    start, end = F.col(valid_from), F.col(valid_to)
    if as_of is None:
        return end.isNull()
    return (start.isNull() | (start <= F.lit(as_of))) & (end.isNull() | (end > F.lit(as_of)))


def facts(edges: DataFrame, as_of: str | None = None) -> DataFrame:
    return edges.filter(holds(as_of))


def supersede(observations: DataFrame, keys: list[str], order: list[str], at: str) -> DataFrame:
    """Turn observations into windows: each holds until the next one of its keys; windows of no length go."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = observations.withColumn("valid_to", F.lead(at).over(w)).withColumnRenamed(at, "valid_from")
    return out.filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
