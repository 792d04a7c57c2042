"""Resolving candidates to canonical entities, and the ops that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.text import merged_description, name_key

ACCEPT, REJECT, SAME_PREDICATE = 0.90, 0.60, 0.85


def rules_match(names: DataFrame, entities: DataFrame) -> DataFrame:
    """``names`` (name) with canonical_id: the smallest id of an entity whose lower-case name is the same, or null."""
    known = entities.groupBy(name_key(F.col("name")).alias("k")).agg(F.min("id").alias("canonical_id"))
    return names.join(known, name_key(names["name"]) == known["k"], "left").drop("k")


def tier(score: Column, accept: float = ACCEPT, reject: float = REJECT) -> Column:
    """``embedding`` from ``accept`` on, ``none`` below ``reject``, ``judge`` between."""
    return F.when(score.isNull() | (score < reject), "none").when(score >= accept, "embedding").otherwise("judge")


def cascade(candidates: DataFrame, entities: DataFrame, hits: DataFrame, judge=None, accept: float = ACCEPT, reject: float = REJECT) -> DataFrame:
    """``candidates`` (cand_id, name) with canonical_id, score and method.

    Tiers: an exact name; else the best of ``hits`` (cand_id, rank, key, score) by its band; a judge sees the band between
    only. ``judge`` maps a DataFrame (cand_id, name, options array<key>) to (cand_id, key); an answer outside the options is none.
    """
    exact = rules_match(candidates, entities)
    best = hits.filter("rank = 1").select("cand_id", F.col("key").alias("_key"), F.col("score").alias("_score"))
    rows = exact.join(best, "cand_id", "left").withColumn("_tier", F.when(F.col("canonical_id").isNotNull(), "rules").otherwise(tier(F.col("_score"), accept, reject)))
    if judge is None:
        rows = rows.withColumn("_judged", F.lit(None).cast("string"))
    else:
        band = rows.filter("_tier = 'judge'").select("cand_id", "name")
        options = hits.groupBy("cand_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda h: h["key"]).alias("options"))
        asked = band.join(options, "cand_id")
        told = judge(asked).select("cand_id", F.col("key").alias("_judged")).join(options, "cand_id").filter(F.array_contains("options", F.col("_judged"))).drop("options")
        rows = rows.join(told, "cand_id", "left")
    is_ = lambda t: F.col("_tier") == t
    found = F.when(is_("rules"), F.col("canonical_id")).when(is_("embedding"), F.col("_key")).when(is_("judge"), F.col("_judged"))
    method = F.when(is_("judge"), "llm").otherwise(F.col("_tier"))
    score = F.when(is_("rules"), 1.0).when(F.col("_score").isNull(), 0.0).otherwise(F.col("_score"))
    return rows.select(*candidates.columns, found.alias("canonical_id"), score.alias("score"), method.alias("method"))


def normal_predicates(predicates: DataFrame, hits: DataFrame, floor: float = SAME_PREDICATE) -> DataFrame:
    """(predicate, normal): the nearest known predicate if it is near enough, else itself. ``hits``: (query_id, rank, key, score)."""
    best = hits.filter((F.col("rank") == 1) & (F.col("score") >= floor)).select(F.col("query_id").alias("predicate"), F.col("key").alias("_k"))
    return predicates.join(best, "predicate", "left").withColumn("normal", F.coalesce("_k", "predicate")).drop("_k")


def extended(old: Column, new: Column, old_description: Column) -> Column:
    """What an entity gains: keys that it lacks or has blank; a description is merged, never replaced."""
    empty = F.create_map().cast("map<string,string>")
    blank = lambda k: F.coalesce(F.try_element_at(old, k), F.lit("")) == ""
    gaps = F.map_filter(F.coalesce(new, empty), lambda k, v: (k != "description") & blank(k))
    said = F.try_element_at(new, F.lit("description"))
    has_old = F.coalesce(old_description, F.lit("")) != ""
    merged = F.when(has_old, merged_description(old_description, said)).otherwise(said)
    return F.when(F.map_contains_key(F.coalesce(new, empty), F.lit("description")) & merged.isNotNull(), F.map_concat(gaps, F.create_map(F.lit("description"), merged))).otherwise(gaps)
