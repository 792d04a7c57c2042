"""Batches of extracted candidates: filters, duplicates inside a batch, new types.

Entities: (batch, pos, temp_id, name, entity_type, confidence, props, evidence). Relations: (batch, pos, temp_id,
subject_temp_id, object_temp_id, predicate, valid_from, confidence, props, evidence). ``pos`` orders a batch and is unique in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.text import batch_key, is_unnamed


def drop_unnamed(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without entities that name nothing, and without relations that lose an end by that."""
    gone = entities.filter(is_unnamed(F.col("name"))).select("batch", F.col("temp_id").alias("gone")).distinct()
    kept = relations
    for end in ("subject_temp_id", "object_temp_id"):
        kept = kept.join(gone.withColumnRenamed("gone", end), ["batch", end], "left_anti")
    return entities.filter(~is_unnamed(F.col("name"))), kept


def in_order(rows: Column) -> Column:
    """An array of structs by their ``pos`` alone: maps have no order."""
    return F.array_sort(rows, lambda a, b: (a["pos"] > b["pos"]).cast("int") - (a["pos"] < b["pos"]).cast("int"))


def first_wins(maps: Column) -> Column:
    """One map from an array of maps: the first value of each key."""
    entries = F.flatten(F.transform(maps, lambda m: F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>")))))
    put = lambda acc, e: F.when(F.map_contains_key(acc, e["key"]), acc).otherwise(F.map_concat(acc, F.map_from_entries(F.array(e))))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), put)


def merge_entities(entities: DataFrame) -> DataFrame:
    """One row per batch and trimmed lower-case name: the first mention's temp_id and name, all evidence in order, the
    first value of each property, and the type of the most confident mention (the first of equals)."""
    rows = entities.withColumn("key", batch_key(F.col("name")))
    firsts = {c: F.min_by(c, "pos").alias(c) for c in ("temp_id", "name")}
    ordered = in_order(F.collect_list(F.struct("pos", "props", "evidence")))
    out = rows.groupBy("batch", "key").agg(
        F.min("pos").alias("pos"), *firsts.values(), F.max_by("entity_type", F.struct("confidence", -F.col("pos"))).alias("entity_type"),
        F.max("confidence").alias("confidence"), F.count("*").alias("mentions"), ordered.alias("o"),
    )
    return out.withColumn("props", first_wins(F.col("o.props"))).withColumn("evidence", F.flatten("o.evidence")).drop("o")


def survivors(entities: DataFrame) -> DataFrame:
    """(batch, temp_id, survivor): where each mention's temp_id went."""
    rows = entities.withColumn("key", batch_key(F.col("name")))
    first = rows.groupBy("batch", "key").agg(F.min_by("temp_id", "pos").alias("survivor"))
    return rows.join(first, ["batch", "key"]).select("batch", "temp_id", "survivor").distinct()


def merge_relations(relations: DataFrame, moved: DataFrame) -> DataFrame:
    """One row per batch, ends and trimmed lower-case predicate, with ends at the survivors: highest confidence, first
    non-empty valid_from, first value of each property, all evidence in order."""
    rows = relations
    for end in ("subject_temp_id", "object_temp_id"):
        to = moved.select("batch", F.col("temp_id").alias(end), F.col("survivor").alias("_s"))
        rows = rows.join(to, ["batch", end], "left").withColumn(end, F.coalesce("_s", end)).drop("_s")
    rows = rows.withColumn("key", batch_key(F.col("predicate")))
    ordered = in_order(F.collect_list(F.struct("pos", "props", "evidence")))
    dated = F.when(F.coalesce(F.col("valid_from"), F.lit("")) != "", F.struct("pos", "valid_from"))
    out = rows.groupBy("batch", "subject_temp_id", "key", "object_temp_id").agg(
        F.min("pos").alias("pos"), F.min_by("temp_id", "pos").alias("temp_id"), F.min_by("predicate", "pos").alias("predicate"),
        F.min(dated)["valid_from"].alias("valid_from"), F.max("confidence").alias("confidence"), F.count("*").alias("mentions"), ordered.alias("o"),
    )
    return out.withColumn("props", first_wins(F.col("o.props"))).withColumn("evidence", F.flatten("o.evidence")).drop("o", "key")


def new_types(found: DataFrame, known: DataFrame) -> DataFrame:
    """Types (entity_type) that aren't known (type_name)."""
    return found.select("entity_type").distinct().join(known.select(F.col("type_name").alias("entity_type")), "entity_type", "left_anti")


def from_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates from structured triples (batch, pos, subject, predicate, object, props): IS_A gives an entity its type (the
    first one), the rest are relations; ends without a type are Concepts. All are certain."""
    typed = triples.filter("predicate = 'IS_A'").groupBy("batch", F.col("subject").alias("name")).agg(F.min_by("object", "pos").alias("entity_type"))
    links = triples.filter("predicate <> 'IS_A'")
    ends = links.select("batch", F.explode(F.array("subject", "object")).alias("name")).distinct()
    entities = ends.join(typed, ["batch", "name"], "full").withColumn("entity_type", F.coalesce("entity_type", F.lit("Concept")))
    temp = lambda c: F.concat(F.lit("t_"), F.substring(F.sha1(F.concat_ws(":", F.col("batch").cast("string"), c).cast("binary")), 1, 16))
    entities = entities.withColumn("temp_id", temp(F.col("name"))).withColumn("confidence", F.lit(1.0))
    relations = links.select(
        "batch", "pos", temp(F.col("subject")).alias("subject_temp_id"), temp(F.col("object")).alias("object_temp_id"), "predicate",
        F.map_filter("props", lambda k, v: v.isNotNull()).alias("props"), F.lit(1.0).alias("confidence"),
    )
    return entities, relations


def from_extraction(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates from an extractor's result per unit: (batch, unit, pos, name, entity_type, description, confidence, props) and
    (batch, unit, pos, subject, predicate, object, confidence, ...). Relations find their ends by name in their unit, the last
    entity of a name; those with an unknown end go. A description becomes a property unless one is given."""
    rows = entities.withColumn("temp_id", F.concat_ws("_", "unit", F.lit("e"), "pos"))
    own = F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    told = F.when(F.col("description").isNotNull() & ~F.map_contains_key(own, F.lit("description")), F.create_map(F.lit("description"), "description"))
    rows = rows.withColumn("props", F.map_concat(F.coalesce(told, F.create_map().cast("map<string,string>")), own)).drop("description")
    last = rows.groupBy("batch", "unit", "name").agg(F.max_by("temp_id", "pos").alias("t"))
    out = relations
    for end in ("subject", "object"):
        out = out.join(last.select("batch", "unit", F.col("name").alias(end), F.col("t").alias(f"{end}_temp_id")), ["batch", "unit", end])
    return rows, out
