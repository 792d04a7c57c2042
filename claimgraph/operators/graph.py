"""Reads of the graph: lookups, neighbourhoods, degrees, exports, provenance. All joins; Spark chooses how."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.operators.links import stored
from claimgraph.operators.temporal import facts, holds

FACT_LIMIT = 60


def named(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with ``subject`` and ``object``, their ends' names. Edges without an end in ``entities`` go."""
    ends = entities.select("id", "name")
    return edges.join(ends.select(F.col("id").alias("subject_id"), F.col("name").alias("subject")), "subject_id").join(
        ends.select(F.col("id").alias("object_id"), F.col("name").alias("object")), "object_id"
    )


def edges_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Open edges for each (subject_id, object_id) in ``pairs``, of its predicate if ``pairs`` has one."""
    return edges.filter(holds()).join(pairs.distinct(), pairs.columns, "left_semi")


def edges_from(edges: DataFrame, keys: DataFrame, entities: DataFrame) -> DataFrame:
    """Open edges for each (subject_id, predicate), with the object's name."""
    found = edges.filter(holds()).join(keys.distinct(), ["subject_id", "predicate"], "left_semi")
    return found.join(entities.select(F.col("id").alias("object_id"), F.col("name").alias("object")), "object_id")


def edges_to(edges: DataFrame, keys: DataFrame, entities: DataFrame) -> DataFrame:
    """Open edges for each (object_id, predicate), with the subject's name."""
    found = edges.filter(holds()).join(keys.distinct(), ["object_id", "predicate"], "left_semi")
    return found.join(entities.select(F.col("id").alias("subject_id"), F.col("name").alias("subject")), "subject_id")


def steps(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: (at, to, id); a loop comes twice."""
    one = lambda at, to: F.struct(F.col(at).alias("at"), F.col(to).alias("to"), "id")
    return edges.select(F.explode(F.array(one("subject_id", "object_id"), one("object_id", "subject_id"))).alias("s")).select("s.*")


def walk(edges: DataFrame, anchors: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Undirected breadth-first walk from ``anchors`` (id): (edge id, hop) of each edge met, (id, hop) of each node met.

    The number of hops is a small constant, so the walk is unrolled into joins; a frontier is what was met last and not before. What a hop meets
    is written, so that its size is known before the edges are dealt: a small frontier goes to them.
    """
    ways = steps(edges)
    seen = stored(anchors.select("id").distinct().withColumn("hop", F.lit(0)))
    frontier, met = seen, None
    for hop in range(1, hops + 1):
        out = stored(ways.join(frontier.select(F.col("id").alias("at")), "at").select("to", "id"))
        found = out.select("id").distinct().withColumn("hop", F.lit(hop))
        met = found if met is None else met.unionByName(found)
        frontier = stored(out.select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return stored(met.groupBy("id").agg(F.min("hop").alias("hop"))), seen


def neighborhood(edges: DataFrame, entities: DataFrame, anchors: DataFrame, hops: int = 2, as_of: str | None = None, limit: int | None = FACT_LIMIT) -> DataFrame:
    """Facts within ``hops`` of the anchors that hold now or on a date; nearest first, then by id, up to ``limit``."""
    valid = facts(edges, as_of)
    met, _ = walk(valid, anchors, hops)
    out = named(valid.join(met, "id"), entities)
    return out if limit is None else out.orderBy("hop", "id").limit(limit)


def subgraph(edges: DataFrame, anchors: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """All nodes and edges, closed ones too, within ``hops``."""
    met, nodes = walk(edges, anchors, hops)
    return nodes, edges.join(met, "id")


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): edge ends at each node, closed edges included; a loop counts twice."""
    ends = edges.select(F.explode(F.array("subject_id", "object_id")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def export(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes with their degree, all edges with a flag for open ones."""
    nodes = entities.join(degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return nodes, named(edges, entities).withColumn("open", holds())


def stats(entities: DataFrame, edges: DataFrame, documents: DataFrame, decisions: DataFrame, ops: DataFrame) -> DataFrame:
    """One row of counts; each table is read once."""
    one = entities.agg(F.count("*").alias("nodes"))
    one = one.crossJoin(edges.agg(F.count_if(holds()).alias("current_edges"), F.count_if(~holds()).alias("superseded_edges")))
    one = one.crossJoin(documents.agg(F.count("*").alias("documents"))).crossJoin(decisions.agg(F.count("*").alias("decisions")))
    return one.crossJoin(ops.agg(F.count_if((F.col("route") == "review") & (F.col("status") == "pending")).alias("pending_ops")))


def vocabulary(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, value): the distinct entity types and predicates."""
    kinds = entities.select(F.lit("entity_type").alias("kind"), F.col("entity_type").alias("value")).distinct()
    return kinds.unionByName(edges.select(F.lit("predicate").alias("kind"), F.col("predicate").alias("value")).distinct())


def incident(edges: DataFrame, entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both directions of the edges at each node (node_id): edge_id, predicate, other, outgoing, window, support, quotes, reason; ``n`` gives the
    order, open ones first, then by predicate and id. An edge from a node to itself comes once."""
    ends = entities.select(F.col("id").alias("other_id"), F.col("name").alias("other"))
    shown = ["predicate", "valid_from", "valid_to", *[c for c in ("support", "quotes", "invalidation_reason") if c in edges.columns]]
    out = edges.select(F.col("id").alias("edge_id"), F.col("subject_id").alias("node_id"), F.col("object_id").alias("other_id"), F.lit(True).alias("outgoing"), *shown)
    back = edges.filter("subject_id <> object_id")
    back = back.select(F.col("id").alias("edge_id"), F.col("object_id").alias("node_id"), F.col("subject_id").alias("other_id"), F.lit(False).alias("outgoing"), *shown)
    rows = out.unionByName(back).join(nodes.select("node_id").distinct(), "node_id", "left_semi").join(ends, "other_id")
    order = Window.partitionBy("node_id").orderBy(F.col("valid_to").isNotNull(), "predicate", "edge_id")
    return rows.withColumn("n", F.row_number().over(order))


def written(ledger: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(node_id, n, op_id, patch_id, doc_id, source, at): the ops that wrote each node (node_id), by time and op."""
    rows = ledger.join(nodes.select("node_id").distinct(), "node_id", "left_semi").join(documents.select("doc_id", F.col("source_uri").alias("source")), "doc_id", "left")
    order = Window.partitionBy("node_id").orderBy("at", "op_id")
    return rows.select("node_id", F.row_number().over(order).alias("n"), "op_id", "patch_id", "doc_id", "source", "at")


def decided(wrote: DataFrame, decisions: DataFrame) -> DataFrame:
    """The decisions on ops (op_id) that wrote something."""
    return decisions.join(wrote.select("op_id").distinct(), "op_id", "left_semi")


def provenance(edges: DataFrame, ledger: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges with ``sources``: the distinct sorted uris of the documents whose ops wrote them (the id where a document is unknown)."""
    wrote = ledger.filter("edge_id IS NOT NULL").join(documents.select("doc_id", "source_uri"), "doc_id", "left")
    wrote = wrote.groupBy(F.col("edge_id").alias("id")).agg(F.array_sort(F.collect_set(F.coalesce("source_uri", "doc_id"))).alias("sources"))
    return edges.join(wrote, "id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
