"""From a batch's resolved candidates to the ops of its patch: creates, merges, updates, reinforcements, assertions, invalidations.

Entities: (patch_id, batch, pos, temp_id, name, entity_type, confidence, props, evidence, canonical_id, score, method) as resolve.cascade leaves them.
Facts: (patch_id, batch, pos, temp_id, subject_temp_id, object_temp_id, predicate, valid_from, confidence, props, evidence). All steps are joins; an op's
order in its patch is entities first, by their place in the text, then facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.text import merged_description
from claimgraph.operators import correlate, graph, scoring
from claimgraph.operators.candidates import in_order
from claimgraph.operators.resolve import extended
from claimgraph.schemas import OPS, PRECONDITION

NEW_NODE, NEW_FACT = 0.5, 0.5
QUOTE_CAP = 300


def _id(*parts: Column) -> Column:
    return F.concat(F.lit("op_"), F.substring(F.sha1(F.concat_ws(":", *parts).cast("binary")), 1, 16))


def _none() -> Column:
    return F.create_map().cast("map<string,string>")


def _check(kind: str, subject: Column, expected: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), subject.alias("subject"), (_none() if expected is None else expected).alias("expected"))


def node_ops(resolved: DataFrame, entities: DataFrame) -> DataFrame:
    """Creates and merges: one op a candidate that is new, or matched by anything but its name."""
    names = entities.select(F.col("id").alias("canonical_id"), F.col("name").alias("_known"))
    rows = resolved.filter("canonical_id IS NULL OR method <> 'rules'").join(names, "canonical_id", "left")
    made = F.col("canonical_id").isNull()
    kind = F.when(made, "create_node").otherwise("merge_into")
    said = F.when(made, F.concat(F.lit("new entity '"), "name", F.lit("' ("), "entity_type", F.lit(")"))).otherwise(
        F.concat(F.lit("'"), "name", F.lit("' resolved to existing '"), F.coalesce("_known", F.lit("?")), F.lit("' ("), "method", F.lit(", "), F.format_number("score", 2), F.lit(")"))
    )
    own = F.map_filter(F.coalesce("props", _none()), lambda k, v: k != "name")
    return rows.select(
        "patch_id", _id(F.col("patch_id"), kind, F.col("temp_id")).alias("op_id"), kind.alias("op"), "temp_id", "canonical_id", "entity_type", "pos", F.lit(0).alias("step"),
        F.array(F.when(made, _check("name_absent", F.col("name"))).otherwise(_check("node_exists", F.col("canonical_id")))).alias("preconditions"), said.alias("rationale"),
        F.when(made, F.map_concat(own, F.create_map(F.lit("name"), "name"))).alias("props"), F.when(~made, F.col("score")).alias("match_score"), F.when(~made, F.col("method")).alias("match_method"),
        F.col("confidence").alias("_extraction"), F.size("evidence").alias("_support"), F.when(made, NEW_NODE).otherwise(F.col("score")).alias("_resolution"), "new_type",
    )


def update_ops(resolved: DataFrame, nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """What known entities gain: one op a patch and entity. Gaps are filled by the first mention that fills them; descriptions are merged in turn.

    A merged description is guarded by the value it was merged into; an update that follows a merge depends on it.
    """
    old = entities.select(F.col("id").alias("canonical_id"), F.col("props").alias("_old"), F.coalesce("description", F.lit("")).alias("_described"))
    merges = nodes.filter("op = 'merge_into'").select("patch_id", "temp_id", F.col("op_id").alias("_merge"))
    rows = resolved.filter("canonical_id IS NOT NULL").join(old, "canonical_id").join(merges, ["patch_id", "temp_id"], "left")
    gains = F.map_filter(extended(F.col("_old"), F.map_filter(F.coalesce("props", _none()), lambda k, v: k != "name"), F.col("_described")), lambda k, v: v.isNotNull())
    said = F.try_element_at("props", F.lit("description"))
    rows = rows.withColumn("_gain", gains).filter(F.size("_gain") > 0).withColumn("_said", said)
    one = F.struct("pos", "_gain", "_said", "_merge", "confidence", F.size("evidence").alias("support"), F.when(F.col("method") == "rules", 1.0).otherwise(F.col("score")).alias("resolution"), "new_type", "name")
    out = rows.groupBy("patch_id", "canonical_id").agg(F.first("_described").alias("_described"), in_order(F.collect_list(one)).alias("m"))
    first = F.col("m")[0]
    entries = F.flatten(F.transform("m", lambda x: F.map_entries(F.map_filter(x["_gain"], lambda k, v: k != "description"))))
    put = lambda acc, e: F.when(F.map_contains_key(acc, e["key"]), acc).otherwise(F.map_concat(acc, F.map_from_entries(F.array(e))))
    told = F.aggregate(F.transform("m", lambda x: F.coalesce(x["_said"], F.lit(""))), F.col("_described"), lambda acc, n: F.when(acc == "", n).otherwise(F.coalesce(merged_description(acc, n), acc)))
    out = out.withColumn("_told", told).withColumn("_gaps", F.aggregate(entries, _none(), put))
    changed = F.col("_told") != F.col("_described")
    props = F.when(changed, F.map_concat("_gaps", F.create_map(F.lit("description"), "_told"))).otherwise(F.col("_gaps"))
    guard = _check("prop_equals", F.col("canonical_id"), F.create_map(F.lit("prop"), F.lit("description"), F.lit("value"), "_described"))
    exists = F.array(_check("node_exists", F.col("canonical_id")))
    return out.select(
        "patch_id", _id(F.col("patch_id"), F.lit("update_node_props"), F.col("canonical_id")).alias("op_id"), F.lit("update_node_props").alias("op"), "canonical_id", first["pos"].alias("pos"), F.lit(1).alias("step"),
        F.array_sort(F.array_distinct(F.array_compact(F.col("m._merge")))).alias("depends_on"), F.when(changed & (F.col("_described") != ""), F.concat(exists, F.array(guard))).otherwise(exists).alias("preconditions"),
        F.concat(F.lit("extends existing '"), first["name"], F.lit("' with "), F.array_join(F.array_sort(F.map_keys(props)), ", ")).alias("rationale"), props.alias("props"),
        first["confidence"].alias("_extraction"), first["support"].alias("_support"), first["resolution"].alias("_resolution"), first["new_type"].alias("new_type"),
    )


def fact_ops(facts: DataFrame, resolved: DataFrame, nodes: DataFrame, entities: DataFrame, edges: DataFrame, adjudicate, run_date: str, many_valued: list[str] = ()) -> DataFrame:
    """What facts do to the graph: an open edge that says the same is reinforced; else the fact is asserted, and the open edges that
    it collides with, on either side that is known, are closed as far as ``adjudicate`` says so. A contradiction marks the assertion itself."""
    made = nodes.filter("op = 'create_node'").select("patch_id", "temp_id", F.col("op_id").alias("_by"))
    ends = resolved.select("patch_id", "temp_id", "canonical_id", F.col("name").alias("_name")).join(made, ["patch_id", "temp_id"], "left")
    rows = facts
    for end in ("subject", "object"):
        to = ends.select(
            "patch_id", F.col("temp_id").alias(f"{end}_temp_id"), F.col("canonical_id").alias(f"{end}_id"), F.col("_name").alias(f"_{end}"), F.col("_by").alias(f"_{end}_by"),
            F.struct(F.when(F.col("canonical_id").isNull(), F.col("temp_id")).alias("temp_id"), "canonical_id").alias(end),
        )
        rows = rows.join(to, ["patch_id", f"{end}_temp_id"])
    quote = F.substring(F.filter(F.transform("evidence", lambda e: e["quote"]), lambda q: q.isNotNull())[0], 1, QUOTE_CAP)
    rows = rows.withColumn("fact_id", F.concat_ws(":", "patch_id", "temp_id")).withColumn("quote", F.coalesce(F.try_element_at("props", F.lit("quote")), quote))
    rows = rows.withColumn("_fact", F.concat(F.lit("("), "_subject", F.lit(") —"), "predicate", F.lit("→ ("), "_object", F.lit(")")))
    new = rows.select("fact_id", "subject_id", "predicate", "object_id", "valid_from")
    same = correlate.exact(new, edges)
    rows = rows.join(same, "fact_id", "left")
    judged = adjudicate(correlate.collisions(new.join(same, "fact_id", "left_anti").filter(~F.col("predicate").isin(list(many_valued))), edges))
    closing = correlate.adjudicated(judged, run_date).join(judged.select("fact_id", "edge_id", "certainty").distinct(), ["fact_id", "edge_id"])
    closing = closing.dropDuplicates(["fact_id", "edge_id"])
    shown = graph.named(edges, entities).select(F.col("id").alias("edge_id"), F.concat(F.lit("("), "subject", F.lit(") —"), "predicate", F.lit("→ ("), "object", F.lit(")")).alias("_old"))
    closing = closing.join(shown, "edge_id", "left").join(rows.select("fact_id", "patch_id", "pos", "confidence", "evidence", "_fact"), "fact_id")
    hard = closing.filter("semantic").groupBy("fact_id").agg(F.min("_old").alias("_against"))
    signals = [F.col("confidence").alias("_extraction"), F.size("evidence").alias("_support")]
    again = rows.filter("edge_id IS NOT NULL").select(
        "patch_id", _id(F.lit("reinforce_edge"), F.col("fact_id")).alias("op_id"), F.lit("reinforce_edge").alias("op"), "edge_id", "quote", "pos", F.lit(2).alias("step"),
        F.array(_check("edge_exists", F.col("edge_id"))).alias("preconditions"), F.concat(F.lit("another source asserts "), "predicate").alias("rationale"), *signals, F.lit(1.0).alias("_resolution"),
    )
    both = F.col("subject_id").isNotNull() & F.col("object_id").isNotNull()
    absent = _check("edge_absent", F.col("subject_id"), F.create_map(F.lit("subject_id"), "subject_id", F.lit("predicate"), "predicate", F.lit("object_id"), "object_id"))
    said = F.when(F.col("_against").isNotNull(), F.concat(F.lit("CONFLICTS with "), "_against")).otherwise(F.concat(F.lit("asserts "), "predicate"))
    told = rows.filter("edge_id IS NULL").join(hard, "fact_id", "left").select(
        "patch_id", _id(F.lit("assert_edge"), F.col("fact_id")).alias("op_id"), F.lit("assert_edge").alias("op"), "subject", "object", "predicate", "valid_from", "quote", "pos", F.lit(2).alias("step"),
        F.map_filter(F.coalesce("props", _none()), lambda k, v: k != "quote").alias("props"), F.array_distinct(F.array_compact(F.array("_subject_by", "_object_by"))).alias("depends_on"),
        F.when(both, F.array(absent)).otherwise(F.array().cast(f"array<{PRECONDITION}>")).alias("preconditions"), said.alias("rationale"), *signals, F.lit(NEW_FACT).alias("_resolution"), F.col("_against").isNotNull().alias("semantic"),
    )
    why = F.when(F.col("semantic"), F.concat(F.lit("contested by new claim "), "_fact")).otherwise(F.concat(F.lit("superseded: "), F.coalesce("_old", "edge_id"), F.lit(" replaced by "), "_fact"))
    closed = closing.select(
        "patch_id", _id(F.lit("invalidate_edge"), F.col("fact_id"), F.col("edge_id")).alias("op_id"), F.lit("invalidate_edge").alias("op"), "edge_id", "valid_to", "reason", "pos", F.lit(3).alias("step"),
        F.array(_check("edge_exists", F.col("edge_id"))).alias("preconditions"), why.alias("rationale"), *signals, F.col("certainty").alias("_resolution"), "semantic",
    )
    return again.unionByName(told, allowMissingColumns=True).unionByName(closed, allowMissingColumns=True)


def routed(ops: DataFrame, edges: DataFrame, approve_at: float = scoring.APPROVE_AT, reject_below: float = scoring.REJECT_BELOW) -> DataFrame:
    """Scored and routed ops, with every column of a patch's op and their place in it."""
    busy = graph.degree(edges).withColumnRenamed("id", "canonical_id")
    for name in ("new_type", "semantic"):
        ops = ops.withColumn(name, F.coalesce(name, F.lit(False)) if name in ops.columns else F.lit(False))
    rows = ops.join(busy, "canonical_id", "left")
    scored = scoring.score(F.col("_extraction"), F.col("_support"), F.col("_resolution"), ~F.col("new_type"))
    rows = rows.withColumn("confidence", scored)
    rows = rows.withColumn("route", scoring.route(F.col("op"), F.col("confidence"), F.col("new_type"), F.col("semantic"), F.coalesce("degree", F.lit(0)), approve_at, reject_below))
    rows = rows.withColumn("status", scoring.status_of(F.col("route")))
    order = Window.partitionBy("patch_id").orderBy((F.col("step") > 1).cast("int"), "pos", "step", "op_id")
    rows = rows.withColumn("pos", F.row_number().over(order) - 1)
    schema = ops.sparkSession.createDataFrame([], OPS).schema
    lists = ("depends_on", "preconditions")
    value = lambda f: F.coalesce(f.name, F.array().cast(f.dataType)) if f.name in lists and f.name in rows.columns else F.array() if f.name in lists else F.col(f.name) if f.name in rows.columns else F.lit(None)
    return rows.select(*[value(f).cast(f.dataType).alias(f.name) for f in schema])
