"""How a new fact relates to the open ones: new, reinforcing, or colliding with what a rule or a judge then decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.operators.temporal import holds

SEVERITY = {"extends": 1, "contradicts_temporal": 2, "contradicts_semantic": 3}


def exact(new: DataFrame, edges: DataFrame) -> DataFrame:
    """(fact_id, edge_id): open edges that say the same."""
    known = edges.filter(holds()).groupBy("subject_id", "predicate", "object_id").agg(F.min("id").alias("edge_id"))
    return new.join(known, ["subject_id", "predicate", "object_id"]).select("fact_id", "edge_id")


def collisions(new: DataFrame, edges: DataFrame) -> DataFrame:
    """(fact_id, edge_id, side, np, old_from, new_from): open edges with the same subject and predicate but another object, or the same object and
    predicate but another subject. Two equi-joins, each with an inequality; a null end differs from every end. It lists pairs, so it is for
    predicates whose collisions are to be acted on one by one; ``correlate`` counts without listing."""
    held = edges.filter(holds()).select(F.col("id").alias("edge_id"), "subject_id", "object_id", "predicate", F.col("valid_from").alias("old_from"))
    n = new.select("fact_id", F.col("subject_id").alias("ns"), F.col("object_id").alias("no"), F.col("predicate").alias("np"), F.col("valid_from").alias("new_from"))
    out = n.join(held, (n.ns == held.subject_id) & (n.np == held.predicate)).filter(~F.col("no").eqNullSafe(F.col("object_id"))).withColumn("side", F.lit("object"))
    back = n.join(held, (n.no == held.object_id) & (n.np == held.predicate)).filter(~F.col("ns").eqNullSafe(F.col("subject_id"))).withColumn("side", F.lit("subject"))
    return out.unionByName(back).select("fact_id", "edge_id", "side", "np", "old_from", "new_from")


def by_rule(predicate: Column, old_from: Column, new_from: Column, many_valued: list[str]) -> Column:
    """The default judgement: predicates with many values extend; a later stated start supersedes; anything else is a contradiction."""
    later = new_from.isNotNull() & (old_from.isNull() | (new_from > old_from))
    return F.when(predicate.isin(list(many_valued)), "extends").when(later, "contradicts_temporal").otherwise("contradicts_semantic")


def correlate(new: DataFrame, edges: DataFrame, many_valued: list[str] = ()) -> DataFrame:
    """``new`` (fact_id, subject_id, predicate, object_id, valid_from) with edge_id (if reinforced), n_collisions and the worst outcome by the rule.

    The rule needs no pair: of each side, how many open edges share the end and the predicate, and the latest start among them, decide. So a hot end
    (a country, a priority) costs one aggregated row. A fact that no open edge states has none of its own triple among those counted.
    """
    same = exact(new, edges)
    open_ = edges.filter(holds())
    out = new.join(same, "fact_id", "left")
    for end, n, latest in (("subject_id", "_n1", "_l1"), ("object_id", "_n2", "_l2")):
        per = open_.groupBy(end, "predicate").agg(F.count("*").alias(n), F.max("valid_from").alias(latest))
        out = out.join(per, [end, "predicate"], "left")
    n = F.when(F.col("edge_id").isNotNull(), 0).otherwise(F.coalesce("_n1", F.lit(0)) + F.coalesce("_n2", F.lit(0)))
    worst = by_rule(F.col("predicate"), F.greatest("_l1", "_l2"), F.col("valid_from"), many_valued)
    kind = F.when(F.col("edge_id").isNotNull(), "reinforces").when(n > 0, worst).otherwise("new")
    return out.select(*new.columns, "edge_id", n.cast("long").alias("n_collisions"), kind.alias("correlation"))


def judged_worst(judged: DataFrame) -> DataFrame:
    """(fact_id, n_collisions, correlation) from judged pairs (fact_id, outcome): the worst outcome of each fact."""
    severity = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    return judged.groupBy("fact_id").agg(F.count("*").alias("n_collisions"), F.max_by("outcome", severity[F.col("outcome")]).alias("correlation"))


def adjudicated(judged: DataFrame, run_date: str) -> DataFrame:
    """Ops that a judgement (fact_id, edge_id, new_from, outcome) asks of old edges: superseded ones close at the new fact's start or the run's date."""
    reason = F.when(F.col("outcome") == "contradicts_temporal", "superseded").otherwise("contradicted")
    closing = judged.filter(F.col("outcome") != "extends")
    return closing.select("fact_id", "edge_id", F.coalesce("new_from", F.lit(run_date)).alias("valid_to"), reason.alias("reason"), (F.col("outcome") == "contradicts_semantic").alias("semantic"))
