"""What a model may replace, with deterministic stand-ins: all of them map DataFrames to DataFrames.

A model's answers belong in a table keyed by the prompt's hash before anything reads them, so that a retried task can't ask
twice and get two answers; ``answered`` does that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
Judge = Callable[[DataFrame], DataFrame]
Composer = Callable[[DataFrame], DataFrame]


def answered(prompts: DataFrame, known: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(prompt_hash, answer) for (prompt): only distinct prompts without a known answer are asked."""
    hashed = prompts.select("prompt").distinct().withColumn("prompt_hash", F.sha2("prompt", 256))
    new = ask(hashed.join(known.select("prompt_hash"), "prompt_hash", "left_anti"))
    return known.join(hashed.select("prompt_hash"), "prompt_hash", "left_semi").select("prompt_hash", "answer").unionByName(new.select("prompt_hash", "answer"))


def pattern_extractor(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Capitalised names, and ``A verb B`` between two of them in one sentence, with a start where ``in``, ``since`` or ``from`` and a date follow."""
    name = r"[A-Z][\w-]+(?: [A-Z][\w-]+)*"
    pattern = f"({name}) ([a-z]+(?: (?:in|by|of|at|to|from))?) ({name})(?: (?:in|since|from) (\\d{{4}}(?:-\\d\\d){{0,2}}))?"
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    hits = units.select(F.col("doc_id").alias("batch"), F.col("unit_id").alias("unit"), F.posexplode(found).alias("pos", "hit"))
    part = lambda i: F.regexp_extract("hit", pattern, i)
    hits = hits.select("batch", "unit", "pos", part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object"), F.nullif(part(4), F.lit("")).alias("valid_from"), F.col("hit").alias("quote"), F.lit(0.5).alias("confidence"))
    names = hits.select("batch", "unit", "quote", F.explode(F.array(F.struct((2 * F.col("pos")).alias("pos"), F.col("subject").alias("name")), F.struct((2 * F.col("pos") + 1).alias("pos"), F.col("object").alias("name")))).alias("e"))
    empty = F.create_map().cast("map<string,string>")
    return names.select("batch", "unit", "e.pos", "e.name", F.lit("Entity").alias("entity_type"), F.lit(None).cast("string").alias("description"), F.lit(0.5).alias("confidence"), empty.alias("props"), "quote"), hits


def rule_adjudicator(many_valued: list[str] = ()) -> Judge:
    """Collisions (fact_id, edge_id, np, old_from, new_from, ...) with ``outcome`` and the judgement's ``certainty``, by the rule of correlate.by_rule."""
    from claimgraph.operators.correlate import by_rule

    return lambda met: met.withColumn("outcome", by_rule(F.col("np"), F.col("old_from"), F.col("new_from"), many_valued)).withColumn("certainty", F.lit(0.5))


def name_judge(entities: DataFrame) -> Judge:
    """Among the options, the one whose name has the same words; else none."""
    from claimgraph.functions.text import evaluated_name

    def judge(asked: DataFrame) -> DataFrame:
        options = asked.select("cand_id", "name", F.explode("options").alias("key"))
        known = entities.select(F.col("id").alias("key"), F.col("name").alias("known"))
        same = options.join(known, "key").filter(evaluated_name(F.col("name")) == evaluated_name(F.col("known")))
        return same.groupBy("cand_id").agg(F.min("key").alias("key"))

    return judge


def template_composer(facts: DataFrame) -> DataFrame:
    """(query_id, answer, fact_ids): the facts' renderings in order, at most 20; facts are (query_id, n, id, rendered)."""
    rows = F.slice(F.array_sort(F.collect_list(F.struct("n", "id", "rendered"))), 1, 20)
    out = facts.groupBy("query_id").agg(rows.alias("r"))
    return out.select("query_id", F.array_join(F.col("r.rendered"), "; ").alias("answer"), F.col("r.id").alias("fact_ids"))
