"""The engine: ingest, pending, review, commit, search, ask, evaluate, reindex, reset over one store."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimgraph.functions.text import entity_text, fact_text, render_fact
from claimgraph.operators import candidates, commit, evaluate, fusion, graph, lexical, links, propose, resolve, review, scoring, vectors
from claimgraph.operators.temporal import facts
from claimgraph.plugins import Composer, Extractor, Judge, name_judge, pattern_extractor, rule_adjudicator, template_composer
from claimgraph.schemas import SEED_TYPES
from claimgraph.sources import documents
from claimgraph.store import Store

#: How many hits each door of a search gives, and from which score on; how many hits a candidate is compared with.
ANCHORS, ANCHOR_FLOOR, FACTS, FACT_FLOOR, HITS = 4, 0.45, 8, 0.40, 5
REFUSAL = "I don't have any facts about that."


@dataclass(frozen=True)
class Settings:
    """What a deployment may set; ``from_env`` reads CLAIMGRAPH_<NAME>."""

    route_auto_approve: float = scoring.APPROVE_AT
    route_auto_reject: float = scoring.REJECT_BELOW
    accept: float = resolve.ACCEPT
    reject: float = resolve.REJECT
    same_predicate: float = resolve.SAME_PREDICATE
    many_valued: tuple[str, ...] = ()

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env, given = os.environ if env is None else env, {}
        for f in fields(cls):
            value = env.get(f"CLAIMGRAPH_{f.name.upper()}")
            if value is not None:
                given[f.name] = tuple(v.strip() for v in value.split(",") if v.strip()) if f.name == "many_valued" else float(value)
        return cls(**given)


class Engine:
    def __init__(
        self, spark: SparkSession, root: str, extractor: Extractor = pattern_extractor, composer: Composer = template_composer,
        adjudicator: Judge | None = None, settings: Settings | None = None,
    ):
        self.spark, self.store, self.extractor, self.composer = spark, Store(spark, root), extractor, composer
        self.settings = settings or Settings.from_env()
        self.adjudicator = adjudicator or rule_adjudicator(self.settings.many_valued)

    # Writing.

    def ingest(self, docs: DataFrame, at: str) -> DataFrame:
        """Stage patches for new documents (source_uri, modality, content_hash, doc_id, text); returns their (patch_id, doc_id).

        Documents that were committed, or that have a patch, are left out. Documents of one call see the graph as it is, not one another;
        what two of them create twice is caught by name_absent at commit.
        """
        t = self.store.tables()
        new = documents.first_copies(docs, t["documents"])
        new = links.cut(new.join(t["patches"].select("doc_id"), "doc_id", "left_anti"))
        ents, rels = self._candidates(new, t)
        ops = self._ops(ents, rels, t, at).persist()
        patch = F.concat(F.lit("patch_"), "doc_id").alias("patch_id")
        patches = new.select(patch, "doc_id", F.lit("run").alias("run_id"), F.lit(at).alias("created_at"), F.lit("pending").alias("status"), "content_hash", "source_uri")
        self.store.publish({"patches": t["patches"].unionByName(patches), "patch_ops": t["patch_ops"].unionByName(ops)})
        ops.unpersist()
        return patches.select("patch_id", "doc_id")

    def _candidates(self, new: DataFrame, t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
        """Entities and relations of each document, in the order of its text, structured triples first; duplicates inside a document merged."""
        parts = documents.parser_of("markdown")(new.filter("modality <> 'bpmn'"))
        units = links.cut(documents.units(parts))
        found, said = candidates.from_extraction(*self.extractor(units))
        given, stated = candidates.from_triples(documents.bpmn_triples(new.filter("modality = 'bpmn'")))
        empty, none = F.create_map().cast("map<string,string>"), F.lit(None).cast("string")
        place = units.select(F.col("unit_id").alias("unit"), F.col("pos").alias("_block"))
        span = lambda df: F.array(F.struct(F.col("unit").alias("unit_id"), (F.col("quote") if "quote" in df.columns else none).alias("quote"))).alias("evidence")
        whole = F.array(F.struct(F.col("batch").alias("unit_id"), none.alias("quote"))).alias("evidence")
        found = found.join(place, "unit", "left").select("batch", F.struct(F.lit(1).alias("a"), F.col("_block").cast("long").alias("b"), F.col("pos").cast("long").alias("c"), "temp_id").alias("pos"), "temp_id", "name", "entity_type", "confidence", "props", span(found))
        given = given.select("batch", F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), "temp_id").alias("pos"), "temp_id", "name", "entity_type", "confidence", empty.alias("props"), whole)
        start = F.col("valid_from") if "valid_from" in said.columns else none
        own = F.col("props") if "props" in said.columns else empty
        temp = F.concat_ws("_", "unit", F.lit("r"), "pos").alias("temp_id")
        said = said.join(place, "unit", "left").select("batch", F.struct(F.lit(1).alias("a"), F.col("_block").cast("long").alias("b"), F.col("pos").cast("long").alias("c"), temp).alias("pos"), temp, "subject_temp_id", "object_temp_id", "predicate", start.alias("valid_from"), "confidence", own.alias("props"), span(said))
        temp = F.concat_ws("_", "batch", F.lit("t"), "pos").alias("temp_id")
        stated = stated.select("batch", F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), F.col("pos").cast("long").alias("c"), temp).alias("pos"), temp, "subject_temp_id", "object_temp_id", "predicate", none.alias("valid_from"), "confidence", "props", whole)
        number = lambda df: df.withColumn("pos", F.row_number().over(Window.partitionBy("batch").orderBy("pos")) - 1)
        ents, rels = number(found.unionByName(given)), number(said.unionByName(stated))
        known = t["edges"].select("predicate").distinct()
        spoken = rels.select("predicate").distinct()
        near = vectors.top_k(vectors.vector_table(spoken, "predicate", F.col("predicate")).withColumnRenamed("key", "query_id"), vectors.vector_table(known, "predicate", F.col("predicate")), 1)
        rels = rels.join(resolve.normal_predicates(spoken, near, self.settings.same_predicate), "predicate").withColumn("predicate", F.col("normal")).drop("normal")
        ents, rels = candidates.drop_unnamed(ents, rels)
        return links.cut(candidates.merge_entities(ents)), links.cut(candidates.merge_relations(rels, candidates.survivors(ents)))

    def _ops(self, ents: DataFrame, rels: DataFrame, t: dict[str, DataFrame], at: str) -> DataFrame:
        graph_types = t["schema_types"].filter("status = 'approved'").select("type_name").unionByName(t["entities"].select(F.col("entity_type").alias("type_name")).distinct())
        known_types = graph_types.unionByName(self.spark.createDataFrame([(n,) for n in SEED_TYPES], "type_name string"))
        fresh = candidates.new_types(ents, known_types).withColumn("new_type", F.lit(True))
        keyed = ents.join(fresh, "entity_type", "left").withColumn("new_type", F.coalesce("new_type", F.lit(False)))
        keyed = keyed.withColumn("patch_id", F.concat(F.lit("patch_"), "batch")).withColumn("cand_id", F.concat_ws("|", "batch", "temp_id"))
        index = vectors.upserted(t["entity_vectors"], t["entities"], "id", entity_text(F.col("name"), F.col("description")))
        asked = vectors.vector_table(keyed, "cand_id", entity_text(F.col("name"), F.try_element_at("props", F.lit("description")))).withColumnRenamed("key", "query_id")
        hits = links.cut(vectors.top_k(asked, index, HITS).withColumnRenamed("query_id", "cand_id"))
        resolved = links.cut(resolve.cascade(keyed, t["entities"], hits, name_judge(t["entities"]), self.settings.accept, self.settings.reject))
        nodes = propose.node_ops(resolved, t["entities"])
        updates = propose.update_ops(resolved, nodes, t["entities"])
        stated = rels.withColumn("patch_id", F.concat(F.lit("patch_"), "batch"))
        edges = propose.fact_ops(stated, resolved, nodes, t["entities"], t["edges"], self.adjudicator, at[:10], self.settings.many_valued)
        every = nodes.unionByName(updates, allowMissingColumns=True).unionByName(edges, allowMissingColumns=True)
        return propose.routed(every, t["edges"], self.settings.route_auto_approve, self.settings.route_auto_reject)

    # Types.

    def propose_type(self, type_name: str, parent: str, description: str) -> int:
        """Note a type for approval; the first proposal of a name stays. ``parent`` must be a known type."""
        t = self.store.read("schema_types")
        known = t.filter("status = 'approved'").select("type_name").unionByName(self.spark.createDataFrame([(n,) for n in SEED_TYPES], "type_name string"))
        if known.filter(F.col("type_name") == parent).isEmpty():
            raise ValueError(f"unknown parent type {parent}")
        if not t.filter(F.col("type_name") == type_name).isEmpty():
            return self.store.version()
        return self.store.publish({"schema_types": t.unionByName(self.spark.createDataFrame([(type_name, parent, description, "proposed")], t.schema))})

    def approve_type(self, type_name: str) -> int:
        """From now on ops with this type need no review for it; a name that nobody proposed is approved without a description."""
        t = self.store.read("schema_types")
        named = F.col("type_name") == type_name
        if t.filter(named).isEmpty():
            return self.store.publish({"schema_types": t.unionByName(self.spark.createDataFrame([(type_name, "Entity", "", "approved")], t.schema))})
        return self.store.publish({"schema_types": t.withColumn("status", F.when(named, "approved").otherwise(F.col("status")))})

    # Review and commit.

    def pending(self) -> DataFrame:
        return review.queue(self.store.read("patches"), self.store.read("patch_ops"))

    def review(self, decisions: DataFrame) -> int:
        t = self.store.tables()
        return self.store.publish({"decisions": t["decisions"].unionByName(decisions), "patch_ops": review.apply_decisions(t["patch_ops"], decisions)})

    def commit(self, at: str) -> DataFrame:
        """Commit what is approved; returns (patch_id, op_id, status). Documents of finished patches are noted as known."""
        t = self.store.tables()
        new, report = commit.commit(t, at)
        done = new["patches"].filter("status = 'committed'").join(t["documents"].select("doc_id"), "doc_id", "left_anti")
        done = done.groupBy(F.coalesce("content_hash", "doc_id").alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.min(F.coalesce("source_uri", "doc_id")).alias("source_uri"))
        new["documents"] = t["documents"].unionByName(done)
        self.store.publish({k: new[k] for k in ("entities", "edges", "aliases", "ledger", "patch_ops", "patches", "documents")})
        self.reindex()
        return report

    # Reading.

    def search(self, queries: DataFrame, as_of: str | None = None, hops: int = 2) -> DataFrame:
        """Facts for (query_id, query): four doors, fused; a walk from the seeds; sources. Columns of a named edge plus query_id, hop, sources."""
        t = self.store.tables()
        ents, edges = t["entities"], t["edges"]
        lists = doors(queries, ents, graph.named(edges, ents), t["entity_vectors"], t["fact_vectors"])
        seeds = fusion.rrf(lists)
        return retrieve(seeds, edges, ents, t["ledger"], t["documents"], as_of, hops)

    def ask(self, queries: DataFrame, as_of: str | None = None) -> DataFrame:
        """(query_id, answer, fact_ids); a fixed refusal where there are no facts."""
        found = self.search(queries, as_of)
        text = render_fact(F.col("subject"), F.col("predicate"), F.col("object"), F.col("valid_from"), F.col("valid_to"))
        order = Window.partitionBy("query_id").orderBy("hop", "id")
        told = self.composer(found.select("query_id", F.row_number().over(order).alias("n"), "id", text.alias("rendered")))
        return queries.join(told, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(REFUSAL)).alias("answer"), F.coalesce("fact_ids", F.array().cast("array<string>")).alias("fact_ids"))

    def evaluate(self, gold: DataFrame, found: DataFrame) -> DataFrame:
        return evaluate.report(gold, found, evaluate.greedy_match(gold, found))

    def evaluated(self, gold: DataFrame, found: DataFrame, folder: str, model: str, prompt: str, at: str) -> DataFrame:
        """The report of ``evaluate``, also written as JSON under ``folder`` with what made it: the model, a hash of its prompt, the time."""
        out = self.evaluate(gold, found).select(F.lit(at).alias("ran_at"), F.lit(model).alias("model"), F.substring(F.sha2(F.lit(prompt), 256), 1, 12).alias("prompt_sha"), F.lit(evaluate.SAME_PREDICATE).alias("pred_threshold"), "*")
        out.coalesce(1).write.json(f"{folder}/extraction_{at.replace(':', '').replace('-', '')[:15]}")
        return out

    def reindex(self, anew: bool = False) -> dict[str, DataFrame]:
        """Bring the stored vector tables of entities, predicates and facts up to date: only what is new or changed is embedded; ``anew``: everything."""
        t = self.store.tables()
        ents, edges = t["entities"], t["edges"]
        old = {n: t[n].limit(0) if anew else t[n] for n in ("entity_vectors", "predicate_vectors", "fact_vectors")}
        new = {
            "entity_vectors": vectors.upserted(old["entity_vectors"], ents, "id", entity_text(F.col("name"), F.col("description"))),
            "predicate_vectors": vectors.upserted(old["predicate_vectors"], edges.select("predicate").distinct(), "predicate", F.col("predicate")),
            "fact_vectors": vectors.upserted(old["fact_vectors"], graph.named(edges, ents), "id", _fact_text()),
        }
        self.store.publish(new)
        return {n: self.store.read(n) for n in new}

    def faults(self) -> DataFrame:
        """(table, key, n): keys that should be unique and aren't."""
        out = None
        for name, key in (("entities", "id"), ("ledger", "op_id"), ("documents", "content_hash"), ("patches", "patch_id")):
            one = self.store.read(name).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(name).alias("table"), "key", "n")
            out = one if out is None else out.unionByName(one)
        return out

    def node(self, node_id: str) -> dict[str, DataFrame]:
        """A node's report: itself, aliases, edges, the ops that wrote it by time, and the decisions on these."""
        t = self.store.tables()
        one = self.spark.createDataFrame([(node_id,)], "node_id string")
        wrote = graph.written(t["ledger"], one, t["documents"])
        return {
            "node": t["entities"].filter(F.col("id") == node_id), "aliases": t["aliases"].filter(F.col("canonical_id") == node_id),
            "edges": graph.incident(t["edges"], t["entities"], one), "provenance": wrote, "decisions": graph.decided(wrote, t["decisions"]),
        }

    def reset(self) -> int:
        return self.store.reset()


def _fact_text() -> Column:
    return fact_text(F.col("subject"), F.col("predicate"), F.col("object"), F.col("valid_from"), F.col("valid_to"), F.col("quotes"))


def doors(queries: DataFrame, entities: DataFrame, facts_: DataFrame, entity_vectors: DataFrame | None = None, fact_vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, list, pos, id) of the four ranked lists: vector anchors, ends of vector facts, lexical entities, ends of lexical facts.

    ``facts_``: edges with their ends' names. Stored indexes (key, text, vector) are used where given, and brought up to date for what they lack.
    """
    spark = queries.sparkSession
    empty = spark.createDataFrame([], "key string, text string, vector array<float>")
    asked = links.cut(vectors.vector_table(queries, "query_id", F.col("query")).withColumnRenamed("key", "query_id"))
    index = vectors.upserted(empty if entity_vectors is None else entity_vectors, entities, "id", entity_text(F.col("name"), F.col("description")))
    anchors = vectors.top_k(asked, index, ANCHORS, ANCHOR_FLOOR)
    near = vectors.top_k(asked, vectors.upserted(empty if fact_vectors is None else fact_vectors, facts_, "id", _fact_text()), FACTS, FACT_FLOOR)
    lex = lexical.search(entities.withColumn("_t", F.concat_ws(" ", "name", "description")), "id", "_t", queries)
    lex_facts = lexical.search(facts_.withColumn("_t", F.concat_ws(" ", "predicate", F.array_join("quotes", " "))), "id", "_t", queries)
    ends = facts_.select(F.col("id").alias("key"), "subject_id", "object_id")

    def both(hits: DataFrame) -> DataFrame:
        rows = hits.join(ends, "key").select("query_id", "rank", F.posexplode(F.array("subject_id", "object_id")).alias("side", "id"))
        return rows.select("query_id", (2 * F.col("rank") + F.col("side")).alias("pos"), "id")

    plain = lambda hits: hits.select("query_id", F.col("rank").alias("pos"), F.col("key").alias("id"))
    lists = [plain(anchors), both(near), plain(lex), both(lex_facts)]
    out = None
    for n, one in enumerate(lists):
        one = one.select("query_id", F.lit(n).alias("list"), F.col("pos").cast("int").alias("pos"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def retrieve(seeds: DataFrame, edges: DataFrame, entities: DataFrame, ledger: DataFrame, documents_: DataFrame, as_of: str | None, hops: int, limit: int = graph.FACT_LIMIT) -> DataFrame:
    """Facts around each query's seeds (query_id, id): walked for all queries at once, nearest first, at most ``limit`` a query, with sources.

    A query that has ``limit`` facts goes no further, so a hop brings at most the edges of nodes that the facts kept so far lead to.
    """
    valid = links.cut(facts(edges, as_of))
    steps = graph.steps(valid)
    seen = seeds.select("query_id", "id").distinct()
    frontier, met = seen, None
    order = Window.partitionBy("query_id").orderBy("hop", "id")
    for hop in range(1, hops + 1):
        out = steps.join(frontier.select("query_id", F.col("id").alias("at")), "at")
        found = out.select("query_id", "id").distinct().withColumn("hop", F.lit(hop))
        met = found if met is None else met.unionByName(found.join(met, ["query_id", "id"], "left_anti"))
        met = links.cut(met.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n"))
        if hop < hops:
            full = met.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= limit)
            frontier = out.join(met, ["query_id", "id"], "left_semi").select("query_id", F.col("to").alias("id")).distinct()
            frontier = frontier.join(seen, ["query_id", "id"], "left_anti").join(full, "query_id", "left_anti")
            seen = seen.unionByName(frontier)
    return met.join(graph.provenance(graph.named(valid.join(met.select("id").distinct(), "id", "left_semi"), entities), ledger, documents_), "id")
