"""The driver's query catalogue over the standard tables: a query and, where SQL can say it, the DuckDB SQL for its rows.

The graph and the staging area are derived from the tables (see fixtures); every query covers whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimgraph.functions import text as T
from claimgraph.operators import candidates, commit, correlate, evaluate, fusion, graph, lexical, resolve, review, scoring, temporal, vectors
from claimgraph.plans.fixtures import EDGES_SQL, ENTITIES_SQL, OPS_SQL, Graph
from claimgraph.sources import documents as D

AS_OF = "1997-01-01"
BOTH = ENTITIES_SQL + "," + EDGES_SQL
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_HOLDS = f"(valid_from IS NULL OR valid_from <= '{AS_OF}') AND (valid_to IS NULL OR valid_to > '{AS_OF}')"
_WHITE = f"'{T.WHITE}'"
_WORDS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"


def query(sql: str | None = None, *parts: str):
    """Register a query of a Graph; ``parts`` are the ``WITH`` parts that its SQL uses."""

    def add(f: Callable[[Graph], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = ("WITH " + ",".join(parts) + sql) if parts else sql
        return f

    return add


EDGE = ["id", "subject_id", "object_id", "predicate", "valid_from", "valid_to"]
_EDGE = ", ".join(EDGE)


# Facts in time.


@query(f" SELECT {_EDGE} FROM edges WHERE valid_to IS NULL", EDGES_SQL)
def current_facts(g):
    return temporal.facts(g.edges()).select(*EDGE)


@query(f" SELECT {_EDGE} FROM edges WHERE {_HOLDS}", EDGES_SQL)
def facts_as_of(g):
    return temporal.facts(g.edges(), AS_OF).select(*EDGE)


@query(" SELECT subject_id, predicate, count(*) AS n, count(*) FILTER (WHERE valid_to IS NULL) AS n_open, min(valid_from) AS first_from FROM edges GROUP BY ALL", EDGES_SQL)
def fact_history(g):
    return g.edges().groupBy("subject_id", "predicate").agg(F.count("*").alias("n"), F.count_if(temporal.holds()).alias("n_open"), F.min("valid_from").alias("first_from"))


@query(
    " , c AS (SELECT * FROM chain WHERE valid_to IS NULL OR valid_to > valid_from) SELECT a.id, a.object_id, a.valid_from, a.valid_to, min(b.id) AS closed_by"
    " FROM c a LEFT JOIN c b ON a.subject_id = b.subject_id AND a.valid_to = b.valid_from GROUP BY ALL", EDGES_SQL,
)
def supersession_chain(g):
    c = g.priorities()
    nxt = c.groupBy("subject_id", F.col("valid_from").alias("valid_to")).agg(F.min("id").alias("closed_by"))
    return c.join(nxt, ["subject_id", "valid_to"], "left").select("id", "object_id", "valid_from", "valid_to", "closed_by")


# The graph.

_STEPS = " , v AS (SELECT * FROM edges WHERE {}), st AS (SELECT subject_id AS a, object_id AS b, id FROM v UNION SELECT object_id, subject_id, id FROM v)"
_BUSIEST = " , anchor AS (SELECT 'N#' || min(n_nationkey) AS id FROM nation)"


def _anchor(g):
    return g.table("nation").agg(F.concat(F.lit("N#"), F.min("n_nationkey").cast("string")).alias("id"))


@query(
    _BUSIEST + _STEPS.format("valid_to IS NULL") + " SELECT DISTINCT e.id, s.name AS subject, e.predicate, o.name AS object, 1 AS hop FROM st JOIN anchor ON st.a = anchor.id JOIN edges e"
    " ON e.id = st.id JOIN entities s ON s.id = e.subject_id JOIN entities o ON o.id = e.object_id", BOTH,
)
def neighborhood_1hop(g):
    return graph.neighborhood(g.edges(), g.entities(), _anchor(g), 1, None, None).select("id", "subject", "predicate", "object", "hop")


@query(
    _BUSIEST + _STEPS.format(_HOLDS) + " , h1 AS (SELECT DISTINCT st.id, st.b FROM st JOIN anchor ON st.a = anchor.id), f AS (SELECT DISTINCT b FROM h1 WHERE b NOT IN (SELECT id FROM anchor)),"
    " h2 AS (SELECT DISTINCT st.id FROM st JOIN f ON st.a = f.b), m AS (SELECT id, min(hop) AS hop FROM (SELECT id, 1 AS hop FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY id)"
    " SELECT e.id, s.name AS subject, e.predicate, o.name AS object, e.valid_from, e.valid_to, m.hop FROM m JOIN edges e ON e.id = m.id JOIN entities s ON s.id = e.subject_id JOIN entities o ON o.id = e.object_id", BOTH,
)
def neighborhood_2hop_as_of(g):
    out = graph.neighborhood(g.edges(), g.entities(), _anchor(g), 2, AS_OF, None)
    return out.select("id", "subject", "predicate", "object", "valid_from", "valid_to", "hop")


@query(
    _BUSIEST + _STEPS.format("true") + " , h1 AS (SELECT DISTINCT st.id, st.b FROM st JOIN anchor ON st.a = anchor.id), n1 AS (SELECT DISTINCT b FROM h1 WHERE b NOT IN (SELECT id FROM anchor)),"
    " h2 AS (SELECT DISTINCT st.id, st.b FROM st JOIN n1 ON st.a = n1.b), n2 AS (SELECT DISTINCT b FROM h2 WHERE b NOT IN (SELECT id FROM anchor) AND b NOT IN (SELECT b FROM n1))"
    " SELECT 'node' AS kind, id, 0 AS hop FROM anchor UNION ALL SELECT 'node', b, 1 FROM n1 UNION ALL SELECT 'node', b, 2 FROM n2"
    " UNION ALL SELECT 'edge', id, min(hop) FROM (SELECT id, 1 AS hop FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY id", BOTH,
)
def subgraph_for_review(g):
    nodes, edges = graph.subgraph(g.edges(), _anchor(g), 2)
    return nodes.select(F.lit("node").alias("kind"), "id", "hop").unionByName(edges.select(F.lit("edge").alias("kind"), "id", "hop"))


@query(" SELECT id, count(*) AS degree FROM (SELECT subject_id AS id FROM edges UNION ALL SELECT object_id FROM edges) GROUP BY id", EDGES_SQL)
def node_degree(g):
    return graph.degree(g.edges())


@query(
    " SELECT (SELECT count(*) FROM entities) AS nodes, count(*) FILTER (WHERE valid_to IS NULL) AS current_edges, count(*) FILTER (WHERE valid_to IS NOT NULL) AS superseded_edges, (SELECT count(*) FROM documents) AS documents,"
    " (SELECT count(*) FROM labels) AS decisions, (SELECT count(*) FROM staged WHERE route = 'review' AND status = 'pending') AS pending_ops FROM edges", BOTH, OPS_SQL,
)
def graph_stats(g):
    return graph.stats(g.entities(), g.edges(), g.table("documents"), g.table("labels"), g.ops())


@query(" SELECT 'entity_type' AS kind, entity_type AS value FROM entities UNION SELECT 'predicate', predicate FROM edges", BOTH)
def known_vocabulary(g):
    return graph.vocabulary(g.entities(), g.edges())


@query(" SELECT e.id, n.degree FROM entities e JOIN (SELECT id, count(*) AS degree FROM (SELECT subject_id AS id FROM edges UNION ALL SELECT object_id FROM edges) GROUP BY id) n USING (id)"
       " UNION ALL SELECT id, 0 FROM entities WHERE id NOT IN (SELECT subject_id FROM edges) AND id NOT IN (SELECT object_id FROM edges)", BOTH)  # fmt: skip
def graph_export_nodes(g):
    return graph.export(g.entities(), g.edges())[0].select("id", "degree")


@query(
    " SELECT e.id, e.subject_id, e.object_id, e.predicate FROM edges e WHERE valid_to IS NULL AND EXISTS (SELECT 1 FROM orders WHERE 'C#' || o_custkey = e.subject_id AND 'Q#' || o_orderpriority = e.object_id)", EDGES_SQL,
)
def edges_between(g):
    pairs = g.table("orders").select(F.concat(F.lit("C#"), F.col("o_custkey").cast("string")).alias("subject_id"), F.concat(F.lit("Q#"), "o_orderpriority").alias("object_id"))
    return graph.edges_between(g.edges(), pairs).select("id", "subject_id", "object_id", "predicate")


@query(
    " SELECT e.id, e.subject_id, e.predicate, o.name AS object FROM edges e JOIN entities o ON o.id = e.object_id WHERE valid_to IS NULL AND predicate = 'supplies'", BOTH,
)
def edges_from(g):
    keys = g.table("supplier").select(F.concat(F.lit("S#"), F.col("s_suppkey").cast("string")).alias("subject_id"), F.lit("supplies").alias("predicate"))
    return graph.edges_from(g.edges(), keys, g.entities()).select("id", "subject_id", "predicate", "object")


@query(
    " SELECT e.id, e.object_id, e.predicate, s.name AS subject FROM edges e JOIN entities s ON s.id = e.subject_id WHERE valid_to IS NULL AND predicate = 'located_in'", BOTH,
)
def edges_to(g):
    keys = g.table("nation").select(F.concat(F.lit("N#"), F.col("n_nationkey").cast("string")).alias("object_id"), F.lit("located_in").alias("predicate"))
    return graph.edges_to(g.edges(), keys, g.entities()).select("id", "object_id", "predicate", "subject")


_NAMED = " FROM edges e JOIN entities s ON s.id = e.subject_id JOIN entities o ON o.id = e.object_id"


@query(
    " SELECT e.id, '(' || s.name || ') —' || e.predicate || '→ (' || o.name || ')' || CASE WHEN valid_from IS NOT NULL OR valid_to IS NOT NULL"
    " THEN ' [from ' || coalesce(valid_from, '…') || ' to ' || coalesce(valid_to, 'now') || ']' ELSE '' END AS rendered" + _NAMED, BOTH,
)
def fact_render(g):
    c = [F.col(x) for x in ("subject", "predicate", "object", "valid_from", "valid_to")]
    return graph.named(g.edges(), g.entities()).select("id", T.render_fact(*c).alias("rendered"))


@query(
    " SELECT e.id, trim(s.name || ' ' || e.predicate || ' ' || o.name || CASE WHEN valid_from IS NOT NULL OR valid_to IS NOT NULL"
    " THEN ' · ' || coalesce(valid_from, '') || '→' || coalesce(valid_to, '') ELSE '' END || ' ' || 'seen ' || support || ' times') AS fact_text" + _NAMED, BOTH,
)
def fact_text(g):
    c = [F.col(x) for x in ("subject", "predicate", "object", "valid_from", "valid_to")]
    quotes = F.array(F.concat(F.lit("seen "), F.col("support").cast("string"), F.lit(" times")))
    return graph.named(g.edges(), g.entities()).select("id", T.fact_text(*c, quotes).alias("fact_text"))


@query(
    " SELECT 'SP#' || l_suppkey || '_' || l_partkey AS id, count(DISTINCT l_orderkey) AS n_sources, string_agg(DISTINCT 'O#' || o_orderkey || '@' || strftime(o_orderdate, '%Y-%m-%d'), ';'"
    " ORDER BY 'O#' || o_orderkey || '@' || strftime(o_orderdate, '%Y-%m-%d')) AS sources FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
)
def fact_provenance(g):
    out = graph.provenance(g.edges().filter("predicate = 'supplies'"), g.ledger(), g.sources())
    return out.select("id", F.size("sources").cast("long").alias("n_sources"), F.array_join("sources", ";").alias("sources"))


@query(
    " , i AS (SELECT subject_id AS node_id, id AS edge_id, predicate, object_id AS oid, true AS outgoing, valid_to FROM edges UNION ALL SELECT object_id, id, predicate, subject_id, false, valid_to FROM edges WHERE subject_id <> object_id)"
    " SELECT node_id, edge_id, predicate, o.name AS other, outgoing, row_number() OVER (PARTITION BY node_id ORDER BY valid_to IS NOT NULL, predicate, edge_id) AS n FROM i JOIN entities e ON e.id = node_id JOIN entities o ON o.id = oid WHERE e.entity_type = 'Agent'", BOTH,
)
def node_detail(g):
    agents = g.entities().filter("entity_type = 'Agent'").select(F.col("id").alias("node_id"))
    return graph.incident(g.edges(), g.entities(), agents).select("node_id", "edge_id", "predicate", "other", "outgoing", F.col("n").cast("long").alias("n"))


def _written(g):
    """Each order as an op that wrote its customer's node."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    ledger = g.table("orders").select(F.concat(key("op", "o_orderkey"), F.lit("-1")).alias("op_id"), key("p", "o_orderkey").alias("patch_id"), key("O#", "o_orderkey").alias("doc_id"), key("C#", "o_custkey").alias("node_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))
    agents = g.entities().filter("entity_type = 'Agent'").select(F.col("id").alias("node_id"))
    return graph.written(ledger, agents, g.sources())


@query(
    "SELECT 'C#' || o_custkey AS node_id, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d'), 'op' || o_orderkey || '-1') AS n, 'op' || o_orderkey || '-1' AS op_id, 'O#' || o_orderkey || '@' || strftime(o_orderdate, '%Y-%m-%d') AS source FROM orders",
)
def node_provenance(g):
    return _written(g).select("node_id", F.col("n").cast("long").alias("n"), "op_id", "source")


@query("SELECT 'op' || o_orderkey || '-1' AS op_id, CASE o_orderpriority[1] WHEN '1' THEN 'accept' WHEN '5' THEN 'reject' ELSE 'defer' END AS action FROM orders WHERE o_totalprice > 100000")
def node_decisions(g):
    """The decisions on the ops that wrote customers, of dear orders."""
    dear = g.table("orders").filter("o_totalprice > 100000").select(F.concat(F.lit("op"), F.col("o_orderkey").cast("string"), F.lit("-1")).alias("op_id"))
    return graph.decided(_written(g).join(dear, "op_id"), _decisions(g)).select("op_id", "action")


@query(" SELECT e.id, s.name AS subject, o.name AS object, valid_to IS NULL AS open FROM edges e JOIN entities s ON s.id = e.subject_id JOIN entities o ON o.id = e.object_id", BOTH)
def graph_export_edges(g):
    return graph.export(g.entities(), g.edges())[1].select("id", "subject", "object", "open")


# Documents.


@query("SELECT CAST(doc_id AS VARCHAR) AS doc, sha256(coalesce(text, '')) AS content_hash, 'doc_' || sha256(coalesce(text, ''))[1:16] AS doc_id FROM documents")
def register_documents(g):
    h, d = D.registered(F.col("text"))
    return g.texts().select(F.col("doc_id").alias("doc"), h, d)


@query("SELECT sha256(coalesce(text, '')) AS content_hash, 'doc:' || lpad(CAST(min(doc_id) AS VARCHAR), 12, '0') AS source_uri, count(*) AS copies FROM documents GROUP BY 1")
def duplicate_documents(g):
    docs = g.texts()
    n = docs.groupBy("content_hash").agg(F.count("*").alias("copies"))
    return D.first_copies(docs.select("content_hash", "source_uri")).join(n, "content_hash")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def intake_lock(g):
    patches = g.table("labels").select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("quality") == 0, "pending").otherwise("committed").alias("status"))
    return D.locked(g.texts(), patches).select("doc_id")


_PARTS = (
    f"parts AS (SELECT d, k - 1 AS pos, trim(ps[k], {_WHITE}) AS text FROM (SELECT CAST(doc_id AS VARCHAR) AS d, string_split(coalesce(text, ''), chr(10)) AS ps, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS k"
    f" FROM documents) WHERE trim(ps[k], {_WHITE}) <> '')"
)


def _blocks(g):
    return D.blocks(g.texts(), "\n")


@query(" SELECT d AS doc_id, CAST(pos AS INTEGER) AS pos, d || '_b' || pos AS block_id, text FROM parts", _PARTS)
def markdown_blocks(g):
    return _blocks(g).select("doc_id", "pos", "block_id", "text")


@query(" SELECT d || '_b' || pos || '_u0' AS unit_id, text FROM parts WHERE NOT starts_with(text, '#')", _PARTS)
def decompose_units(g):
    return D.units(D.with_headings(_blocks(g))).select("unit_id", "text")


@query(
    " , hs AS (SELECT d, pos, length(regexp_extract(text, '^(#*)', 1)) AS lvl, trim(ltrim(text, '#'), " + _WHITE + ") AS title, row_number() OVER (PARTITION BY d ORDER BY pos) AS k FROM parts WHERE starts_with(text, '#')),"
    " st AS (SELECT d, pos, k, [title] AS stack FROM hs WHERE k = 1 UNION ALL SELECT hs.d, hs.pos, hs.k, list_concat(st.stack[1:hs.lvl - 1], [hs.title]) FROM st JOIN hs ON hs.d = st.d AND hs.k = st.k + 1)"
    " SELECT parts.d || '_b' || parts.pos AS block_id, CASE WHEN starts_with(text, '#') THEN 'heading' ELSE 'paragraph' END AS kind, array_to_string(coalesce(arg_max(st.stack, st.pos), []), ' / ') AS headings"
    " FROM parts LEFT JOIN st ON st.d = parts.d AND st.pos <= parts.pos GROUP BY parts.d, parts.pos, text", "RECURSIVE " + _PARTS,
)
def heading_context(g):
    return D.with_headings(_blocks(g)).select("block_id", "kind", F.array_join("headings", " / ").alias("headings"))


@query(f"SELECT 'conv_' || conv_id || '_b' || turn || '_u0' AS unit_id, coalesce(role, 'unknown') || ': ' || trim(coalesce(text, ''), {_WHITE}) AS text FROM conversations")
def transcript_units(g):
    return D.units(D.transcript(g.table("conversations"))).select("unit_id", "text")


@query(
    "WITH x AS (SELECT page_id, string_split(html, '<p>') AS ps FROM pages WHERE html IS NOT NULL), y AS (SELECT page_id, k - 2 AS pos, ps[k] AS t FROM (SELECT page_id, ps, unnest(range(2, len(ps) + 1)) AS k FROM x)),"
    " z AS (SELECT page_id, pos, trim(regexp_replace(regexp_replace(t, '(?s)(</p>|</article>).*', ''), '<[^>]*>', '', 'g'), " + _WHITE + ") AS t FROM y) SELECT 'page_' || page_id || '_b' || pos AS block_id, t AS text FROM z WHERE t <> ''",
)
def html_blocks(g):
    return D.html_paragraphs(g.table("pages")).select("block_id", "text")


@query(
    "SELECT 'c' || c_custkey AS batch, c_name AS subject, 'FLOWS_TO' AS predicate, 'Account ' || c_mktsegment AS object FROM customer"
    " UNION ALL SELECT 'c' || c_custkey, c_name, 'IS_A', 'userTask' FROM customer UNION ALL SELECT 'c' || c_custkey, 'Account ' || c_mktsegment, 'IS_A', 'endEvent' FROM customer",
)
def bpmn_triples(g):
    return bpmn_rows(g).select("batch", "subject", "predicate", "object")


def bpmn_rows(g):
    xml = F.format_string(
        '<definitions xmlns="http://www.omg.org/spec/BPMN/20100524/MODEL"><process><userTask id="a" name="%s"/><endEvent id="b" name="Account %s"/><sequenceFlow id="f" sourceRef="a" targetRef="b"/></process></definitions>',
        F.col("c_name"), F.col("c_mktsegment"),
    )
    docs = g.table("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("doc_id"), xml.alias("text"))
    return D.bpmn_triples(docs)


@query(
    "SELECT DISTINCT batch, name, entity_type FROM (SELECT 'c' || c_custkey AS batch, c_name AS name, 'userTask' AS entity_type FROM customer UNION ALL SELECT 'c' || c_custkey, 'Account ' || c_mktsegment, 'endEvent' FROM customer)",
)
def structured_candidates(g):
    triples = bpmn_rows(g)
    return candidates.from_triples(triples)[0].select("batch", "name", "entity_type")


# Candidates.

_PRON = ", ".join(f"'{p}'" for p in T.PRONOUNS)
_OPEN = "|".join(T.GENERIC_OPENINGS)


@query(f" SELECT d || '_b' || pos AS temp_id, text AS name FROM parts WHERE NOT (lower(text) IN ({_PRON}) OR (lower(text) = text AND regexp_matches(text, '^({_OPEN}) ')))", _PARTS)
def unnamed_filter(g):
    ents = _blocks(g).select(F.col("doc_id").alias("batch"), F.col("block_id").alias("temp_id"), F.col("text").alias("name"))
    rels = ents.select("batch", F.col("temp_id").alias("subject_temp_id"), F.col("temp_id").alias("object_temp_id"))
    return candidates.drop_unnamed(ents, rels)[0].select("temp_id", "name")


def _parts_as_entities(g):
    empty = F.create_map(F.lit("size"), F.col("p_size").cast("string"))
    return g.table("part").select(
        F.lit("b").alias("batch"), F.col("p_partkey").alias("pos"), F.concat(F.lit("P#"), F.col("p_partkey").cast("string")).alias("temp_id"), F.col("p_name").alias("name"), F.col("p_type").alias("entity_type"),
        F.col("p_retailprice").alias("confidence"), empty.alias("props"), F.array(F.struct(F.col("p_brand").alias("quote"))).alias("evidence"),
    )


@query(
    f"SELECT lower(trim(p_name, {_WHITE})) AS key, 'P#' || min(p_partkey) AS temp_id, count(*) AS mentions, arg_max(p_type, (p_retailprice, -p_partkey)) AS entity_type, max(p_retailprice) AS confidence,"
    " arg_min(CAST(p_size AS VARCHAR), p_partkey) AS size, string_agg(p_brand, ',' ORDER BY p_partkey) AS brands FROM part GROUP BY 1",
)
def dedupe_entities(g):
    out = candidates.merge_entities(_parts_as_entities(g))
    return out.select("key", "temp_id", "mentions", "entity_type", "confidence", F.col("props")["size"].alias("size"), F.array_join("evidence.quote", ",").alias("brands"))


@query(
    f"WITH s AS (SELECT 'P#' || p_partkey AS t, 'P#' || min(p_partkey) OVER (PARTITION BY lower(trim(p_name, {_WHITE}))) AS survivor FROM part)"
    " SELECT 'S#' || l_suppkey AS subject_temp_id, survivor AS object_temp_id, count(*) AS mentions, max(l_quantity) AS confidence, arg_min(strftime(l_shipdate, '%Y-%m-%d'), (l_orderkey, l_linenumber, l_shipdate)) AS valid_from"
    " FROM lineitem JOIN s ON t = 'P#' || l_partkey GROUP BY 1, 2",
)
def dedupe_relations(g):
    """A line is named by order and number, which isn't unique in the tables, so its date is part of its place."""
    rels = g.table("lineitem").select(
        F.lit("b").alias("batch"), F.struct("l_orderkey", "l_linenumber", "l_shipdate").alias("pos"), F.concat_ws("-", F.lit("r"), "l_orderkey", "l_linenumber").alias("temp_id"),
        F.concat(F.lit("S#"), F.col("l_suppkey").cast("string")).alias("subject_temp_id"), F.concat(F.lit("P#"), F.col("l_partkey").cast("string")).alias("object_temp_id"), F.lit("supplies").alias("predicate"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("valid_from"), F.col("l_quantity").alias("confidence"), F.create_map().cast("map<string,string>").alias("props"), F.array("l_returnflag").alias("evidence"),
    )
    return candidates.merge_relations(rels, candidates.survivors(_parts_as_entities(g))).select("subject_temp_id", "object_temp_id", "mentions", "confidence", "valid_from")


@query("SELECT DISTINCT p_type || '/' || p_size AS entity_type FROM part WHERE p_type || '/' || p_size NOT IN (SELECT p_type || '/' || p_size FROM part WHERE p_retailprice > 1500)")
def new_types(g):
    """Types and sizes of parts that no dear part has."""
    parts = g.table("part").withColumn("kind", F.concat_ws("/", "p_type", F.col("p_size").cast("string")))
    return candidates.new_types(parts.select(F.col("kind").alias("entity_type")), parts.filter("p_retailprice > 1500").select(F.col("kind").alias("type_name")).distinct())


# Vectors, words, fusion.


@query(
    " SELECT 'P#' || p_partkey AS cand, (SELECT min(id) FROM entities e WHERE lower(e.name) = lower(p_name)) AS canonical_id FROM part", ENTITIES_SQL,
)
def rules_match(g):
    names = g.table("part").select(F.concat(F.lit("P#"), F.col("p_partkey").cast("string")).alias("cand"), F.col("p_name").alias("name"))
    return resolve.rules_match(names, g.entities()).select("cand", "canonical_id")


_COS = (
    "pairs AS (SELECT q.label AS query_id, e.vec_id AS key, round(greatest(0, least(1, list_cosine_similarity(CAST(q.v AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))), 6) AS score FROM"
    " (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label) q, embeddings e), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM pairs)"
)


def _label_hits(g, k):
    e = g.table("embeddings")
    asked = e.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    return vectors.top_k(asked, e.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), k)


@query(" SELECT query_id, rank, key, score FROM ranked WHERE rank <= 5", _COS)
def vector_topk(g):
    return _label_hits(g, 5).withColumn("rank", F.col("rank").cast("long"))


@query(
    " , hit AS (SELECT query_id, key, score FROM ranked WHERE rank = 2) SELECT CAST(query_id AS VARCHAR) AS cand_id, CASE WHEN score >= 0.42 THEN CAST(key AS VARCHAR) END AS canonical_id, score,"
    " CASE WHEN score >= 0.42 THEN 'embedding' WHEN score < 0.36 THEN 'none' ELSE 'llm' END AS method FROM hit", _COS,
)
def resolve_cascade(g):
    """Thresholds are set for these vectors; a judge that never decides. The label's own vector is left out."""
    hits = _label_hits(g, 2).filter("rank = 2").select(F.col("query_id").cast("string").alias("cand_id"), F.lit(1).alias("rank"), F.col("key").cast("string").alias("key"), "score")
    cands = hits.select("cand_id", F.concat(F.lit("label "), "cand_id").alias("name"))
    return resolve.cascade(cands, g.entities(), hits, None, 0.42, 0.36).select("cand_id", "canonical_id", "score", "method")


@query()
def normalize_predicate(g):
    """Flags and priorities as spellings of predicates; the default embedder is Python, so SQL has no equal."""
    said = g.table("orders").select(F.lower(F.regexp_replace("o_orderpriority", "-", " ")).alias("predicate")).distinct()
    known = g.table("orders").select("o_orderpriority").distinct()
    index = vectors.vector_table(known, "o_orderpriority", T.evaluated_predicate(F.col("o_orderpriority")))
    hits = vectors.top_k(vectors.vector_table(said, "predicate", F.col("predicate")).withColumnRenamed("key", "query_id"), index, 1)
    return resolve.normal_predicates(said, hits, 0.6)


_TERMS = (
    f"docs AS (SELECT doc_id AS key, {_WORDS.format('text')} AS t FROM documents), post AS (SELECT key, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT key, len(t) AS dl, unnest(t) AS term FROM docs) GROUP BY key, term),"
    f" qs AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format('text')}) AS term FROM benchmark),"
    " st AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM docs), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),"
    " sc AS (SELECT query_id, key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN qs USING (term) JOIN df USING (term), st GROUP BY query_id, key),"
    " rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM sc)"
)


def _bm25(g):
    docs = g.table("documents")
    asked = g.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return lexical.search(docs, "doc_id", "text", asked)


@query(" SELECT query_id, rank, key, round(score, 3) AS score FROM rk WHERE rank <= 8", _TERMS)
def bm25_topk(g):
    return _bm25(g).select("query_id", F.col("rank").cast("long").alias("rank"), "key", F.round("score", 3).alias("score"))


def _ranked_sql(docs: str, queries: str) -> str:
    return (
        f"docs AS ({docs}), post AS (SELECT key, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT key, len(t) AS dl, unnest(t) AS term FROM docs) GROUP BY key, term), qs AS ({queries}),"
        " st AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM docs), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),"
        " sc AS (SELECT query_id, key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN qs USING (term) JOIN df USING (term), st GROUP BY query_id, key),"
        " rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM sc)"
    )


@query(
    "," + _ranked_sql(f"SELECT id AS key, {_WORDS.format('concat_ws(chr(32), name, description)')} AS t FROM entities", f"SELECT DISTINCT n_nationkey AS query_id, unnest({_WORDS.format('n_name')}) AS term FROM nation")
    + " SELECT query_id, rank, key, round(score, 3) AS score FROM rk WHERE rank <= 8", ENTITIES_SQL,
)
def fulltext_entities(g):
    """Each nation's name looked up among all entities' names and descriptions."""
    rows = g.entities().withColumn("t", F.concat_ws(" ", "name", "description"))
    asked = g.table("nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("query"))
    return lexical.search(rows, "id", "t", asked).select("query_id", F.col("rank").cast("long").alias("rank"), "key", F.round("score", 3).alias("score"))


@query(
    "," + _ranked_sql(f"SELECT id AS key, {_WORDS.format('concat_ws(chr(32), predicate, valid_from)')} AS t FROM edges", "SELECT r_regionkey AS query_id, unnest(['part', 'of', CAST(1993 + r_regionkey AS VARCHAR)]) AS term FROM region")
    + " SELECT query_id, rank, key, round(score, 3) AS score FROM rk WHERE rank <= 8", EDGES_SQL,
)
def fulltext_facts(g):
    """What is a part of what, and what began in a year, among all facts."""
    rows = g.edges().withColumn("t", F.concat_ws(" ", "predicate", "valid_from"))
    asked = g.table("region").select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("part_of? "), (F.lit(1993) + F.col("r_regionkey")).cast("string")).alias("query"))
    asked = asked.withColumn("query", F.replace("query", F.lit("_"), F.lit(" ")))
    return lexical.search(rows, "id", "t", asked).select("query_id", F.col("rank").cast("long").alias("rank"), "key", F.round("score", 3).alias("score"))


@query()
def four_doors(g):
    """The four ranked lists of each region's question, and what a search fuses them to: two of them come from the Python embedder, so SQL has no equal."""
    from claimgraph.engine import doors

    ents = g.entities().filter("entity_type IN ('Place', 'Concept')")
    shown = graph.named(g.edges().filter("predicate = 'part_of'").withColumn("quotes", F.array().cast("array<string>")), ents)
    asked = g.table("region").select(F.concat(F.lit("q"), F.col("r_regionkey").cast("string")).alias("query_id"), F.col("r_name").alias("query"))
    return fusion.rrf(doors(asked, ents, shown)).withColumn("rank", F.col("rank").cast("long"))


def _lists(g):
    """Two rankings of each customer's priorities and of the segment's."""
    o, c = g.table("orders"), g.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = o.join(c, "o_custkey")
    by_price = Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey")
    by_date = Window.partitionBy("c_mktsegment").orderBy("o_orderdate", "o_orderkey")
    one = rows.select(F.col("c_mktsegment").alias("query_id"), F.lit(0).alias("list"), F.row_number().over(by_price).alias("pos"), F.col("o_custkey").alias("id"))
    return one.unionByName(rows.select(F.col("c_mktsegment").alias("query_id"), F.lit(1).alias("list"), F.row_number().over(by_date).alias("pos"), F.col("o_custkey").alias("id")))


_RRF = (
    "r AS (SELECT c_mktsegment AS query_id, o_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS p0, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate, o_orderkey) AS p1"
    " FROM orders JOIN customer ON c_custkey = o_custkey), l AS (SELECT query_id, 0 AS list, id, min(p0) AS pos FROM r GROUP BY ALL UNION ALL SELECT query_id, 1, id, min(p1) FROM r GROUP BY ALL),"
    " k AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY pos) AS k FROM l), s AS (SELECT query_id, id, round(sum(1.0 / (60 + k)), 9) AS score, min(list * 1000000000 + k) AS f FROM k GROUP BY ALL),"
    " fused AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f) AS rank, id, score FROM s)"
)


@query(" SELECT query_id, rank, id, score FROM fused WHERE rank <= 10", _RRF)
def rrf_fuse(g):
    return fusion.rrf(_lists(g)).withColumn("rank", F.col("rank").cast("long"))


@query(
    ", " + BOTH.strip() + " , seeds AS (SELECT query_id, 'C#' || id AS id FROM fused WHERE rank <= 10), v AS (SELECT * FROM edges WHERE " + _HOLDS + ")"
    " , f AS (SELECT DISTINCT s.query_id, v.id, v.subject_id, v.object_id FROM seeds s JOIN v ON v.subject_id = s.id OR v.object_id = s.id)"
    " SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM f) WHERE n <= 60", _RRF,
)
def hybrid_retrieve(g):
    from claimgraph.engine import retrieve

    seeds = fusion.rrf(_lists(g)).select("query_id", F.concat(F.lit("C#"), F.col("id").cast("string")).alias("id"))
    return retrieve(seeds, g.edges(), g.entities(), g.ledger(), g.sources(), AS_OF, 1).select("query_id", "id", "subject_id", "object_id")


@query(
    " SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY pos) AS n, id, predicate FROM (SELECT s_suppkey AS answer_id, unnest(['LS#' || s_suppkey, 'none', 'PR#' || s_nationkey]) AS id, unnest([0, 1, 2]) AS pos FROM supplier) JOIN edges USING (id)", EDGES_SQL,
)
def citations(g):
    ids = F.array(F.concat(F.lit("LS#"), F.col("s_suppkey").cast("string")), F.lit("none"), F.concat(F.lit("PR#"), F.col("s_nationkey").cast("string")))
    answers = g.table("supplier").select(F.col("s_suppkey").alias("answer_id"), ids.alias("fact_ids"))
    return fusion.citations(answers, g.edges()).select("answer_id", F.col("n").cast("long").alias("n"), "id", "predicate")


# Resolution and correlation.


@query(
    "SELECT c_custkey AS id, CASE WHEN contains(lower(o), lower(n)) THEN NULL WHEN contains(lower(n), lower(o)) THEN n ELSE rtrim(o, '.') || '. ' || n END AS description, CASE WHEN a = '' THEN 'gap' END AS filled"
    " FROM (SELECT c_custkey, c_mktsegment AS o, CASE c_nationkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_mktsegment || ' buyer' ELSE c_name END AS n, CASE WHEN c_acctbal < 0 THEN '' ELSE 'known' END AS a FROM customer)",
)
def extend_properties(g):
    seg, turn = F.col("c_mktsegment"), F.col("c_nationkey") % 3
    new = F.when(turn == 0, seg).when(turn == 1, F.concat(seg, F.lit(" buyer"))).otherwise(F.col("c_name"))
    old = F.create_map(F.lit("account"), F.when(F.col("c_acctbal") < 0, "").otherwise("known"))
    gained = resolve.extended(old, F.create_map(F.lit("account"), F.lit("gap"), F.lit("description"), new), seg)
    rows = g.table("customer").select(F.col("c_custkey").alias("id"), gained.alias("p"))
    return rows.select("id", F.try_element_at("p", F.lit("description")).alias("description"), F.try_element_at("p", F.lit("account")).alias("filled"))


def _new_facts(g):
    """Each order states its customer's priority anew, on its date."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return g.table("orders").select(key("f", "o_orderkey").alias("fact_id"), key("C#", "o_custkey").alias("subject_id"), F.lit("has_priority").alias("predicate"), F.concat(F.lit("Q#"), "o_orderpriority").alias("object_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid_from"))


_NEW = (
    "n AS (SELECT 'f' || o_orderkey AS fact_id, 'C#' || o_custkey AS s, 'Q#' || o_orderpriority AS o, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders), op AS (SELECT * FROM edges WHERE valid_to IS NULL AND predicate = 'has_priority'),"
    " same AS (SELECT fact_id, min(op.id) AS edge_id FROM n JOIN op ON s = subject_id AND o = object_id GROUP BY fact_id),"
    " ps AS (SELECT subject_id AS s, count(*) AS c1, max(valid_from) AS l1 FROM op GROUP BY 1), po AS (SELECT object_id AS o, count(*) AS c2, max(valid_from) AS l2 FROM op GROUP BY 1)"
)


@query(
    "," + _NEW + " SELECT fact_id, edge_id, CASE WHEN edge_id IS NOT NULL THEN 'reinforces' WHEN m = 0 THEN 'new' WHEN l IS NULL OR d > l THEN 'contradicts_temporal' ELSE 'contradicts_semantic' END AS correlation, CASE WHEN edge_id IS NULL THEN m ELSE 0 END AS n_collisions"
    " FROM (SELECT n.*, edge_id, coalesce(c1, 0) + coalesce(c2, 0) AS m, greatest(l1, l2) AS l FROM n LEFT JOIN same USING (fact_id) LEFT JOIN ps USING (s) LEFT JOIN po USING (o))", EDGES_SQL,
)
def correlate_relations(g):
    """Both sides: other priorities of the same customer, and the other customers of the same priority, of which there are many."""
    out = correlate.correlate(_new_facts(g), g.edges().filter("predicate = 'has_priority'"))
    return out.select("fact_id", "edge_id", "correlation", "n_collisions")


def _new_supplies(g):
    """Each supplier states that it supplies one part, from a date on; every third is a new supplier, every third names a new part."""
    key = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    turn = F.col("s_suppkey") % 3
    who, part = F.col("s_suppkey") + F.when(turn == 0, 1_000_000).otherwise(0), 1 + F.col("s_suppkey") * 7 % 100 + F.when(turn == 1, 1_000_000).otherwise(0)
    return g.table("supplier").select(key("f", F.col("s_suppkey")).alias("fact_id"), key("S#", who).alias("subject_id"), F.lit("supplies").alias("predicate"), key("P#", part).alias("object_id"), F.concat(F.lit("199"), (F.col("s_nationkey") % 8).cast("string"), F.lit("-06-15")).alias("valid_from"))


@query(
    ", n AS (SELECT 'f' || s_suppkey AS fact_id, 'S#' || (s_suppkey + CASE s_suppkey % 3 WHEN 0 THEN 1000000 ELSE 0 END) AS s, 'P#' || (1 + s_suppkey * 7 % 100 + CASE s_suppkey % 3 WHEN 1 THEN 1000000 ELSE 0 END) AS o, '199' || (s_nationkey % 8) || '-06-15' AS d FROM supplier), op AS (SELECT * FROM edges WHERE valid_to IS NULL AND predicate = 'supplies'),"
    " m AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM op WHERE subject_id = s AND object_id = o)),"
    " col AS (SELECT fact_id, id AS edge_id, d, valid_from AS old FROM m JOIN op ON (s = subject_id AND o <> object_id) UNION ALL SELECT fact_id, id, d, valid_from FROM m JOIN op ON (o = object_id AND s <> subject_id))"
    " SELECT fact_id, edge_id, d AS valid_to, CASE WHEN d > old THEN 'superseded' ELSE 'contradicted' END AS reason, NOT (d > old) AS semantic FROM col", EDGES_SQL,
)
def adjudicate_collisions(g):
    """Both sides, pair by pair: what else a supplier supplies, and who else supplies the part."""
    held, new = g.edges().filter("predicate = 'supplies'"), _new_supplies(g)
    met = correlate.collisions(new.join(correlate.exact(new, held), "fact_id", "left_anti"), held)
    return correlate.adjudicated(met.withColumn("outcome", correlate.by_rule(F.col("np"), F.col("old_from"), F.col("new_from"), [])), "2000-01-01")


# Scores, routes, review.


@query(" SELECT op_id, confidence FROM scored", OPS_SQL)
def score_ops(g):
    return g.ops().select("op_id", "confidence")


@query(" SELECT op_id, route, status FROM staged", OPS_SQL)
def route_ops(g):
    return g.ops().select("op_id", "route", "status")


@query("SELECT support, resolution, round(0.35 + 0.25 * least(support / 3.0, 1) + 0.25 * resolution + 0.15, 4) AS confidence, round(0.35 + 0.25 * least(support / 3.0, 1) + 0.25 * resolution + 0.15, 4) >= 0.92 AS approves FROM (VALUES (1), (2), (3)) s(support), (VALUES (0.5), (1.0)) r(resolution)")
def routing_bounds(g):
    rows = g.spark.createDataFrame([(s, r) for s in (1, 2, 3) for r in (0.5, 1.0)], "support int, resolution double")
    score = scoring.score(F.lit(1.0), F.col("support"), F.col("resolution"), F.lit(True))
    return rows.withColumn("confidence", score).withColumn("approves", scoring.route(F.lit("create_node"), F.col("confidence"), F.lit(False), F.lit(False)) == "approve")


@query(
    " SELECT op_id, kind, CASE kind WHEN 'node_exists' THEN EXISTS (SELECT 1 FROM entities WHERE id = subject_id) WHEN 'name_absent' THEN NOT EXISTS (SELECT 1 FROM part WHERE 'P#' || p_partkey = object_id)"
    " ELSE NOT EXISTS (SELECT 1 FROM edges WHERE valid_to IS NULL AND edges.subject_id = c.supplier_id AND edges.object_id = c.object_id AND predicate = 'supplies') END AS holds FROM"
    " (SELECT *, CASE op WHEN 'invalidate_edge' THEN 'node_exists' WHEN 'create_node' THEN 'name_absent' ELSE 'edge_absent' END AS kind FROM ops) c", BOTH, OPS_SQL,
)
def preconditions(g):
    named = g.table("part").select(F.concat(F.lit("P#"), F.col("p_partkey").cast("string")).alias("object_id"), F.col("p_name").alias("part_name"))
    ops = g.ops().join(named, "object_id", "left")
    kind = F.when(F.col("op") == "invalidate_edge", "node_exists").when(F.col("op") == "create_node", "name_absent").otherwise("edge_absent")
    subject = F.when(kind == "node_exists", F.col("subject_id")).when(kind == "name_absent", F.col("part_name")).otherwise("")
    expected = F.create_map(F.lit("subject_id"), "supplier_id", F.lit("predicate"), F.lit("supplies"), F.lit("object_id"), "object_id")
    checks = ops.select("op_id", kind.alias("kind"), subject.alias("subject"), expected.alias("expected"))
    return commit.preconditions(checks, g.entities().withColumn("props", F.create_map().cast("map<string,string>")), g.edges()).select("op_id", "kind", "holds")


@query(
    " SELECT 'HP#' || o_orderkey AS subject, 'edge_exists' AS kind, EXISTS (SELECT 1 FROM edges WHERE id = 'HP#' || o_orderkey AND valid_to IS NULL) AS holds FROM orders"
    " UNION ALL SELECT 'C#' || c_custkey, 'prop_equals', c_mktsegment = 'BUILDING' FROM customer UNION ALL SELECT 'R#' || r_regionkey, 'unheard_of', false FROM region", BOTH,
)
def preconditions_of_edges(g):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("subject")
    none = F.create_map().cast("map<string,string>").alias("expected")
    segment = F.create_map(F.lit("prop"), F.lit("description"), F.lit("value"), F.lit("BUILDING")).alias("expected")
    checks = g.table("orders").select(F.lit("edge_exists").alias("kind"), key("HP#", "o_orderkey"), none).unionByName(g.table("customer").select(F.lit("prop_equals").alias("kind"), key("C#", "c_custkey"), segment))
    checks = checks.unionByName(g.table("region").select(F.lit("unheard_of").alias("kind"), key("R#", "r_regionkey"), none))
    return commit.preconditions(checks, g.entities().withColumn("props", F.create_map().cast("map<string,string>")), g.edges()).select("subject", "kind", "holds")


def _with_deps(g):
    deps = F.when(F.col("dep").isNull(), F.array().cast("array<string>")).otherwise(F.array("dep"))
    return g.ops().withColumn("depends_on", deps)


_CLOSED = (
    " , ok AS (SELECT *, sum(CASE WHEN status = 'approved' THEN 0 ELSE 1 END) OVER (PARTITION BY patch_id ORDER BY pos) AS bad FROM staged)"
)


@query(_CLOSED + " SELECT patch_id, op_id FROM ok WHERE bad = 0", OPS_SQL)
def committable_closure(g):
    return commit.closure(_with_deps(g).select("patch_id", "op_id", "depends_on", "status"))


@query(_CLOSED + " SELECT patch_id, op_id FROM ok WHERE status = 'approved' AND bad > 0", OPS_SQL)
def blocked_cascade(g):
    ops = _with_deps(g).select("patch_id", "op_id", "depends_on", "status")
    return ops.filter("status = 'approved'").select("patch_id", "op_id").join(commit.closure(ops), ["patch_id", "op_id"], "left_anti")


@query(
    "SELECT 'SP#' || l_suppkey || '_' || l_partkey AS id, count(*) AS support, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS quotes FROM lineitem GROUP BY 1",
)
def reinforce_quotes(g):
    """Every mention adds to support; a quote is kept once."""
    rows = g.table("lineitem").select(F.concat_ws("_", F.concat(F.lit("SP#"), F.col("l_suppkey").cast("string")), F.col("l_partkey").cast("string")).alias("id"), F.concat("l_returnflag", "l_linestatus").alias("quote"))
    return rows.groupBy("id").agg(F.count("*").alias("support"), F.array_join(F.array_sort(F.collect_set("quote")), ",").alias("quotes"))


def _decisions(g):
    """A decision an order: urgent ones accept, low ones reject, the rest defer the order's first op."""
    rows = g.table("orders").select(
        F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("op"), F.col("o_orderkey").cast("string"), F.lit("-1")).alias("op_id"),
        F.when(F.substring("o_orderpriority", 1, 1) == "1", "accept").when(F.substring("o_orderpriority", 1, 1) == "5", "reject").otherwise("defer").alias("action"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("decided_at"),
    )
    return rows.withColumn("edited", F.lit(None).cast("map<string,string>"))


@query(
    " SELECT s.op_id, CASE WHEN route = 'review' AND status = 'pending' AND o_orderpriority[1] = '1' AND pos = 1 THEN 'approved' WHEN route = 'review' AND status = 'pending' AND o_orderpriority[1] = '5' AND pos = 1 THEN 'rejected' ELSE status END AS status"
    " FROM staged s LEFT JOIN orders ON 'p' || o_orderkey = s.patch_id", OPS_SQL,
)
def apply_review(g):
    return review.apply_decisions(g.ops(), _decisions(g)).select("op_id", "status")


@query(
    " SELECT patch_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at, count(*) AS pending FROM staged JOIN orders ON patch_id = 'p' || o_orderkey WHERE route = 'review' AND status = 'pending' GROUP BY ALL", OPS_SQL,
)
def pending_queue(g):
    patches = g.table("orders").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("patch_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    return review.queue(patches, g.ops())


@query(
    " SELECT op_id, CASE op WHEN 'create_node' THEN t ELSE 'Supplier' END AS grp, CASE op WHEN 'create_node' THEN 'new entity: ' || t || ' (Thing)' WHEN 'assert_edge' THEN '(' || s || ') —supplies→ (' || p || ') · from ' || day ELSE 'close: (' || s || ') —supplies→ (' || p || ')' END AS text,"
    " CASE WHEN semantic THEN 'conflict' ELSE '' END AS flag FROM (SELECT x.*, 'T ' || x.op_id AS t, s_name AS s, p_name AS p FROM staged x JOIN supplier ON 'S#' || s_suppkey = supplier_id JOIN part ON 'P#' || p_partkey = object_id WHERE route = 'review' AND status = 'pending')", OPS_SQL,
)
def review_board(g):
    none = F.lit(None).cast("string")
    edge = F.concat_ws("_", F.replace("supplier_id", F.lit("S#"), F.lit("SP#")), F.replace("object_id", F.lit("P#"), F.lit("")))
    is_edge = F.col("op") != "create_node"
    ops = g.ops().select(
        "patch_id", "op_id", "op", "confidence", "route", "status", F.when(F.col("semantic"), "value conflict").otherwise("").alias("rationale"),
        F.when(~is_edge, F.concat(F.lit("t"), "op_id")).alias("temp_id"), none.alias("canonical_id"), F.lit("Thing").alias("entity_type"), F.lit("supplies").alias("predicate"), F.col("day").alias("valid_from"),
        F.when(F.col("op") == "assert_edge", F.struct(none.alias("temp_id"), F.col("supplier_id").alias("canonical_id"))).alias("subject"), F.when(F.col("op") == "assert_edge", F.struct(none.alias("temp_id"), F.col("object_id").alias("canonical_id"))).alias("object"),
        F.when(F.col("op") == "invalidate_edge", edge).alias("edge_id"), none.alias("match_method"), F.lit(0.0).alias("match_score"), F.create_map(F.lit("name"), F.concat(F.lit("T "), "op_id")).alias("props"),
    )
    out = review.board(ops, g.entities(), graph.named(g.edges(), g.entities()))
    return out.select("op_id", F.when(F.col("kind") == "create_node", F.col("group")).otherwise("Supplier").alias("grp"), "text", "flag")


# Commit.


def _staged_tables(g):
    """The derived graph and a patch an order, approved in full: creates its order as a node, asserts its customer's order, reinforces the customer's place."""
    from claimgraph.schemas import TABLES

    blank = lambda df, name: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in g.spark.createDataFrame([], TABLES[name]).schema])
    empty = F.create_map().cast("map<string,string>")
    o = g.table("orders").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("patch_id"), F.concat(F.lit("C#"), F.col("o_custkey").cast("string")).alias("cust"), F.concat(F.lit("LC#"), F.col("o_custkey").cast("string")).alias("place"), F.col("o_orderkey").cast("string").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), "o_orderpriority")
    op = lambda n: F.concat(F.lit("c"), "k", F.lit(f"-{n}"))
    common = [F.lit(0.95).alias("confidence"), F.lit("").alias("rationale"), F.lit("approve").alias("route"), F.lit("approved").alias("status")]
    pre = lambda kind, subject: F.array(F.struct(F.lit(kind).alias("kind"), subject.alias("subject"), empty.alias("expected")))
    name = F.concat(F.lit("Order "), "k")
    create = o.select("patch_id", op(1).alias("op_id"), F.lit(1).alias("pos"), F.lit("create_node").alias("op"), F.array().alias("depends_on"), pre("name_absent", name).alias("preconditions"), *common, F.lit("t1").alias("temp_id"), F.lit("Event").alias("entity_type"), F.create_map(F.lit("name"), name).alias("props"))
    ref = lambda t, c: F.struct(t.cast("string").alias("temp_id"), c.cast("string").alias("canonical_id"))
    link = o.select("patch_id", op(2).alias("op_id"), F.lit(2).alias("pos"), F.lit("assert_edge").alias("op"), F.array(op(1)).alias("depends_on"), F.array().alias("preconditions"), *common, ref(F.lit(None), F.col("cust")).alias("subject"), ref(F.lit("t1"), F.lit(None)).alias("object"), F.lit("placed").alias("predicate"), F.col("d").alias("valid_from"))
    again = o.select("patch_id", op(3).alias("op_id"), F.lit(3).alias("pos"), F.lit("reinforce_edge").alias("op"), F.array().alias("depends_on"), pre("edge_exists", F.col("place")).alias("preconditions"), *common, F.col("place").alias("edge_id"), F.col("o_orderpriority").alias("quote"))
    tables = {name: g.spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    tables["entities"] = blank(g.entities().withColumn("props", empty), "entities")
    tables["edges"] = blank(g.edges().withColumn("quotes", F.array()).withColumn("props", empty), "edges")
    tables["patch_ops"] = blank(create, "patch_ops").unionByName(blank(link, "patch_ops")).unionByName(blank(again, "patch_ops"))
    tables["patches"] = blank(o.select("patch_id", F.col("k").alias("doc_id"), F.lit("run").alias("run_id"), F.col("d").alias("created_at"), F.lit("pending").alias("status")), "patches")
    return tables


@query(
    "SELECT c_custkey AS cust, count(o_orderkey) AS placed, 1 + count(o_orderkey) AS support, count(DISTINCT o_orderpriority) AS n_quotes, 3 * count(o_orderkey) AS ledgered FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
)
def commit_report(g):
    """What a full commit of all patches leaves for each customer."""
    new, report = commit.commit(_staged_tables(g), "2000-01-01")
    edges = new["edges"]
    placed = edges.filter("predicate = 'placed'").groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("placed"))
    place = edges.filter("predicate = 'located_in' AND subject_id LIKE 'C#%'").select(F.col("subject_id").alias("id"), F.col("support").cast("long").alias("support"), F.size("quotes").cast("long").alias("n_quotes"))
    done = report.filter("status = 'committed'").groupBy("patch_id").agg(F.count("*").alias("n"))
    cust = g.table("orders").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("patch_id"), F.concat(F.lit("C#"), F.col("o_custkey").cast("string")).alias("id"))
    ledgered = cust.join(done, "patch_id").groupBy("id").agg(F.sum("n").alias("ledgered"))
    out = place.join(placed, "id", "left").join(ledgered, "id", "left")
    return out.select(F.expr("cast(substring(id, 3) AS bigint)").alias("cust"), F.coalesce("placed", F.lit(0)).alias("placed"), "support", "n_quotes", F.coalesce("ledgered", F.lit(0)).alias("ledgered"))


@query(
    "SELECT c_custkey AS cust, k AS kind, CASE WHEN k = 'split_node' THEN 'failed' WHEN c_custkey % 2 = 0 OR k IN ('merge_into', 'invalidate_edge') THEN 'committed' WHEN k = 'assert_edge' THEN 'blocked' ELSE 'requeued' END AS status,"
    " CASE WHEN k = 'invalidate_edge' THEN 'LC#' || c_custkey END AS closed FROM customer, (SELECT unnest(['update_node_props', 'merge_into', 'invalidate_edge', 'assert_edge', 'split_node']) AS k)",
)
def commit_kinds(g):
    """A patch a customer: a guarded update that holds for every second one, a merge into its nation, a closed edge, a fact behind the update, and a split, which can't be applied."""
    from claimgraph.schemas import TABLES

    blank = lambda df, name: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in g.spark.createDataFrame([], TABLES[name]).schema])
    empty, none = F.create_map().cast("map<string,string>"), F.lit(None).cast("string")
    c = g.table("customer").withColumn("k", F.col("c_custkey").cast("string")).withColumn("patch_id", F.concat(F.lit("p"), "k"))
    node, nation, op_id = F.concat(F.lit("C#"), "k"), F.concat(F.lit("N#"), F.col("c_nationkey").cast("string")), lambda kind: F.concat_ws("-", "k", F.lit(kind))
    common = [F.lit(1.0).alias("confidence"), F.lit("").alias("rationale"), F.lit("approve").alias("route"), F.lit("approved").alias("status")]
    check = lambda kind, subject, expected=empty: F.array(F.struct(F.lit(kind).alias("kind"), subject.alias("subject"), expected.alias("expected"))).alias("preconditions")
    guard = F.create_map(F.lit("prop"), F.lit("description"), F.lit("value"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("another"))
    base = lambda pos, kind: ["patch_id", op_id(kind).alias("op_id"), F.lit(pos).alias("pos"), F.lit(kind).alias("op"), *common]
    no_deps = F.array().cast("array<string>").alias("depends_on")
    ops = [
        c.select(*base(0, "update_node_props"), node.alias("canonical_id"), F.create_map(F.lit("tier"), F.lit("gold")).alias("props"), check("prop_equals", node, guard), no_deps),
        c.select(*base(1, "merge_into"), F.lit("t").alias("temp_id"), nation.alias("canonical_id"), F.lit(0.95).alias("match_score"), F.lit("embedding").alias("match_method"), check("node_exists", nation), no_deps),
        c.select(*base(2, "invalidate_edge"), F.concat(F.lit("LC#"), "k").alias("edge_id"), F.lit("2000-01-01").alias("valid_to"), F.lit("moved").alias("reason"), check("edge_exists", F.concat(F.lit("LC#"), "k")), no_deps),
        c.select(*base(3, "assert_edge"), F.struct(none.alias("temp_id"), node.alias("canonical_id")).alias("subject"), F.struct(F.lit("t").alias("temp_id"), none.alias("canonical_id")).alias("object"), F.lit("visits").alias("predicate"), F.array(op_id("update_node_props")).alias("depends_on"), F.array().alias("preconditions")),
        c.select(*base(4, "split_node"), node.alias("canonical_id"), F.array().alias("preconditions"), no_deps),
    ]
    tables = {name: g.spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    tables["entities"] = blank(g.entities().withColumn("props", empty), "entities")
    tables["edges"] = blank(g.edges().withColumn("quotes", F.array()).withColumn("props", empty), "edges")
    for one in ops:
        tables["patch_ops"] = tables["patch_ops"].unionByName(blank(one, "patch_ops"))
    tables["patches"] = blank(c.select("patch_id", F.col("k").alias("doc_id"), F.lit("run").alias("run_id"), F.lit("2000").alias("created_at"), F.lit("pending").alias("status")), "patches")
    new, report = commit.commit(tables, "2000-01-01")
    closed = new["edges"].filter("invalidation_reason = 'moved' AND valid_to = '2000-01-01'").select(F.concat(F.lit("p"), F.substring("subject_id", 3, 20)).alias("patch_id"), F.lit("invalidate_edge").alias("kind"), F.col("id").alias("closed"))
    out = report.withColumn("kind", F.element_at(F.split("op_id", "-"), 2)).join(closed, ["patch_id", "kind"], "left")
    return out.select(F.expr("cast(substring(patch_id, 2) AS bigint)").alias("cust"), "kind", "status", "closed")


@query("SELECT count(*) AS n_ops, 3 * count(*) AS n_ledger FROM orders HAVING false")
def idempotent_replay(g):
    """Rows of the graph that a second commit of the same patches changes: none."""
    once, _ = commit.commit(_staged_tables(g), "2000-01-01")
    again = dict(once)
    again["patches"] = once["patches"].withColumn("status", F.lit("pending"))
    twice, _ = commit.commit(again, "2000-01-02")
    flat = lambda t: t["edges"].select("id", "valid_to", "support", F.size("quotes").alias("q"))
    changed = flat(twice).exceptAll(flat(once)).unionByName(flat(once).exceptAll(flat(twice)))
    more = twice["ledger"].select("op_id").exceptAll(once["ledger"].select("op_id"))
    n = changed.select(F.col("id")).unionByName(more.select(F.col("op_id").alias("id")))
    return n.groupBy("id").agg(F.count("*").alias("n_ops"), F.count("*").alias("n_ledger")).drop("id")


# Evaluation and audits.


def _triples(g):
    """Gold: what suppliers supply by name; found: the same from returned items, now and then the wrong way round."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax")
    li = g.table("lineitem").withColumn("n", F.row_number().over(place))
    li = li.join(g.table("part"), F.col("p_partkey") == F.col("l_partkey")).join(g.table("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    rows = li.select(F.col("l_orderkey").alias("doc"), F.col("n").cast("long").alias("pos"), F.col("s_name").alias("subject"), F.col("p_name").alias("object"), "l_returnflag", "l_linestatus")
    gold = rows.select("doc", "pos", "subject", F.lit("suppliesPart").alias("predicate"), "object")
    back = F.col("l_returnflag") == "R"
    found = rows.filter("l_returnflag <> 'A'").select("doc", "pos", F.when(back, F.col("object")).otherwise(F.col("subject")).alias("subject"), F.lit("supplies_part").alias("predicate"), F.when(back, F.col("subject")).otherwise(F.col("object")).alias("object"))
    return gold, found


_MATCHED = (
    "li AS (SELECT l_orderkey AS doc, n AS pos, s_name AS s, p_name AS o, l_returnflag AS f FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) AS n FROM lineitem)"
    " JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey), gold AS (SELECT *, row_number() OVER (PARTITION BY doc, s, o ORDER BY pos) AS k FROM li),"
    " found AS (SELECT doc, s, o, pos AS found_pos, f = 'R' AS reversed, row_number() OVER (PARTITION BY doc, s, o ORDER BY f = 'R', pos) AS k FROM li WHERE f <> 'A'),"
    " met AS (SELECT gold.doc, gold.pos, found_pos, coalesce(reversed, false) AS reversed, CASE WHEN found_pos IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS cosine, found_pos IS NOT NULL AS triple FROM gold LEFT JOIN found USING (doc, s, o, k))"
)


@query(" SELECT doc, pos, coalesce(found_pos, 0) AS found_pos, reversed, cosine, triple FROM met", _MATCHED)
def greedy_match(g):
    """Places begin at 1; 0 stands for none."""
    return evaluate.greedy_match(*_triples(g)).withColumn("found_pos", F.coalesce("found_pos", F.lit(0)))


@query(
    " SELECT level, n_gold, n_found, n_hit, round(n_hit / n_found, 3) AS precision, round(n_hit / n_gold, 3) AS recall, round(2.0 * n_hit / (n_found + n_gold), 3) AS f1"
    " FROM (SELECT unnest(['pair', 'triple']) AS level), (SELECT count(*) AS n_gold, count(found_pos) AS n_hit FROM met), (SELECT count(*) AS n_found FROM found)", _MATCHED,
)
def extraction_prf(g):
    gold, found = _triples(g)
    return evaluate.report(gold, found, evaluate.greedy_match(gold, found))


@query(
    "SELECT round(tp / nf, 3) AS precision, round(tp / ng, 3) AS recall, round(2 * (tp / nf) * (tp / ng) / (tp / nf + tp / ng), 3) AS f1 FROM (SELECT count_if(toxic = 1 AND quality = 0)::DOUBLE AS tp, count_if(quality = 0)::DOUBLE AS nf, count_if(toxic = 1)::DOUBLE AS ng FROM labels)",
)
def review_agreement(g):
    """How well one kind of label foretells the other."""
    n = g.table("labels").agg(F.count_if((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("tp"), F.count_if(F.col("quality") == 0).alias("nf"), F.count_if(F.col("toxic") == 1).alias("ng"))
    return n.select(*evaluate.precision_recall(F.col("ng"), F.col("nf"), F.col("tp")))


@query("SELECT d.doc_id, i.item_id FROM documents d JOIN benchmark i ON contains(d.text, i.text)")
def evidence_faithfulness(g):
    """(document, quote) pairs in which the document holds the quote word for word. Quotes meet documents that share their longest word."""
    def words(c):
        return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\S+)"), 1))

    quotes = g.table("benchmark").select("item_id", F.col("text").alias("quote"))
    inner = F.slice(F.regexp_extract_all("quote", F.lit(r"(\S+)"), 1), F.lit(2), F.greatest(F.size(F.regexp_extract_all("quote", F.lit(r"(\S+)"), 1)) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    quotes = quotes.withColumn("word", longest)
    docs = g.table("documents").select("doc_id", "text")
    pairs = docs.select("doc_id", "text", F.explode(words(F.col("text"))).alias("word")).join(F.broadcast(quotes.filter("word IS NOT NULL")), "word")
    short = docs.join(quotes.filter("word IS NULL"), F.contains("text", "quote")).select("doc_id", "item_id")
    return pairs.filter(F.contains("text", "quote")).select("doc_id", "item_id").unionByName(short)


#: Dollars for a million tokens of each class.
PRICES = {"input": 3.0, "output": 15.0, "cache_read": 0.30, "cache_write": 3.75}


@query(
    "SELECT role, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS tokens, round(sum(length(coalesce(text, ''))) * CASE role WHEN 'assistant' THEN 15.0 WHEN 'system' THEN 3.75 ELSE 3.0 END / 1e6, 6) AS cost FROM conversations GROUP BY role",
)
def llm_cost_rollup(g):
    n = g.table("conversations").groupBy("role").agg(F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("tokens"))
    price = F.when(F.col("role") == "assistant", PRICES["output"]).when(F.col("role") == "system", PRICES["cache_write"]).otherwise(PRICES["input"])
    return n.withColumn("cost", F.round(F.col("tokens") * price / 1e6, 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
