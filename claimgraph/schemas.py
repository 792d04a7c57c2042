"""Table schemas of the graph, its staging area and its ledger."""

ENTITIES = "id string, name string, entity_type string, description string, confidence double, props map<string,string>"
EDGES = (
    "id string, subject_id string, object_id string, predicate string, valid_from string, valid_to string, support int, "
    "confidence double, quotes array<string>, invalidation_reason string, props map<string,string>"
)
ALIASES = "id string, canonical_id string, match_score double, match_method string"
LEDGER = "op_id string, patch_id string, doc_id string, run_id string, at string, node_id string, edge_id string"
DOCUMENTS = "content_hash string, doc_id string, source_uri string"
PATCHES = "patch_id string, doc_id string, run_id string, created_at string, status string, content_hash string, source_uri string"
NODE_REF = "struct<temp_id:string,canonical_id:string>"
PRECONDITION = "struct<kind:string,subject:string,expected:map<string,string>>"
OPS = (
    "patch_id string, op_id string, pos int, op string, depends_on array<string>, preconditions array<" + PRECONDITION + ">, "
    "confidence double, rationale string, route string, status string, temp_id string, canonical_id string, entity_type string, "
    "subject " + NODE_REF + ", object " + NODE_REF + ", predicate string, edge_id string, valid_from string, valid_to string, "
    "reason string, quote string, match_score double, match_method string, props map<string,string>"
)
DECISIONS = "id string, patch_id string, op_id string, reviewer_id string, action string, note string, decided_at string, edited map<string,string>"
VECTORS = "key string, text string, vector array<float>"
SCHEMA_TYPES = "type_name string, parent string, description string, status string"

#: The upper ontology that an empty graph starts from.
SEED_TYPES = ["Entity", "Agent", "Event", "Artifact", "Concept", "Place"]
TABLES = {
    "entities": ENTITIES, "edges": EDGES, "aliases": ALIASES, "ledger": LEDGER, "documents": DOCUMENTS, "patches": PATCHES,
    "patch_ops": OPS, "decisions": DECISIONS, "schema_types": SCHEMA_TYPES,
    "entity_vectors": VECTORS, "predicate_vectors": VECTORS, "fact_vectors": VECTORS,
}
