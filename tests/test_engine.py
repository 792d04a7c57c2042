"""From files to answers, and the same by a stream; a second document reinforces, supersedes and contradicts."""

import pytest

from claimgraph.engine import REFUSAL, Engine, Settings
from claimgraph.sources.documents import read_files
from claimgraph.streaming.ingest import watch


@pytest.fixture
def engine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Acme\n\nAcme Corp acquired Beta Labs in March.\n\nBeta Labs employs Carol Jones.")
    return Engine(spark, f"file://{tmp_path}/store"), f"file://{tmp_path}"


def accept_all(e):
    ops = e.store.read("patch_ops").filter("status = 'pending'")
    e.review(ops.selectExpr("concat('d', op_id) id", "patch_id", "op_id", "'r' reviewer_id", "'accept' action", "'' note", "'2026-01-02' decided_at", "cast(null as map<string,string>) edited"))


def test_ingest_review_commit_ask(spark, engine):
    e, root = engine
    assert e.ingest(read_files(spark, f"{root}/in/*"), "2026-01-01").count() == 1
    assert e.ingest(read_files(spark, f"{root}/in/*"), "2026-01-01").count() == 0  # it waits for review
    queue = e.pending().collect()
    assert len(queue) == 1 and queue[0]["pending"] > 0
    ops = e.store.read("patch_ops").orderBy("pos").collect()
    assert [o["pos"] for o in ops] == list(range(5)) and [o["op"] for o in ops] == ["create_node"] * 3 + ["assert_edge"] * 2
    assert [o["props"]["name"] for o in ops[:3]] == ["Acme Corp", "Beta Labs", "Carol Jones"]  # in the order of the text
    accept_all(e)
    assert {r["status"] for r in e.commit("2026-01-03").collect()} == {"committed"}
    assert e.pending().count() == 0 and e.store.read("edges").count() == 2
    doc = e.store.read("documents").first()
    assert doc["source_uri"].endswith("a.md") and doc["doc_id"] == f"doc_{doc['content_hash'][:16]}"
    assert e.ingest(read_files(spark, f"{root}/in/*"), "2026-01-04").count() == 0  # it is known
    asked = spark.createDataFrame([("q", "Acme Corp"), ("none", "???")], "query_id string, query string")
    got = {r["query_id"]: r for r in e.ask(asked).collect()}
    assert "(Acme Corp) —acquired→ (Beta Labs)" in got["q"]["answer"] and got["none"]["answer"] == REFUSAL
    assert e.search(asked).first()["sources"][0].endswith("a.md")
    assert e.store.read("entity_vectors").count() == 3 and e.store.read("fact_vectors").count() == 2
    assert e.reindex()["entity_vectors"].count() == 3 and e.faults().count() == 0
    acme = e.store.read("entities").filter("name = 'Acme Corp'").first()["id"]
    node = e.node(acme)
    assert node["edges"].first()["other"] == "Beta Labs" and node["provenance"].count() == 1 and node["decisions"].first()["action"] == "accept"
    e.reset()
    assert e.store.read("edges").count() == 0


def test_a_second_document_correlates(spark, tmp_path):
    """The story of a place: a base fact, the same from another source, a move with a date, a flat contradiction."""
    e = Engine(spark, f"file://{tmp_path}/store", settings=Settings(many_valued=("employs",)))

    def tell(name, text, day):
        (tmp_path / name).write_text(text)
        assert e.ingest(read_files(spark, f"file://{tmp_path}/{name}"), day).count() == 1
        patch = e.store.read("patches").orderBy("created_at").collect()[-1]["patch_id"]
        return {(o["op"], o["reason"]): o for o in e.store.read("patch_ops").filter(f"patch_id = '{patch}'").collect()}, patch

    def land(day):
        accept_all(e)
        assert {r["status"] for r in e.commit(day).collect()} == {"committed"}

    tell("a.md", "Acme Corp based in Bern City from 2019.\n\nAcme Corp employs Carol Jones.", "2026-01-01")
    land("2026-01-02")
    ops, _ = tell("b.md", "Yes, Acme Corp based in Bern City from 2019.", "2026-01-03")
    assert set(ops) == {("reinforce_edge", None)} and ops["reinforce_edge", None]["quote"] == "Acme Corp based in Bern City from 2019"
    land("2026-01-04")
    edge = e.store.read("edges").filter("predicate = 'based in'").first()
    assert edge["support"] == 2 and edge["valid_from"] == "2019" and len(edge["quotes"]) == 1
    ops, _ = tell("c.md", "Acme Corp based in Bonn Town from 2026-03.\n\nAcme Corp employs Dave Smith.", "2026-03-05")
    assert ops["invalidate_edge", "superseded"]["edge_id"] == edge["id"] and ops["invalidate_edge", "superseded"]["valid_to"] == "2026-03"
    assert sum(k[0] == "invalidate_edge" for k in ops) == 1  # many are employed
    land("2026-03-06")
    asked = spark.createDataFrame([("q", "Acme Corp based")], "query_id string, query string")
    held = lambda as_of: {r["object"] for r in e.search(asked, as_of).collect() if r["predicate"] == "based in"}
    assert held(None) == {"Bonn Town"} and held("2024-06-01") == {"Bern City"}
    ops, _ = tell("d.md", "Acme Corp based in Rome Place.", "2026-04-01")
    told, closed = ops["assert_edge", None], ops["invalidate_edge", "contradicted"]
    assert told["route"] == closed["route"] == "review" and told["rationale"].startswith("CONFLICTS with (Acme Corp)") and closed["valid_to"] == "2026-04-01"


def test_known_entities_gain_in_one_update(spark, tmp_path):
    """Two mentions of a known node, one by its name and one merged, become one guarded update behind the merge."""
    e = Engine(spark, f"file://{tmp_path}/store")
    t = e.store.tables()
    ent = spark.createDataFrame([("can_1", "United States", "Place", "A country.", 1.0, {"code": "US"})], t["entities"].schema)
    e.store.publish({"entities": ent})
    empty = "array<struct<unit_id:string,quote:string>>"
    rows = [("b", 0, "t1", "United States", "Place", 0.9, {"description": "In America", "code": "XX", "size": "big"}), ("b", 1, "t2", "The US", "Place", 0.8, {"description": "Has fifty states", "age": "250"})]
    resolved = spark.createDataFrame([(*r, "p", "can_1", 1.0 if r[1] == 0 else 0.93, "rules" if r[1] == 0 else "embedding", False) for r in rows], "batch string, pos int, temp_id string, name string, entity_type string, confidence double, props map<string,string>, patch_id string, canonical_id string, score double, method string, new_type boolean")
    resolved = resolved.selectExpr("*", f"cast(array() as {empty}) evidence")
    from claimgraph.operators import propose

    nodes = propose.node_ops(resolved, ent)
    merge = nodes.collect()
    assert [m["op"] for m in merge] == ["merge_into"] and merge[0]["rationale"] == "'The US' resolved to existing 'United States' (embedding, 0.93)"
    got = propose.update_ops(resolved, nodes, ent).collect()
    assert len(got) == 1 and got[0]["props"] == {"size": "big", "age": "250", "description": "A country. In America. Has fifty states"}
    assert got[0]["depends_on"] == [merge[0]["op_id"]]
    assert [(p["kind"], p["expected"]) for p in got[0]["preconditions"]] == [("node_exists", {}), ("prop_equals", {"prop": "description", "value": "A country."})]


def test_types_are_proposed_and_approved(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    e.propose_type("Robot", "Artifact", "A machine")
    e.propose_type("Robot", "Artifact", "Another text")
    with pytest.raises(ValueError):
        e.propose_type("X", "Nothing", "")
    e.approve_type("Robot")
    e.approve_type("Drone")
    assert {(r["type_name"], r["description"], r["status"]) for r in e.store.read("schema_types").collect()} == {("Robot", "A machine", "approved"), ("Drone", "", "approved")}


def test_settings_and_report(spark, tmp_path):
    assert Settings.from_env({"CLAIMGRAPH_ROUTE_AUTO_APPROVE": "0.5", "CLAIMGRAPH_MANY_VALUED": "a, b"}) == Settings(route_auto_approve=0.5, many_valued=("a", "b"))
    e = Engine(spark, f"file://{tmp_path}/store")
    triples = spark.createDataFrame([("d", 0, "A", "likes", "B")], "doc string, pos long, subject string, predicate string, object string")
    e.evaluated(triples, triples, f"file://{tmp_path}/reports", "rules", "prompt", "2026-01-01T00:00:00")
    back = spark.read.json(f"file://{tmp_path}/reports/extraction_20260101T000000").collect()
    assert {r["level"]: r["f1"] for r in back} == {"pair": 1.0, "triple": 1.0} and back[0]["model"] == "rules" and len(back[0]["prompt_sha"]) == 12


def test_stream_ingests_files_once(spark, engine, tmp_path):
    e, root = engine
    for _ in range(2):
        query = watch(e, f"{root}/in", f"{root}/checkpoint", "2026-01-01")
        query.awaitTermination(120)
        assert query.exception() is None
    assert e.store.read("patches").count() == 1
