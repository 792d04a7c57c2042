"""Facts in time, neighbourhoods, scores, closures, headings: small literal graphs."""

import pytest
from pyspark.sql import functions as F

from claimgraph.engine import doors
from claimgraph.functions import text as T
from claimgraph.operators import candidates, commit, correlate, evaluate, fusion, graph, resolve, scoring, temporal, vectors
from claimgraph.sources import documents as D


@pytest.fixture(scope="module")
def mini(spark):
    ents = spark.createDataFrame([(i, i.title(), "Place", None) for i in ("org", "old", "new", "founder", "country")], "id string, name string, entity_type string, description string")
    edges = spark.createDataFrame(
        [
            ("e1", "org", "old", "hq", "2019", "2026-03"),
            ("e2", "org", "new", "hq", "2026-03", None),
            ("e3", "org", "founder", "founded_by", None, None),
            ("e4", "new", "country", "located_in", None, None),
        ],
        "id string, subject_id string, object_id string, predicate string, valid_from string, valid_to string",
    )
    return ents, edges


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


@pytest.mark.parametrize("as_of,want", [(None, {"e2", "e3"}), ("2024-06-01", {"e1", "e3"}), ("2026-07-01", {"e2", "e3"}), ("2018-01-01", {"e3"})])
def test_views_in_time(spark, mini, as_of, want):
    ents, edges = mini
    anchor = spark.createDataFrame([("org",)], "id string")
    assert ids(graph.neighborhood(edges, ents, anchor, 1, as_of)) == want


def test_hops_and_limit(spark, mini):
    ents, edges = mini
    anchor = spark.createDataFrame([("org",)], "id string")
    assert "e4" not in ids(graph.neighborhood(edges, ents, anchor, 1)) and "e4" in ids(graph.neighborhood(edges, ents, anchor, 2))
    assert graph.neighborhood(edges, ents, anchor, 2, limit=1).count() == 1
    nodes, met = graph.subgraph(edges, anchor, 2)
    assert ids(nodes) == {"org", "old", "new", "founder", "country"} and met.count() == 4


def test_degree_counts_closed_edges_and_loops(spark, mini):
    _, edges = mini
    loop = edges.unionByName(spark.createDataFrame([("e5", "old", "old", "self", None, None)], edges.schema))
    assert {r["id"]: r["degree"] for r in graph.degree(loop).collect()} == {"org": 3, "old": 3, "new": 2, "founder": 1, "country": 1}


def test_prefix_dates_compare_as_strings(spark):
    edges = spark.createDataFrame([("a", "2026-03-15", None), ("b", "2026-03", None)], "id string, valid_from string, valid_to string")
    assert ids(temporal.facts(edges, "2026-03")) == {"b"}


def test_routing_bounds(spark):
    """With one or two spans of evidence nothing approves itself; a new entity never does."""
    rows = spark.createDataFrame([(s, r) for s in (1, 2, 3) for r in (0.5, 1.0)], "s int, r double")
    got = rows.select(scoring.score(F.lit(1.0), F.col("s"), F.col("r"), F.lit(True)).alias("c")).collect()
    assert [r["c"] for r in got] == [0.7083, 0.8333, 0.7917, 0.9167, 0.875, 1.0]
    route = scoring.route(F.col("k"), F.col("c"), F.col("t"), F.col("m"), F.col("d"))
    cases = [("create_node", 0.99, True, False, 0, "review"), ("create_node", 0.99, False, True, 0, "review"), ("split_node", 0.99, False, False, 0, "review"), ("merge_into", 0.99, False, False, 50, "review"), ("merge_into", 0.99, False, False, 49, "approve"), ("assert_edge", 0.29, False, False, 0, "reject"), ("assert_edge", 0.3, False, False, 0, "review")]
    df = spark.createDataFrame([c[:5] for c in cases], "k string, c double, t boolean, m boolean, d int")
    assert [r[0] for r in df.select(route).collect()] == [c[5] for c in cases]


@pytest.mark.parametrize("dep,want", [("approved", {"n1", "e1"}), ("rejected", set()), ("committed", {"e1"}), (None, set())])
def test_closure(spark, dep, want):
    rows = [("p", "e1", ["n1"], "approved")] + ([("p", "n1", [], dep)] if dep else [])
    ops = spark.createDataFrame(rows, "patch_id string, op_id string, depends_on array<string>, status string")
    assert {r["op_id"] for r in commit.closure(ops).collect()} == want


def test_closure_follows_long_chains(spark):
    rows = [("p", f"o{i}", [f"o{i - 1}"] if i else [], "approved" if i else "rejected") for i in range(1000)] + [("q", f"o{i}", [f"o{i - 1}"] if i else [], "approved") for i in range(1000)]
    rows += [("r", "a", ["b"], "approved"), ("r", "b", ["a"], "approved"), ("r", "c", None, "approved")]
    ops = spark.createDataFrame(rows, "patch_id string, op_id string, depends_on array<string>, status string")
    got = commit.closure(ops).collect()
    assert len(got) == 1001 and {r["patch_id"] for r in got} == {"q", "r"} and [r["op_id"] for r in got if r["patch_id"] == "r"] == ["c"]


def test_correlation_counts_both_sides(spark):
    """Against a plain loop over all pairs."""
    import random

    rng = random.Random(3)
    day = lambda: rng.choice([None, "2019", "2020-05", "2021-07-01"])
    held = [(f"e{i}", f"s{rng.randrange(5)}", f"o{rng.randrange(5)}", rng.choice("pq"), day(), rng.choice([None, "2022"])) for i in range(60)]
    new = [(f"f{i}", f"s{rng.randrange(7)}", rng.choice("pq"), f"o{rng.randrange(7)}", day()) for i in range(60)] + [("n", None, "p", "o1", "2030"), ("m", None, "p", None, None)]
    edges = spark.createDataFrame(held, "id string, subject_id string, object_id string, predicate string, valid_from string, valid_to string")
    facts = spark.createDataFrame(new, "fact_id string, subject_id string, predicate string, object_id string, valid_from string")
    want = {}
    for f, s_, p, o, d in new:
        same = sorted(e[0] for e in held if e[5] is None and e[1:4] == (s_, o, p))
        met = [e for e in held if e[5] is None and e[3] == p and ((e[1] == s_ and e[2] != o) or (e[2] == o and e[1] != s_))]
        worst = max([1 if p == "q" else 2 if d is not None and (e[4] is None or d > e[4]) else 3 for e in met], default=0)
        want[f] = (same[0], 0, "reinforces") if same else (None, len(met), ["new", "extends", "contradicts_temporal", "contradicts_semantic"][worst])
    got = {r["fact_id"]: (r["edge_id"], r["n_collisions"], r["correlation"]) for r in correlate.correlate(facts, edges, ["q"]).collect()}
    assert got == want
    pairs = correlate.collisions(facts.join(correlate.exact(facts, edges), "fact_id", "left_anti"), edges)
    judged = pairs.withColumn("outcome", correlate.by_rule(F.col("np"), F.col("old_from"), F.col("new_from"), ["q"]))
    worst = {r["fact_id"]: (None, r["n_collisions"], r["correlation"]) for r in correlate.judged_worst(judged).collect()}
    assert worst == {k: v for k, v in want.items() if v[1]}


def test_strip_takes_all_white_space(spark):
    text = "# A\n\n\n## B\n\n\tx\u00a0\n\n \u2003 \n\ny"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    got = [(r["block_id"], r["text"], list(r["headings"])) for r in D.markdown(docs).orderBy("pos").collect()]
    assert got == [("d_b0", "# A", ["A"]), ("d_b1", "## B", ["A", "B"]), ("d_b2", "x", ["A", "B"]), ("d_b4", "y", ["A", "B"])]
    assert [b[1] for b in got] == [p.strip() for p in text.split("\n\n") if p.strip()]


def test_normal_predicates(spark):
    said = spark.createDataFrame([("works for",), ("eats",)], "predicate string")
    hits = spark.createDataFrame([("works for", 1, "worksFor", 0.9), ("eats", 1, "worksFor", 0.5)], "query_id string, rank int, key string, score double")
    assert {tuple(r) for r in resolve.normal_predicates(said, hits).collect()} == {("works for", "worksFor"), ("eats", "eats")}
    index = vectors.vector_table(spark.createDataFrame([("works at",), ("likes",)], "p string"), "p", F.col("p"))
    asked = vectors.vector_table(spark.createDataFrame([("works  at",), ("zzz",)], "p string"), "p", F.col("p")).withColumnRenamed("key", "query_id")
    best = {r["query_id"]: (r["key"], r["score"]) for r in vectors.top_k(asked, index, 1).collect()}
    assert best["works  at"][0] == "works at" and best["works  at"][1] > 0.7 and best["zzz"][1] < 0.2
    assert vectors.top_k(asked.limit(0), index, 1).count() == 0


def test_stored_vectors_are_brought_up_to_date(spark):
    rows = spark.createDataFrame([("a", "one"), ("b", "two")], "id string, t string")
    first = vectors.text_vectors(rows, "id", F.col("t"))
    marked = first.withColumn("vector", F.array(F.lit(9.0).cast("float")))  # so that a new embedding shows
    then = vectors.upserted(marked, spark.createDataFrame([("a", "one"), ("b", "TWO!"), ("c", "three")], "id string, t string"), "id", F.col("t"))
    assert {r["key"]: (r["text"], len(r["vector"])) for r in then.collect()} == {"a": ("one", 1), "b": ("TWO!", vectors.DIM), "c": ("three", vectors.DIM)}


def test_four_doors_fuse_meaning_and_words(spark):
    ents = spark.createDataFrame([("n1", "Acme Corp", "Agent", "makes grippers"), ("n2", "Bern", "Place", None), ("n3", "Zed", "Agent", None)], "id string, name string, entity_type string, description string")
    facts = spark.createDataFrame([("e1", "n1", "n2", "based in", None, None, ["Acme moved to Bern"], "Acme Corp", "Bern")], "id string, subject_id string, object_id string, predicate string, valid_from string, valid_to string, quotes array<string>, subject string, object string")
    asked = spark.createDataFrame([("q", "Acme Corp"), ("w", "moved")], "query_id string, query string")
    got = {(r["query_id"], r["list"]): r["ids"] for r in doors(asked, ents, facts).groupBy("query_id", "list").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("s")).select("query_id", "list", F.col("s.id").alias("ids")).collect()}
    assert got["q", 0] == ["n1"] and got["q", 2] == ["n1"] and got["w", 3] == ["n1", "n2"] and ("w", 2) not in got


def test_heading_stack(spark):
    text = "# A\n\nx\n\n### C\n\ny\n\n\n\n## B\n\nz"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    got = {r["text"]: list(r["headings"]) for r in D.markdown(docs).collect()}
    assert got == {"# A": ["A"], "x": ["A"], "### C": ["A", "C"], "y": ["A", "C"], "## B": ["A", "B"], "z": ["A", "B"]}
    assert [r["text"] for r in D.units(D.markdown(docs)).orderBy("pos").collect()] == ["x", "y", "z"]


def test_bpmn_becomes_candidates(spark):
    # An end that is no flow node goes by its id.
    xml = '<d xmlns="http://www.omg.org/spec/BPMN/20100524/MODEL"><task id="a" name="Pack"/><endEvent id="b"/><sequenceFlow sourceRef="a" targetRef="b" name="ok"/><sequenceFlow sourceRef="b" targetRef="gone"/></d>'
    docs = spark.createDataFrame([("d", xml), ("bad", "<x")], "doc_id string, text string")
    ents, rels = candidates.from_triples(D.bpmn_triples(docs))
    assert {(r["name"], r["entity_type"]) for r in ents.collect()} == {("Pack", "task"), ("b", "endEvent"), ("gone", "Concept")}
    assert [(r["predicate"], r["props"]) for r in rels.orderBy("pos").collect()] == [("FLOWS_TO", {"condition": "ok"}), ("FLOWS_TO", {})]
    assert D.units(D.bpmn(docs)).count() == 0  # structured blocks aren't read again


def test_unnamed(spark):
    names = ["She", "the city", "The City", "acme", "a", " it "]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(T.is_unnamed(F.col("n"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, True]


def test_merged_description(spark):
    rows = [("Old text.", "old text", None), ("old", "An old one", "An old one"), ("One.", "Two", "One. Two"), ("x", " ", None)]
    got = spark.createDataFrame(rows, "o string, n string, w string").select(T.merged_description(F.col("o"), F.col("n")), "w").collect()
    assert all(r[0] == r[1] for r in got)


def test_first_values_win(spark):
    rows = [("b", 2, "t2", "ACME ", "Agent", 0.9, {"k": "second", "m": "x"}, ["q2"]), ("b", 1, "t1", "Acme", "Place", 0.5, {"k": "first"}, ["q1"])]
    got = candidates.merge_entities(spark.createDataFrame(rows, "batch string, pos int, temp_id string, name string, entity_type string, confidence double, props map<string,string>, evidence array<string>")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["temp_id"], r["name"], r["entity_type"], r["props"], r["evidence"]) == ("t1", "Acme", "Agent", {"k": "first", "m": "x"}, ["q1", "q2"])


def test_rrf_counts_first_places_and_keeps_order_of_ties(spark):
    rows = [("q", 0, 1, "a"), ("q", 0, 2, "a"), ("q", 0, 3, "b"), ("q", 1, 1, "b"), ("q", 1, 2, "a"), ("q", 2, 1, "c")]
    got = fusion.rrf(spark.createDataFrame(rows, "query_id string, list int, pos int, id string")).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["a", "b", "c"] and got[0]["score"] == got[1]["score"]


def test_greedy_match_takes_rows_once(spark):
    schema = "doc string, pos long, subject string, predicate string, object string"
    gold = spark.createDataFrame([("d", 0, "The Band (group)", "bornIn", "X"), ("d", 1, "band", "born_in", "x"), ("d", 2, "p", "likes", "q")], schema)
    found = spark.createDataFrame([("d", 0, "Band", "born in", "X"), ("d", 1, "q", "likes", "p")], schema)
    got = evaluate.greedy_match(gold, found).orderBy("pos").collect()
    assert [(r["found_pos"], r["reversed"], r["triple"]) for r in got] == [(0, False, True), (None, False, False), (1, True, True)]
    rows = {r["level"]: r for r in evaluate.report(gold, found, evaluate.greedy_match(gold, found)).collect()}
    assert rows["pair"]["precision"] == 1.0 and rows["pair"]["recall"] == 0.667


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_walk_deals_no_edges_before_it_knows_whom_they_meet(spark):
    """A loop and a repeated edge change nothing."""
    from claimgraph.operators import graph

    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "b", "c"), ("e3", "a", "a"), ("e4", "c", "d"), ("e1", "a", "b")], "id string, subject_id string, object_id string")
    assert "Exchange" not in _plan(graph.steps(edges))
    met, seen = graph.walk(edges, spark.createDataFrame([("a",)], "id string"), 2)
    assert {tuple(r) for r in met.collect()} == {("e1", 1), ("e3", 1), ("e2", 2)} and met.count() == 3
    assert {tuple(r) for r in seen.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_scores_are_added_where_a_documents_postings_are(spark):
    import re

    from claimgraph.operators import lexical

    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None)] + [(i, f"c d {i} " + "b " * (i % 50)) for i in range(4, 3000)], "id int, t string")
    few = docs.filter("id < 4")
    assert not re.search(r"hashpartitioning\(query_id#\d+, key#\d+", _plan(lexical.search(docs, "id", "t", spark.createDataFrame([(7, "b")], "query_id int, query string"))))
    out = lexical.search(few, "id", "t", spark.createDataFrame([(7, "b"), (8, "a, c a")], "query_id int, query string"))
    assert [(r.query_id, r["rank"], r.key) for r in out.orderBy("query_id", "rank").collect()] == [(7, 1, 1), (7, 2, 2), (8, 1, 2), (8, 2, 1)]


def test_a_board_deals_ops_that_name_nothing_evenly(spark):
    from pyspark.sql import functions as F

    from claimgraph.operators import review
    from claimgraph.schemas import OPS

    schema = spark.createDataFrame([], OPS).schema
    row = lambda i: {"patch_id": f"p{i}", "op_id": f"o{i}", "op": "create_node", "confidence": 0.5, "rationale": "", "route": "review", "status": "pending", "temp_id": f"t{i}", "entity_type": "Agent", "props": {"name": f"N{i}"}}
    ops = spark.createDataFrame([tuple(row(i).get(f.name) for f in schema) for i in range(400)], schema)
    entities = spark.createDataFrame([("a", "A")], "id string, name string")
    edges = spark.createDataFrame([("e", "p", "s", "o")], "id string, predicate string, subject string, object string")
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = review.board(ops, entities, edges)
        got = out.groupBy(F.spark_partition_id()).count().collect()
        assert out.filter("text = 'new entity: N7 (Agent)'").count() == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) > 1 and sum(r["count"] for r in got) == 400
