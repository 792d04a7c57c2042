"""Nearest neighbours against brute force; the pipeline against plain versions of its stages; the queries against SQL."""

import os
import re

import numpy as np
import pytest

import corpus_pipeline
from claimgraph.llm import components, near_duplicates, neighbours, registry
from claimgraph.llm.common import Stage

SF = "/root/testdata/sf0.001"


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 5), (20, 21), (None, 1)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1} | {k: 4 for k in range(4, 10)} | {20: 20, 21: 20}


def test_components_of_stars_take_no_round_and_of_a_path_few(spark, monkeypatch):
    made = []
    monkeypatch.setattr(components, "Stage", lambda df, name: made.append(name) or Stage(df, name))
    table = lambda links: spark.createDataFrame(links, "a long, b long")
    got = components.components(table([(1, 5), (7, 1), (1, 9), (1, 9), (3, 4), (2, 2)])).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (3, 3), (4, 3), (5, 1), (7, 1), (9, 1)] and len(made) == 1
    assert components.components(table([])).count() == 0 and len(made) == 2
    path = components.components(table([(i, i + 1) for i in range(64)])).collect()
    assert sorted(map(tuple, path)) == [(i, 0) for i in range(65)] and len(made) < 12


def test_components_joined_by_later_links(spark):
    table = lambda rows, names: spark.createDataFrame(rows, names)
    comps = table([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)], "node long, comp long")
    links = [(4, 2), (9, 10), (10, 6), (1, 2), (20, 21)]
    got = {r["node"]: r["comp"] for r in near_duplicates._joined(comps, table(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 9: 5, 10: 5, 20: 20, 21: 20}
    assert near_duplicates._joined(comps, table([], "a long, b long")).count() == 6


def test_neighbours_find_what_brute_force_finds(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 24)).astype(np.float32)
    x[300:340] = x[5]  # one vector many times
    rows = [(i, [float(v) for v in e], "x") for i, e in enumerate(x)]
    rows += [(1000, None, "x"), (1100, [0.0] * 24, "x"), (1200, [float("nan")] * 24, "x"), (1300, [1.0, None] + [0.0] * 22, "x"), (1400, [1.0], "x"), (None, [1.0] * 24, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    asked = table.filter("vec_id % 100 = 0 OR vec_id IN (5, 301)").selectExpr("vec_id AS row")
    got: dict = {}
    for r in neighbours.nearest(table, asked).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = [i for i in range(700) if i % 100 == 0] + [5, 301]
    assert set(got) == set(ids)
    hits = 0
    y = x.astype(np.float64)
    for q in ids:
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        want = [(float(d[i]), i) for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        mine = sorted(got[q])
        assert [r[0] for r in mine] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-12 for _, v, s in mine)
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {v for _, v in want})
    assert hits / (10 * len(ids)) >= 0.97
    assert [v for _, v, _ in sorted(got[301])] == [5, 300, *range(302, 310)]  # equal vectors by id


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0])], schema)
    ask = lambda t: [tuple(r)[:3] for r in neighbours.nearest(t, t.selectExpr("vec_id AS row")).collect()]
    assert sorted(ask(two)) == [(0, 1, 100), (100, 1, 0)]
    assert ask(spark.createDataFrame([(0, [1.0, 0.0])], schema)) == [] == ask(spark.createDataFrame([], schema))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_recall_on_the_given_vectors(spark):
    got: dict = {}
    for r in neighbours.op3_neighbours(spark, SF).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    pdf = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.array(pdf["embedding"].tolist(), np.float64), pdf["vec_id"].to_numpy()
    hits = n = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        hits += len(set([i for i in ids[np.lexsort((ids, d))] if i != q][:10]) & got[q])
        n += 10
    assert hits / n >= 0.9


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_pipeline_stages(spark):
    from claimgraph.llm import near_duplicates
    from claimgraph.llm.common import Stage

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        was = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        docs = Stage(stage(spark, docs, SF), name).df
        now = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        assert docs.columns == columns and set(now) <= set(was) and len(now) == docs.count()
        if name == "language_id":
            assert set(was) - set(now) == {i for i, t in was.items() if not any(c.isalpha() for c in t or "")}
        if name == "near_dedup":  # one of each class, by all pairs
            split = {i: near_duplicates.shingles(near_duplicates.words_of(t), near_duplicates.Rolling()) for i, t in was.items()}
            group = {i: i for i in was}
            for i in was:
                for j in was:
                    need = near_duplicates.needed(len(split[i]), len(split[j]))
                    if j < i and len(split[i]) and len(split[j]) and near_duplicates.aligned(split[i], split[j], need) >= need:
                        low, high = sorted((group[i], group[j]))
                        group = {k: low if g == high else g for k, g in group.items()}
            assert set(now) == set(group.values())
        if name == "substring_dedup":  # a plain loop over all windows
            first: dict = {}
            for i, t in was.items():
                w = (t or "").encode().split()
                for k in range(len(w) - 19):
                    at = tuple(w[k : k + 20])
                    first[at] = min(first.get(at, (i, k)), (i, k))
            for i, t in was.items():
                w, gone = (t or "").encode().split(), set()
                for k in range(len(w) - 19):
                    if first[tuple(w[k : k + 20])] < (i, k):
                        gone |= set(range(k, k + 20))
                assert now[i] == (b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else t)
            assert all(r["n_chars"] == len(r["text"] or "") for r in docs.collect())
        if name == "decontamination":  # sets of word tuples
            split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            marks = set()
            for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
                w = split(r["text"])
                marks |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
            sizes = {len(m) for m in marks}
            held = lambda w: any(tuple(w[k : k + n]) in marks for n in sizes for k in range(len(w) - n + 1))
            assert set(was) - set(now) == {i for i, t in was.items() if held(split(t))}
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out["doc_id"]) == set(now) and out.groupby("sequence_id").length.sum().max() <= 1024 and len(now) < before


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in "documents benchmark conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), c.sql(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    rows = lambda pdf: sorted(map(str, pdf[columns].itertuples(index=False, name=None)))
    assert sorted(got.columns) == columns and rows(got) == rows(want)


def _true_share(spark, x, asked, batch=None):
    """The share of the ten nearest by brute force that the operator finds for the rows ``asked``."""
    table = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        if batch:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        found = neighbours.nearest(table, spark.createDataFrame([(i,) for i in asked], "row long")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got: dict = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    y, hits = x.astype(np.float64), 0
    for q in asked:
        d = ((y - y[q]) ** 2).sum(1)
        near = [int(i) for i in np.lexsort((np.arange(len(y)), d)) if i != q][:10]
        hits += len(set(near) & got.get(q, set()))
    return hits / (10 * len(asked))


def test_a_vector_alone_in_its_cells_has_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = (np.r_[[10.0], np.zeros(15)] + 0.01 * rng.standard_normal((1200, 16))).astype(np.float32)
    x[[100, 200]] = np.array([[-9.0] + [3.0] * 15, [-9.0] + [-3.0] * 15], np.float32)  # far off the narrow cone
    monkeypatch.setattr(neighbours.build, "__defaults__", (*neighbours.build.__defaults__[:4], 8, neighbours.build.__defaults__[5]))
    assert _true_share(spark, x, [100, 200]) >= 0.9


def _graph_share(spark, x, batch):
    """The share of the ten nearest by brute force that lead the lists of the neighbour graph."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        vectors = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "id long, e array<float>")
        lists: dict = {}
        for r in neighbours.build(vectors).collect():
            lists.setdefault(r["id"], []).append((r["d"], r["nb"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    y, hits, asked = x.astype(np.float64), 0, range(0, len(x), 40)
    for q in asked:
        d = ((y - y[q]) ** 2).sum(1)
        near = [int(i) for i in np.lexsort((np.arange(len(y)), d)) if i != q][:10]
        hits += len(set(near) & {nb for _, nb in sorted(lists.get(q, []))[:10]})
    return hits / (10 * len(asked))


@pytest.mark.parametrize("kind", ["outlier", "offset", "tiny"])
def test_the_graph_keeps_the_vectors_scale(spark, kind):
    x = np.random.default_rng(6).standard_normal((1200, 16)).astype(np.float32)
    if kind == "outlier":
        x[7] = 1e7
    x = {"offset": 500 + 0.1 * x, "tiny": x * np.float32(1e-25)}.get(kind, x).astype(np.float32)
    assert _graph_share(spark, x, 100) >= 0.95


def test_doubles_stay_doubles(spark):
    """Vectors that float32 can't tell apart."""
    x = 1e6 + np.random.default_rng(8).standard_normal((600, 8)) * 1e-3
    table = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    asked = [0, 100, 200, 300]
    got: dict = {}
    for r in neighbours.nearest(table, spark.createDataFrame([(i,) for i in asked], "row long")).collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        assert len({v for _, v in got[q]} & set(want)) >= 9 and all(s == d[v] for s, v in got[q])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_stages_on_odd_tables(spark):
    """Empty tables, nulls in every column, repeated rows, and columns named like the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, id string, t string"
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "en"), (2, text, "en"), (2, text, "en"), (None, text, "en"), (None, None, None), (3, "", "en"), (5, text + " more", None)]
    for docs, left in ((spark.createDataFrame([], schema), 0), (spark.createDataFrame([(i, t, lang, None, None, None, "x", "x", "x") for i, t, lang in rows], schema), 2)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        kept = docs.collect()
        assert len(kept) == left and {r["doc_id"] for r in kept} == ({1, None} if left else set())
        assert corpus_pipeline.packing(spark, docs, SF).count() == left


def test_graph_and_search_keep_a_row_a_node_and_a_row_a_query(spark, monkeypatch):
    """What the rounds write, shuffle and sort doesn't hold a row for each neighbour or each pair ever measured."""
    rows: dict = {}

    class Counted(neighbours.Stage):
        def __init__(self, df, name):
            super().__init__(df, name)
            rows.setdefault(name, []).append(self.df.count())

    monkeypatch.setattr(neighbours, "Stage", Counted)
    x, asked = np.random.default_rng(12).standard_normal((900, 16)).astype(np.float32), list(range(0, 900, 100))
    assert _true_share(spark, x, asked) >= 0.97
    assert rows["graph"] and set(rows["graph"]) == {900} and rows["beam"] and set(rows["beam"]) == {len(asked)}


def test_lists_merge_the_same_however_batches_cut_them(spark):
    """Offers of one id that span many batches: the nearest distinct ones, old ones not fresh."""
    rng, rows, want = np.random.default_rng(13), [], {}
    for i in (1, 2, 9):
        for _ in range(60):
            nb = rng.integers(0, 40, 5).tolist()
            rows.append((i, nb, [float((7 * k + i) % 40) for k in nb], bool(rng.integers(0, 2))))
            for k in nb:
                old = want.setdefault(i, {}).get(k, True)
                want[i][k] = old and rows[-1][3]
    lists = spark.createDataFrame(rows, "id long, nb array<long>, d array<double>, fresh boolean")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (1, 7, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            got = {r["id"]: r for r in neighbours._nearest(lists, 8).collect()}
            assert set(got) == set(want)
            for i, r in got.items():
                near = sorted(((7 * k + i) % 40, k) for k in want[i])[:8]
                assert r["nb"] == [k for _, k in near] and r["d"] == [float(d) for d, _ in near] and r["worst"] == near[-1][0]
                assert batch < 10000 or r["fresh"] == [want[i][k] for _, k in near]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_neighbours_ask_the_driver_for_little(spark, monkeypatch):
    """Rounds take their figures from what they write: each job costs the driver a plan, threads and a 4 MB block or more."""
    written, seen = [], []

    class Listed(neighbours.Stage):
        def __init__(self, df, name):
            super().__init__(df, name)
            written.append(self.path)
            seen.append(os.listdir(self.path))

    monkeypatch.setattr(neighbours, "Stage", Listed)
    x = np.random.default_rng(12).standard_normal((900, 16)).astype(np.float32)
    table = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    before = jobs()
    neighbours.nearest(table, table.filter("vec_id % 100 = 0").selectExpr("vec_id AS row"))
    assert written and jobs() - before <= 4.5 * len(written)  # 5.3 a table before
    assert not any("_SUCCESS" in files for files in seen)


def test_repeated_ids_among_few_vectors(spark):
    """A query's own rows are no candidates, however many; without enough others all are returned."""
    rows = [(0, [1.0, 0.0])] * 3 + [(100, [0.0, 1.0]), (200, [2.0, 0.0]), (200, [2.0, 0.0]), (300, None)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in sorted(neighbours.nearest(t, t.filter("vec_id < 200 OR vec_id = 300").selectExpr("vec_id AS row")).collect()):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == {0, 100} and len(got[0]) == 3 and sorted(got[0]) == [100, 200, 200] and sorted(got[100]) == [0, 0, 0, 200, 200]
