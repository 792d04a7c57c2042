"""Every catalogue query against its SQL, at the smallest size."""

import os

import pytest

from claimgraph.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(pdf, columns):
    return sorted(map(str, pdf[columns].astype(object).where(pdf[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and rows(got, columns) == rows(want, columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    if name == "normalize_predicate":
        assert len(got) == 5 and all(r.normal.lower().replace("-", " ") == r.predicate for r in got.itertuples())
    else:  # every region's own node leads the list that its name gives
        assert name == "four_doors" and {r.query_id: r.id for r in got[got["rank"] == 1].itertuples()} == {f"q{k}": f"R#{k}" for k in range(5)}
