"""Every registered query of the engine against its SQL."""

import os

import duckdb
import pytest

from docforge.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(round(v[k], 6) if isinstance(v[k], float) else v[k] for k in at) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SF)
    own = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalogue.ORACLE_SQL:
        assert own[0]
        return
    found = oracle.execute(catalogue.ORACLE_SQL[name])
    assert own == rows([d[0] for d in found.description], found.fetchall())
