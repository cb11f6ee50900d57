"""Every registered query against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessel.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(df, rel):
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    pick = lambda rows, cols: sorted(repr([r[cols.index(c)] for c in order]) for r in rows)
    assert pick([tuple(r) for r in df.collect()], list(df.columns)) == pick(rel.fetchall(), list(rel.columns))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, db, name):
    same(registry.QUERIES[name](spark, SF), db.sql(registry.ORACLE_SQL[name]))


def test_every_query_has_a_name_in_entry():
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
