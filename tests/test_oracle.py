"""Every query with SQL against the other engine, on the smallest tables."""

import duckdb
import pytest

from graphwright import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, oracle, name):
    done = oracle.execute(queries.SQL[name])
    columns = [d[0] for d in done.description]
    ours = queries.QUERIES[name](spark, SF)
    assert sorted(ours.columns) == sorted(columns)
    assert _rows(ours.columns, [tuple(r) for r in ours.collect()]) == _rows(columns, done.fetchall())


def test_all_queries_have_sql():
    assert set(queries.QUERIES) - set(queries.SQL) == {"q15_call_chains"}  # too many chains for plain SQL
