import duckdb
import pytest

from tidemark import queries, queries_listing, queries_lookups, queries_meetings, queries_records  # noqa: F401
from tests.conftest import SF


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, tables, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(show(r[c]) for c in columns) for r in df.collect())
    rel = tables.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(show(r[i]) for i in order) for r in rel.fetchall())
