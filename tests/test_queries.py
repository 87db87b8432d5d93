"""Each query against its SQL on the smallest tables."""

import duckdb
import pytest

from sparkloom.plans.registry import ORACLE_SQL, QUERIES
from sparkloom.sources.tables import TABLES, table

DATA = "/root/testdata/sf0.001"
SLOW = {"array_grammar_v1", "array_grammar_v2", "array_grammar_v4"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in ORACLE_SQL if n not in SLOW])
def test_query_equals_sql(spark, con, name):
    mine, theirs = QUERIES[name](spark, DATA), con.sql(ORACLE_SQL[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    key = lambda rows: sorted(map(str, rows))
    assert key(tuple(r[c] for c in columns) for r in mine.collect()) == key(con.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_unknown_table_is_named(spark):
    with pytest.raises(ValueError, match="nonsense"):
        table(spark, DATA, "nonsense")
