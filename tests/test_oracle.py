import pytest
from oracle import compare, connect

from pitchside.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert compare(spark, name, registry.queries()[name], SQL[name], "/root/testdata/sf0.001") == ""


def test_every_sql_has_rows():
    """What compares with nothing proves nothing."""
    con = connect()
    assert [name for name, sql in SQL.items() if not con.execute(f"SELECT 1 FROM ({sql}) LIMIT 1").fetchall()] == []
