import pytest
from compare import SF, against_sql

from quern import queries as own
from quern import queries_eval as more

QUERIES, ORACLE_SQL = own.QUERIES | more.QUERIES, own.ORACLE_SQL | more.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    got, want = against_sql(QUERIES[name](spark, SF), ORACLE_SQL[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.collect()
