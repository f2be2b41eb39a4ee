import pytest
from oracle import compare, connect

from sigloom.queries import live, matrices, relational, sessions, signal, two_channels

MODULES = (relational, signal, matrices, two_channels, live, sessions)
WITH_SQL = [(m, name) for m in MODULES for name in m.ORACLE_SQL]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize(("module", "name"), WITH_SQL, ids=[n for _, n in WITH_SQL])
def test_query_equals_sql(spark, sf_dir, con, module, name):
    compare(module.QUERIES[name](spark, sf_dir), module.ORACLE_SQL[name], con)
