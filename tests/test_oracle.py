"""Every registered query against its SQL on the smallest tables; those without SQL run and give rows with a stable schema."""

import oracle
import pytest

from wardenlake.plans import REGISTERED

FOLDER = "/root/testdata/sf0.001"
QUERIES = {n: q for m in REGISTERED for n, q in m.QUERIES.items()}
SQL = {n: q for m in REGISTERED for n, q in m.SQL.items()}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        oracle.compare(spark, con, QUERIES[name], SQL[name], FOLDER)
    else:
        df = QUERIES[name](spark, FOLDER)
        assert df.schema == QUERIES[name](spark, FOLDER).schema
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(QUERIES) <= set(__spark_entry__.queries())
