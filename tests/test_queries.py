"""Every registered core query against its SQL on the smallest data."""

import pytest
from oracle import connect, same

from sparkademia.plans import analytics, data_problems, functions, operations, pipeline, search, streams

MODULES = [data_problems, search, functions, analytics, operations, pipeline, streams]
CASES = [(m, n) for m in MODULES for n in m.queries()]


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_query(spark, data, con, module, name):
    df = module.queries()[name](spark, data)
    sql = module.oracle_sql().get(name)
    if sql:
        same(df, con, sql)
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
