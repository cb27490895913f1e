"""Every registered query with an oracle must equal DuckDB on sf0.001."""

import pytest

import __spark_entry__ as E
from oracle_util import canon, duck

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small_dir, name):
    got = QUERIES[name](spark, small_dir).toPandas()
    if name not in ORACLE:
        assert len(got.columns) > 0
        return
    want = con.execute(ORACLE[name]).df()
    gc, gr = canon(got)
    wc, wr = canon(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr
