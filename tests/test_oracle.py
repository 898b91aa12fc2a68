"""Every query with SQL gives the rows DuckDB gives on the smallest tables."""

import pytest

from strandwork import catalog

from .compare import connect, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    if name not in catalog.ORACLE:
        assert len(got.columns)
        return
    want = duck.execute(catalog.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
