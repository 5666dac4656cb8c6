"""Every registered query against its SQL on the smallest test tables."""

from __future__ import annotations

import os

import pytest
from check_oracle import compare, connect

from shirabe.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in SQL:
        assert compare(name, got, duck.execute(SQL[name]).df()) is None


def test_names():
    assert set(SQL) <= set(QUERIES)
