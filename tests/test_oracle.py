"""Every query against its SQL, on the smallest given tables."""

from __future__ import annotations

import pytest

from checks.compare import connect, mismatch
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert mismatch(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) is None
