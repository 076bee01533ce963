"""Every query with checking SQL gives the same rows in both engines."""

from __future__ import annotations

import oracle
import pytest

from sondeo.plans import catalog

QUERIES, ORACLES = catalog.load_all()


@pytest.fixture(scope="module")
def duck(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, data, duck, name):
    found = oracle.spark_rows(QUERIES[name](spark, data))
    expected = oracle.duck_rows(duck, ORACLES[name])
    assert found[0] == expected[0]
    assert found[1] == expected[1]


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
