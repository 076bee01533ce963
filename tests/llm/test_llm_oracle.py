"""Every training-data query with checking SQL gives the same rows in both engines."""

from __future__ import annotations

import oracle
import pytest

from sondeo.llm import queries as llm


@pytest.fixture(scope="module")
def duck(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_matches_sql(spark, data, duck, name):
    assert oracle.spark_rows(llm.QUERIES[name](spark, data)) == oracle.duck_rows(duck, llm.ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES) == list(range(1, 14))
