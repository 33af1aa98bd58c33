"""The SQL forms of this package's queries."""

from __future__ import annotations

import pytest

from corpusloom.llm.oracle import ORACLES
from corpusloom.llm.queries import QUERIES
from tests.oracle_check import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None
