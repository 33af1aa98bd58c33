"""Every registered query against its SQL equivalent, and the invariants between reports."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from corpusloom.plans.catalog import QUERIES
from corpusloom.plans.oracle import ORACLES
from tests.oracle_check import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= queries().items() and ORACLES.items() <= oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert difference(queries()[name](spark, SF), con, oracle_sql()[name]) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_cross_tabs_conserve_rows(spark):
    total = queries()["typed_questions"](spark, SF).count()
    for name in ("question_type_per_source", "answer_type_per_source"):
        rows = queries()[name](spark, SF).collect()
        counts = {r["source"]: sum(r[1:]) for r in rows}
        assert counts.pop("TOTAL") == total == sum(counts.values())


def test_histogram_and_skill_totals_agree(spark):
    histogram = queries()["skill_histogram"](spark, SF).collect()
    skills = {r["source"]: sum(r[1:]) for r in queries()["skills_per_source"](spark, SF).collect()}
    assert sum(r["num_skills"] * r["n"] for r in histogram) == skills["TOTAL"]
