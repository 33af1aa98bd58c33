"""Result normalisation, outcome summary and query text repair."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import outcomes, repair
from corpusloom.sources import reports

CASES = [
    ('{"results": {"bindings": [{"obj": {"value": "b"}}, {"obj": {"value": "a"}}, {"obj": {"value": "b"}}]}}', None, "b;a", ""),
    ('{"results": {"bindings": []}}', None, "empty", ""),
    ('{"results": {"bindings": [{"x": {"value": "b"}}, {"obj": {"type": "uri"}}]}}', None, "empty", ""),
    ('{"boolean": true}', None, "empty", ""),
    ('{"results": {"bindings": {}}}', None, None, "Unexpected results format"),
    ("<html>\nno", None, None, "Invalid JSON: JSONDecodeError: <html> no"),
    ("x" * 200, None, None, "Invalid JSON: JSONDecodeError: " + "x" * 200),
    (None, "Network error: Timeout: t", None, "Network error: Timeout: t"),
]


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame([(i, b, e) for i, (b, e, _, _) in enumerate(CASES)], "i int, body string, failure string")
    return outcomes.normalize_results(df, "body", "failure")


def test_normalize_results(results):
    got = [(r.obj_values, r.error) for r in results.orderBy("i").collect()]
    assert got == [(v, e) for _, _, v, e in CASES]


def test_outcome_summary_and_report(results):
    summary = outcomes.outcome_summary(results)
    assert {r.status: r.n for r in summary.collect()} == {"non_empty": 1, "empty": 3, "error_nan": 4, "TOTAL": 8}
    lines = [r.line for r in reports.outcome_report(summary, results).collect()]
    assert lines[1:5] == [
        "**Total rows processed:** 8", "- **Non-empty results:** 1 (12.50%)", "- **Empty results:** 3 (37.50%)",
        "- **Errors (NaN):** 4 (50.00%)",
    ]
    assert lines[5:8] == ["## Distinct Error Types", "| # | Error Message |", "|---|---------------|"]
    assert [x.split(" | ")[0] for x in lines[8:]] == ["| 1", "| 2", "| 3", "| 4"]


def test_published_outcome_counts(spark):
    """350 rows: none with values, 332 empty, 18 errors."""
    df = spark.range(350).select(F.when(F.col("id") < 332, "empty").alias("obj_values"))
    got = {r.status: (r.n, round(r.percent, 2)) for r in outcomes.outcome_summary(df).collect()}
    assert got == {"empty": (332, 94.86), "error_nan": (18, 5.14), "TOTAL": (350, 100.0)}


def test_http_error(spark):
    df = spark.createDataFrame([(200, "ok"), (503, " down\nnow ")], "s int, b string")
    assert [r[0] for r in df.select(outcomes.http_error(F.col("s"), F.col("b"))).collect()] == [None, "HTTP 503: down now"]


def test_changed_count_is_null_safe(spark):
    df = spark.createDataFrame([("s", None, None), ("s", "a", None), ("s", "a", "a")], "source string, x string, y string")
    assert tuple(outcomes.changed_count(df, "x", "y").first()) == ("s", 3, 1)


@pytest.mark.parametrize("rule, text, want", [
    (repair.brackets_to_braces, "where [ a [b] ", "where { a {b} "),
    (repair.map_prefixes, "wdt:a ps:b p:c wd:d dbp:e xwd:f", "dbo:a dbo:b dbo:c dbr:d dbp:e xwd:f"),
    (repair.local_names, "dbr:Box:Lid:x a:b c::d", "dbr:Box_Lid_x a:b c:_d"),
    (repair.local_names, "1a:b:c:d", "1a:b:c_d"),
    (repair.local_names, "a:b.c:d:e f:g", "a:b.c:d_e f:g"),
    (repair.stray_characters, "a&b 'c' >d >= <x> -> .", "a b c  d  = <x> -> ."),
    (repair.quote_times, 'at 12:30 and "1:05" x12:30', 'at "12:30" and "1:05" x12:30'),
    (repair.contains_arguments, "contains( ?a , 'b', 'en' ) Contains(?x)", "CONTAINS(?a, 'b') CONTAINS(?x)"),
    (repair.alias_variables, "(count(?x) as n) AS ?m has x", "(count(?x) AS ?n) AS ?m has x"),
    (repair.upper_where, "x Where y nowhere", "x WHERE y nowhere"),
    (repair.keywords_and_spacing, " select  ask{a}order \t by DESC (x)limit 5", "SELECT ASK { a } ORDER BY DESC(x) LIMIT 5"),
    (repair.balance_brackets, "{ a } }", "{ a }"), (repair.balance_brackets, "{ a } } x", "{ a } } x"),
    (repair.balance_brackets, "{ { a", "{ { a } }"), (repair.balance_brackets, "f(g(x", "f(g(x))"),
    (repair.balance_brackets, "(a) ) )", "(a)"), (repair.balance_brackets, "} }", ""),
])
def test_rule(spark, rule, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(rule(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("body, want", [
    ("?x p:a ?y", "?x p:a ?y"), ("?x ?x p:a", "?x p:a ?v1"), ("?x p:a . ?y p:b", "?x p:a ?v1 . ?y p:b ?v2"),
    ("?x p:a q:b ?y", "?x p:a ?v1 . ?v1 q:b ?y"), ("?x 5 q:b ?y", ""), ("?x word q:b ?y", ""),
    ("?x 5 q:b ?y ?z", "?x q:b ?y"), ("?x 5 ?y", ""), ("word p:a ?y", ""), (":a p:a ?y", ""),
    ("<i> p:a ?y , ;", "<i> p:a ?y"), ("FILTER(?x > 1. 5) . ?x p:a 1 2 3", "FILTER(?x > 1. 5) . ?x p:a 1"),
    ("optional { ?a p:b ?c . ?d p:e ?f } .. ?x", "optional { ?a p:b ?c . ?d p:e ?f }"), ("", ""), (" . ", ""),
])
def test_repair_body(body, want):
    assert repair.repair_body(body) == want


def test_repair_keeps_other_columns_and_null(spark):
    df = spark.createDataFrame([("s", 1, None), ("s", 2, "ask { }")], "source string, ord int, sparql string")
    fixed, audit = repair.repair_text(df)
    assert [tuple(r) for r in fixed.orderBy("ord").collect()] == [("s", 1, None), ("s", 2, "ASK { }")]
    counts = {r.rule: (r.num_rows, r.changed) for r in audit.collect()}
    assert counts["any"] == (2, 1) and counts["map_prefixes"] == (2, 0)


def test_errors_that_differ_late_stay_apart(spark):
    df = spark.createDataFrame([("x" * 200 + "a",), ("x" * 200 + "b",)], "body string")
    assert outcomes.distinct_errors(outcomes.normalize_results(df, "body")).count() == 2


def test_distinct_errors_parse_each_body_once(results):
    plan = outcomes.distinct_errors(results)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 2 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
