"""Topic labels, entity lookups and predictor comparison."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import compare, topics

SCHEMA = "k int, topics_a array<struct<label: string, score: double>>, topics_b array<struct<label: string, score: double>>"


def ranking(*labels):
    return [(label, 0.9 - i / 10 if label else None) for i, label in enumerate(labels)]


def frame(spark, *rows):
    return spark.createDataFrame([(i, ranking(*a), ranking(*b)) for i, (a, b) in enumerate(rows)], SCHEMA)


def tau_reference(a, b):
    """Tau-b over the union of two rankings; a repeated topic counts at its last place."""
    ra, rb = {t: i + 1 for i, t in enumerate(a)}, {t: i + 1 for i, t in enumerate(b)}
    points = [(ra.get(t, 4), rb.get(t, 4)) for t in {*ra, *rb}]
    sign = lambda v: (v > 0) - (v < 0)
    s = ta = tb = 0
    for (x1, y1), (x2, y2) in itertools.combinations(points, 2):
        dx, dy = sign(x1 - x2), sign(y1 - y2)
        s, ta, tb = s + dx * dy, ta + abs(dx), tb + abs(dy)
    return s / (ta * tb) ** 0.5 if ta and tb else None


def test_kendall_over_many_rankings(spark):
    pool = list(itertools.product("pqr", repeat=3))[::2] + [("p", "x", "y"), ("x", "y", "z")]
    pairs = [(a, b) for a in pool for b in pool[::3]]
    df = frame(spark, *pairs)
    got = df.orderBy("k").select(compare.kendall_row(F.col("topics_a"), F.col("topics_b"))).collect()
    for (a, b), r in zip(pairs, got):
        want = tau_reference(a, b)
        assert r[0] == (pytest.approx(want) if want is not None else None)


def test_published_comparison_values(spark):
    """298 disjoint rows and 2 rows without topics: agreement 0, overlap 0, mean tau -0.7497 / -0.75."""
    none = (None, None, None)
    df = frame(spark, *[(("a", "b", "c"), ("d", "e", "f"))] * 298, *[(none, ("d", "e", "f"))] * 2)
    row = df.agg(
        compare.agreement().alias("agreement"), compare.overlap().alias("overlap"),
        compare.kendall().alias("tau"), compare.kendall(compat=True).alias("compat"),
    ).first()
    assert (row.agreement, row.overlap) == (0.0, 0.0)
    assert round(row.tau, 4) == -0.75 and round(row.compat, 4) == -0.7497


def test_agreement_overlap_and_disagreements(spark):
    df = frame(spark, ("abc", "abd"), ("abc", "bca"), ("abc", "xyz"), ((None, "b", "c"), "abc"))
    row = df.agg(compare.agreement().alias("agreement"), compare.overlap().alias("overlap")).first()
    assert (row.agreement, row.overlap) == (0.25, 0.75)
    out = compare.disagreements(df).orderBy("k").collect()
    assert [r.k for r in out] == [1, 2, 3]
    assert out[0].score_diff_1 == 0.0 and out[2].score_diff_1 is None


def test_pearson_modes(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None)], "x double, y double")
    assert df.agg(compare.pearson(F.col("x"), F.col("y"))).first()[0] == pytest.approx(1.0)
    assert df.agg(compare.pearson(F.col("x"), F.col("y"), strict=True)).first()[0] is None


def test_duplicate_keys_and_row_selection(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert [tuple(r) for r in compare.duplicate_keys(df, "k").collect()] == [(1, 2)]
    assert compare.select_rows(df, df.where("k = 2"), "k").count() == 1


def predictions(spark, keys):
    return spark.createDataFrame([(k, None if k == 9 else [(f"t{i}",)]) for i, k in enumerate(keys)], "k int, topics array<struct<label: string>>")


def test_alignment_is_one_to_one(spark):
    a, b = predictions(spark, [1, 2, 9, None]), predictions(spark, [9, 2, 3, None, None])
    got = {r["k"]: (r["topics_a"], r["topics_b"]) for r in compare.align_predictions(a, b, "k").collect()}
    assert set(got) == {2, 9} and got[9] == (None, None) and got[2][0][0].label == "t1" and got[2][1][0].label == "t1"
    again = b.unionByName(predictions(spark, [2] * 500 + [7, 7]))
    with pytest.raises(Exception, match="k is not unique: "):
        compare.align_predictions(a, again, "k").collect()
    with pytest.raises(Exception, match="k is not unique: 7"):  # a repeated key counts, though it has no partner
        compare.align_predictions(a, b.unionByName(predictions(spark, [7, 7])), "k").collect()
    assert [r["k"] for r in compare.align_predictions(a, again, "k", "skip").collect()] == [9]
    audit = sorted(map(tuple, compare.alignment_audit(a, again, "k").collect()), key=repr)
    assert audit == sorted([(1, 1, 0, "only in a"), (2, 1, 501, "repeated"), (3, 0, 1, "only in b"), (7, 0, 2, "repeated"), (None, 1, 2, "null")], key=repr)
    assert compare.align_predictions(a.limit(0), b.limit(0), "k").count() == 0


def test_alignment_takes_one_shuffle(spark):
    a, b = predictions(spark, [1, 2]), predictions(spark, [2, 3])
    plan = compare.align_predictions(a, b, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_comparison_lines(spark):
    lines = compare.comparison(frame(spark, ("abc", "abd"), ("abc", "bca"))).orderBy("line_no").collect()
    assert [r.line_no for r in lines] == [1, 2, 3, 4, 5]
    assert lines[0].value == 0.5 and lines[1].value == 1.0


def test_top_labels_ties_rounding_and_padding(spark):
    df = spark.createDataFrame([(0.123456, 0.5, 0.5), (0.9, 0.1, 0.0)], "a double, b double, c double")
    scores = topics.label_scores([F.col("a"), F.col("b"), F.col("c")], ["A", "B", "C"])
    got = [[tuple(t) for t in r[0]] for r in df.select(topics.top_labels(scores)).collect()]
    assert got[0] == [("B", 0.5), ("C", 0.5), ("A", 0.1235)]
    two = df.limit(1).select(F.slice(topics.top_labels(scores), 1, 2).alias("topics"))
    row = topics.flatten_top(two, pad=("N/A", 0.0)).first()
    assert (row.top_3_topic, row.top_3_score) == ("N/A", 0.0)
    assert topics.flatten_top(two).first().top_3_topic is None


def length_scorer():
    return lambda texts, labels: [[len(t) / (i + 1) for i in range(len(labels))] for t in texts]


def test_plugged_scorer_and_lexicon(spark):
    df = spark.createDataFrame([("film album war",), ("nothing",)], "text string")
    native = [r.scores for r in topics.score_topics(df, "text").collect()]
    by_label = {s.label: s.score for s in native[0]}
    assert by_label["Media and Entertainment"] == pytest.approx(2 / 3)
    assert {s.score for s in native[1]} == {0.0}
    plugged = topics.score_topics(df, "text", ["L", "M"], length_scorer).first().scores
    assert [(s.label, s.score) for s in plugged] == [("L", 14.0), ("M", 7.0)]


def test_entities(spark):
    df = spark.createDataFrame([("near Paris Élysée, Paris Élysée met Al Bo on 1999 and 12 by Jo.",)], "t string")
    found = topics.entities(topics.tag_entities(F.col("t")))
    assert df.select(topics.entities_text(found)).first()[0] == "Paris Élysée, Al Bo, 1999"


def test_lookup_topics_keeps_unmatched_rows(spark):
    df = spark.createDataFrame(
        [(i, ["Hot", "Rare"] if i % 2 else ["Rare", "Hot", "Hot2"]) for i in range(40)] + [(99, ["Nope"]), (100, [])],
        "id int, entities array<string>",
    )
    titles = spark.createDataFrame([("Hot", "T1"), ("Hot2", "T1"), ("Rare", "T2")], "entity string, title string")
    scored = spark.createDataFrame(
        [("T1", [("L", 0.2), ("M", 0.7)])], "title string, scores array<struct<label: string, score: double>>"
    )
    got = {r.id: r for r in topics.lookup_topics(df, "id", titles, scored).collect()}
    assert len(got) == 42
    assert got[1].page == "T1" and got[1].titles == ["T1", "T2"]
    assert [tuple(t) for t in got[1].topics] == [("M", 0.7), ("L", 0.2)]
    assert got[0].page == "T2" and got[0].topics is None
    assert got[99].page is None and got[100].titles is None


@pytest.mark.parametrize("size", [2, 3, 5])
def test_kendall_of_lists_of_any_length(spark, size):
    import random
    from itertools import combinations

    draw = random.Random(size)
    names = [f"t{i}" for i in range(size + 2)]
    rows = [(i, draw.sample(names, size), draw.sample(names, size)) for i in range(20)]
    kind = "array<struct<label: string, score: double>>"
    df = spark.createDataFrame([(i, [(t, 0.0) for t in a], [(t, 0.0) for t in b]) for i, a, b in rows], f"i int, a {kind}, b {kind}")
    got = {r.i: r.tau for r in df.select("i", compare.kendall_row(F.col("a"), F.col("b")).alias("tau")).collect()}
    for i, a, b in rows:
        def rank(ranking, topic):
            return ranking.index(topic) if topic in ranking else size
        pairs = [(rank(a, s) - rank(a, t), rank(b, s) - rank(b, t)) for s, t in combinations(sorted({*a, *b}), 2)]
        sign = lambda v: (v > 0) - (v < 0)
        both = sum(sign(x) * sign(y) for x, y in pairs)
        scale = (sum(x != 0 for x, _ in pairs) * sum(y != 0 for _, y in pairs)) ** 0.5
        assert got[i] == pytest.approx(both / scale)
