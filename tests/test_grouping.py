"""Grouping by table, with and without segments, against plain Python."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import extract, grouping, relatedness

ROWS = [
    ("fetaqa_x", 0, '[TLE] The Wikipedia page title of this table is A. [TAB] col: | 1 |', "c [HIGHLIGHTED_END] q0  one?", "a0"),
    ("fetaqa_x", 1, '[TLE] The Wikipedia page title of this table is A. [TAB] col: | 1 |', "no marker", "a1"),
    ("fetaqa_x", 2, '[TLE] The Wikipedia page title of this table is A. [TAB] col: | 1 |', "[HIGHLIGHTED_END] q2", ' "a2" '),
    ("hybridqa_x", 0, "[TAB] col: | 2 |", "The question: who?", "me"),
    ("hybridqa_x", 1, "[TAB] col: | 2 |", "The question: ", "lost"),
    ("wikitq_x", 0, "", "what?", "that"),
    ("wikitq_x", 1, "[TAB] col: | 2 |", '"', "that"),
    ("hitab_x", 7, "The table caption is C. none", "z", "y"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(
        ROWS, "source string, ord long, input_seg string, question string, output string"
    ).repartition(3)


def test_extract_qa(raw):
    got = {(r.source, r.ord): (r.question, r.answer) for r in extract.extract_qa(raw).collect()}
    assert got == {
        ("fetaqa_x", 0): ("q0  one?", "a0"), ("fetaqa_x", 2): ("q2", "a2"), ("hybridqa_x", 0): ("who?", "me"),
        ("wikitq_x", 0): ("what?", "that"), ("hitab_x", 7): ("z", "y"),
    }


def test_extract_tqa(raw):
    got = {(r.source, r.ord): (r.question, r.answer, r.table) for r in extract.extract_tqa(raw).collect()}
    assert got[("fetaqa_x", 0)] == ("q0 one?", "a0", "[Wikipedia page title:A; ] [TAB] col: | 1 |")
    assert got[("hitab_x", 7)] == ("z", "y", "[Table caption:C; ]")
    assert got[("wikitq_x", 0)][2] == ""
    assert len(got) == 5


def test_group_qa_clean(raw):
    asked = raw.withColumn("question", extract.unwrap_question(F.col("question")))
    got = {(r.source, r.table): (r.num_pairs, r.qas) for r in grouping.group_qa_clean(asked).collect()}
    assert got == {
        ("fetaqa_x", "A. 1"): (2, "q0 one a0 q2 a2"), ("hybridqa_x", "2"): (1, "who me"),
        ("hitab_x", "The table caption is C. none"): (1, "z y"),
    }


def pairs(n=400):
    """One hot table with two thirds of the pairs, some pairs without text."""
    out = []
    for i in range(n):
        table = "hot" if i % 3 else f"t{i % 21}"
        out.append(("s", i, f"q{i}" if i % 5 else " ", f"a {i}" if i % 10 else "", table))
    return out


def reference_groups():
    groups = {}
    for _, i, q, a, table in pairs():
        groups.setdefault(table, []).append(f"{q.strip()} {a}".strip())
    return {t: (len(ps), " ".join(p for p in ps if p)) for t, ps in groups.items()}


@pytest.mark.parametrize("segment_bytes, block_rows", [(1 << 20, 4096), (100, 4), (300, 50), (1, 1)])
def test_segments_add_up_to_the_whole_text(spark, segment_bytes, block_rows):
    df = spark.createDataFrame(pairs(), "source string, ord long, question string, answer string, table string")
    rows = grouping.group_qa_by_table(
        df.repartition(5), segment_bytes=segment_bytes, block_rows=block_rows
    ).orderBy("table", "segment").collect()
    want = reference_groups()
    got = {}
    for r in rows:
        n, text = got.get(r.table, (r.num_pairs, []))
        assert n == r.num_pairs
        got[r.table] = (n, text + ([r.qas] if r.qas else []))
        assert len(r.qas) <= segment_bytes + block_rows * 12
    assert {t: (n, " ".join(texts)) for t, (n, texts) in got.items()} == want
    if segment_bytes == 1 << 20:
        assert len(rows) == len(want)


def test_claim_segments_open_with_the_table_once(spark):
    df = spark.createDataFrame(
        [("s", i, "The table caption is about T [TAB] x", f"<c{i}>") for i in range(50)],
        "source string, ord long, input_seg string, question string",
    )
    lines = grouping.group_claims(df, segment_bytes=40, block_rows=3).orderBy("segment").collect()
    assert len(lines) > 3
    assert " ".join(r.line for r in lines) == "T  x " + " ".join(f"c{i}" for i in range(50))
    assert {r.num_claims for r in lines} == {50}


def test_group_size_stats(spark):
    df = spark.createDataFrame(
        [("a", "t1")] * 3 + [("a", "t2")] + [("b", "t1")] * 6, "source string, table string"
    )
    got = {r.source: r for r in grouping.group_size_stats(df).collect()}
    assert (got["a"].num_tables, got["a"].total_qas, got["a"].mean, got["a"].median) == (2, 4, 2.0, 2.0)
    assert got["ALL"].num_tables == 3  # a table in two sources is two groups
    assert got["ALL"].stdev == pytest.approx(statistics.pstdev([3, 1, 6]))


def test_token_relatedness_adds_up_segments(spark):
    whole = spark.createDataFrame([(1, "a b b", "b c c a")], "k int, l string, r string")
    parts = spark.createDataFrame([(1, "a b b", "b c"), (1, "", "c a")], "k int, l string, r string")
    scores = [
        relatedness.token_relatedness(df, ["k"], F.col("l"), F.col("r")).first()["similarity_score"]
        for df in (whole, parts)
    ]
    assert scores[0] == pytest.approx(scores[1]) == pytest.approx(3 / (5 ** 0.5 * 6 ** 0.5))


def test_text_relatedness_inside_a_row(spark):
    """Bit for bit the score by key and term: repeats, letters beyond ASCII, no common term, empty and null texts, a long text."""
    draw = random.Random(7)
    words = ["a", "A", "b", "été", "Été", "日本", "_x", "1", "zz"]
    texts = [" ".join(draw.choices(words, k=n)) for n in (1, 2, 5, 40, 3000)] + ["", None, "!!", "q r s"]
    frame = spark.createDataFrame([(i * 9 + j, l, r) for i, l in enumerate(texts) for j, r in enumerate(texts)], "k int, l string, r string")
    got = {r.k: r.s for r in frame.select("k", relatedness.text_relatedness(F.col("l"), F.col("r")).alias("s")).collect()}
    want = {r.k: r.similarity_score for r in relatedness.token_relatedness(frame, ["k"], F.col("l"), F.col("r")).collect()}
    assert got == want and len(got) == 81 and 0 < sum(x > 0 for x in got.values()) < 81


def test_document_relatedness_shuffles_texts_not_terms(spark):
    """One row a document from its two texts; no aggregate over (document, term) pairs, whose size is that of all texts."""
    from corpusloom.plans.catalog import QUERIES

    for name in ("relatedness_text", "relatedness_text_english"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "_term" not in plan and "Join" not in plan


def test_token_relatedness_of_empty_text_is_zero(spark):
    df = spark.createDataFrame([(1, "", "x"), (2, None, None)], "k int, l string, r string")
    got = relatedness.token_relatedness(df, ["k"], F.col("l"), F.col("r")).collect()
    assert sorted((r["k"], r["similarity_score"]) for r in got) == [(1, 0.0), (2, 0.0)]


def letter_embedder():
    return lambda texts: [[float(t.count("a")), float(t.count("b")), 1.0] for t in texts]


def test_embedding_relatedness_takes_a_plugged_model(spark):
    df = spark.createDataFrame([("a", "a"), ("aa", "bb")], "l string, r string")
    got = relatedness.embedding_relatedness(df, F.col("l"), F.col("r"), letter_embedder).collect()
    assert sorted(round(r["similarity_score"], 6) for r in got) == [0.2, 1.0]


def test_each_distinct_text_is_embedded_once(spark):
    """Copies of a text for a third of the rows, on either side; mini-batches by number and by length."""
    texts = [f"text {i} " + "a" * (i % 50) for i in range(40)]
    rows = [(i, texts[0] if i % 3 == 0 else texts[i % 40], texts[(i * 7) % 40] if i % 5 else None, "x") for i in range(600)]
    calls, sizes = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    too_large = spark.sparkContext.accumulator(0)

    def embedder():
        def encode(some):
            calls.add(1)
            sizes.add(len(some))
            too_large.add(int(len(some) > 8 or len(some) * max(map(len, some)) > 200 and len(some) > 1))
            return [[float(t.count("a")), float(len(t)), 1.0] for t in some]
        return encode

    frame = spark.createDataFrame(rows, "k int, l string, r string, _text string")
    got = {r["k"]: r for r in relatedness.embedding_relatedness(frame, F.col("l"), F.col("r"), embedder, batch_texts=8, batch_chars=200).collect()}
    assert sizes.value == len({t for _, l, r, _ in rows for t in (l, r or "")}) and too_large.value == 0 and calls.value > 5

    def vector(t):
        return [t.count("a"), len(t), 1.0]

    for k, l, r, x in rows:
        a, b = vector(l), vector(r or "")
        want = sum(p * q for p, q in zip(a, b)) / (sum(p * p for p in a) * sum(q * q for q in b)) ** 0.5
        assert abs(got[k]["similarity_score"] - want) < 1e-6 and (got[k]["l"], got[k]["r"], got[k]["_text"]) == (l, r, x)
    assert len(got) == len(rows)


def test_mini_batches():
    assert list(relatedness.mini_batches([], 4, 10)) == []
    assert list(relatedness.mini_batches([1, 2, 3, 4, 50, 1], 3, 9)) == [(0, 3), (3, 4), (4, 5), (5, 6)]
