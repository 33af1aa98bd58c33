"""Text kernel: one authored row per rule branch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx


def run(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


@pytest.mark.parametrize("fn, value, want", [
    (tx.strip, "\t  a b  \n", "a b"),
    (tx.strip, " \n ", ""),
    (tx.strip, "\x1fa\x1c", "a"),
    (tx.strip, "x\ny ", "x\ny"),
    (tx.collapse_ws, " a \t\n b c ", "a b c"),
    (tx.collapse_ws, None, ""),
    (tx.sanitize, ' "a"  "b" ', "a b"),
    (tx.strip_punct, "a-b_c! né (x) [y] {z} ~`^|\\", "abc né x y z "),
    (tx.tokens, "Où est-ce né_1, İx?", None),
    (tx.clean_caption, "[TLE] The table caption is about cars. [TAB] a | b [SEP] c", "cars.  a  b  c"),
    (tx.clean_caption, " no marker [TAB] x ", "no marker  x"),
    (tx.clean_caption, "The table caption is about x The table caption is about y", "x The table caption is about y"),
    (tx.table_key, "a [TLE] key one [TAB] x [TAB]", "key one"),
    (tx.table_key, "[TLE][TAB]", ""),
    (tx.table_key, "[TLE] broken\nline [TAB]", "UNKNOWN_TABLE"),
    (tx.clean_claim, "is < it > so <b>", "it"),
    (tx.clean_claim, " <> ", ""),
    (tx.clean_claim, " plain < text ", "plain < text"),
    (tx.clean_claim, "<a\nb> ", "<a\nb>"),
    (lambda c: tx.question_after(c, tx.QUESTION_MARK), "p. The question: q? The question: r ", "q? The question: r"),
    (lambda c: tx.question_after(c, tx.QUESTION_MARK), "none", None),
    (tx.raw_table, "x [TAB] a [TAB] b\nc", "[TAB] a [TAB] b\nc"),
    (tx.raw_table, "nothing", ""),
    (tx.page_title, "THE Wikipedia page title of this table is\n Big \"A\"\nB. Rest.", "Big A B"),
    (tx.caption, "The table caption is x", ""),
    (lambda c: tx.prompt(c, "Create: "), "q", "Create: q"),
    (lambda c: tx.truncate(c, 3), "abcd", "abc…"),
    (lambda c: tx.truncate(c, 4), "abcd", "abcd"),
])
def test_expression(spark, fn, value, want):
    got = run(spark, fn, value)[0]
    if fn is tx.tokens:
        assert got[:4] == ["où", "est", "ce", "né_1"]
    else:
        assert got == want


SEGMENT = '[TLE]  The table caption is Big "x". [TAB] COL: | a \\ b | [SEP] cat [TAB] col: | 2 |'


@pytest.mark.parametrize("version, compat, want", [
    (2, False, "Big x. a b cat 2"),
    (2, True, "Big x. a b ca 2"),
    (1, False, "[TLE] The table caption is Big x. a b cat 2"),
    (1, True, "[TLE] The table caption is Big x. a b cat 2"),
])
def test_clean_segment(spark, version, compat, want):
    assert run(spark, lambda c: tx.clean_segment(c, version, compat), SEGMENT) == [want]


def test_clean_segment_single_space_quirk(spark):
    assert run(spark, lambda c: tx.clean_segment(c, 1, True), "but col: x", "bux col: x") == ["bu x", "bux x"]


def test_json_size_matches_spaced_json(spark):
    import json

    rows = [(1, "é\n\"q\"", None), (22, "", "x")]
    df = spark.createDataFrame(rows, "a int, b string, c string")
    got = [r[0] for r in df.orderBy("a").select(tx.json_size(F.struct("a", "b", "c"), 3)).collect()]
    want = [len(json.dumps(dict(zip("abc", r)), ensure_ascii=False).encode()) for r in rows]
    assert got == want
