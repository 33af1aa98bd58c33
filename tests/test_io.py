"""Readers, sinks and reports on authored files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F, types as T

from corpusloom.operators import crosstab, extract, joins
from corpusloom.sources import readers, reports, writers


def test_dataset_names(spark):
    names = ["a.csv", "a-type.csv", "a.grouped.csv", "a.gtqa.csv", "b.json", "c.x.txt", "plain"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(readers.dataset_name(F.col("n"))).collect()] == ["a", "a", "a", "a", "b", "c.x", "plain"]


@pytest.fixture
def corpus(tmp_path):
    items = [
        {"input_seg": "s0", "question": "q0", "output": " text ", "extra": 1},
        {"input_seg": "s1", "question": "q1", "output": {"result": "r", "answer": 5}},
        {"input_seg": "s2", "question": None, "output": ["first", "second"]},
        {"input_seg": "s3", "question": "q3", "output": [{"a": 1}]},
        {"input_seg": "s4", "question": "q4", "output": True},
        {"input_seg": "s5", "question": "q5"},
        {"input_seg": "s6", "question": "q6", "output": None},
        {"input_seg": "s7", "question": "q7", "output": {"b": "é", "a": [1, 2]}},
        {"input_seg": "s8", "question": "q8", "output": 7},
    ]
    (tmp_path / "good.json").write_text(json.dumps(items, indent=1, ensure_ascii=False))
    (tmp_path / "broken.json").write_text('[{"input_seg": "x", ')
    (tmp_path / "object.json").write_text('{"input_seg": "x", "question": "q"}')
    (tmp_path / "note.txt").write_text("[]")
    return str(tmp_path)


def test_read_examples_skips_bad_files(spark, corpus):
    df = readers.read_examples(spark, corpus)
    rows = df.withColumn("answer", extract.answer_text(df, "output")).orderBy("ord").collect()
    assert {r.source for r in rows} == {"good"}
    assert [r.ord for r in rows] == list(range(9))
    assert [r.answer for r in rows] == [
        "text", "r", "first", '[{"a": 1}]', "True", "", "None", '{"a": [1, 2], "b": "é"}', "7"
    ]
    assert rows[2].question is None
    assert [(r.ord, r.question, r.answer) for r in extract.extract_qa(df).collect()] == [(0, "q0", "text")]
    assert [(r.ord, r.answer, r.table) for r in extract.extract_tqa(df).collect()] == [(0, "text", "")]


def test_read_example_lines(spark, tmp_path):
    lines = ['{"input_seg": "a", "question": "q", "output": "x", "id": 7}', "broken", '{"question": "r", "output": [1], "id": 8}']
    (tmp_path / "set.jsonl").write_text("\n".join(lines))
    got = readers.read_example_lines(spark, str(tmp_path), ord_col="id").orderBy("ord").collect()
    assert [(r.source, r.ord, r.question) for r in got] == [("set", 7, "q"), ("set", 8, "r")]
    assert readers.read_example_lines(spark, str(tmp_path)).select("ord").distinct().count() == 2


SCHEMA = T.StructType([T.StructField("question", T.StringType()), T.StructField("n", T.IntegerType())])


@pytest.mark.parametrize("on_bad, want", [
    ("drop", [('a "b", c\nd', 1)]), ("keep", [('a "b", c\nd', 1), ("bad", None)]), ("fail", None),
])
def test_read_table_policies(spark, tmp_path, on_bad, want):
    (tmp_path / "t-type.csv").write_text('question,n\n"a ""b"", c\nd",1\nbad,x\n')
    df = readers.read_table(spark, str(tmp_path), SCHEMA, on_bad, multi_line=True)
    if want is None:
        with pytest.raises(Exception):
            df.collect()
    else:
        assert sorted((r.question, r.n) for r in df.collect()) == sorted(want)
        assert {r.source for r in df.collect()} == {"t"}
        assert readers.read_table(spark, str(tmp_path), SCHEMA, on_bad, multi_line=True, skip=["t"]).count() == 0
    assert readers.read_header(spark, str(tmp_path / "t-type.csv")) == ["question", "n"]


def test_column_checks(spark):
    df = spark.createDataFrame([(1, "x")], ["a ", "b"])
    assert extract.require_columns(df, ["b"]) is df
    assert extract.require_columns(df, ["c"], "skip") is None
    assert extract.require_columns(df, ["c"], "fill").columns == ["a ", "b", "c"]
    with pytest.raises(ValueError):
        extract.require_columns(df, ["c"])
    schema = T.StructType([T.StructField("b", T.StringType()), T.StructField("a", T.StringType()), T.StructField("c", T.StringType())])
    assert tuple(extract.align(df, schema, {"c": ""}).first()) == ("x", "1", "")


def test_read_lines(spark, tmp_path):
    (tmp_path / "x.txt").write_text(" one \n\n\t\n two\n")
    assert sorted(tuple(r) for r in readers.read_lines(spark, str(tmp_path)).collect()) == [("x", "one"), ("x", "two")]


ROWS = [("a", 'q "1", x', "l1\nl2"), ("a", "back\\slash", "y"), ("b", "né", "z")]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, "source string, question string, answer string")


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_write_by_source_round_trip(spark, table, tmp_path, fmt):
    path = str(tmp_path / "out")
    writers.write_by_source(table, path, fmt)
    reader = spark.read.schema("question string, answer string, source string")
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"')
    assert sorted((r.source, r.question, r.answer) for r in reader.format(fmt).load(path).collect()) == sorted(ROWS)


def test_unquoted_csv_escapes_separators(spark, table, tmp_path):
    path = str(tmp_path / "out")
    writers.write_by_source(table, path, "csv", style="none")
    text = "".join(p.read_text() for p in (tmp_path / "out" / "source=a").glob("part-*"))
    assert 'q "1"\\, x,l1\\\nl2' in text and "back\\\\slash,y" in text


def test_to_parquet_and_lines(spark, table, tmp_path):
    readers.to_parquet(table, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    writers.write_lines(table.withColumnRenamed("answer", "line"), str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["l1 l2", "y", "z"]


def test_write_slices(spark, tmp_path):
    df = spark.range(20).select(F.lit("s").alias("source"), F.col("id").alias("ord"), F.lit("x" * 10).alias("text"))
    writers.write_slices(df, str(tmp_path / "s"), F.octet_length("text"), 40)
    back = spark.read.json(str(tmp_path / "s"))
    assert [r["count"] for r in back.groupBy("part").count().orderBy("part").collect()] == [4] * 5


def test_slices_are_single_files_within_the_limit(spark, tmp_path):
    """Bytes of quotes, line breaks and letters beyond ASCII count as they stand in the file; rows stand in order."""
    texts = ['a "b"', "é\n\t\\", "\u3000\U0001f600", None, "x" * 300]
    rows = [("s/1" if i % 3 else "s 2", i, texts[i % 5]) for i in range(200)]
    frame = spark.createDataFrame(rows, "source string, ord bigint, text string").repartition(7)
    writers.write_slices(frame, str(tmp_path / "s"), limit=200)
    files = writers.slice_files(spark, str(tmp_path / "s")).collect()
    found = {(r["source"], r["part"]): (r["files"], r["bytes"]) for r in files}
    assert {n for n, _ in found.values()} == {1} and {s for s, _ in found} == {"s/1", "s 2"}
    ends = {}
    for file in sorted((tmp_path / "s").glob("*/*/*.json"), key=lambda f: (f.parent.parent.name, int(f.parent.name.split("=")[1]))):
        lines = file.read_bytes().splitlines()
        assert file.stat().st_size <= 200 or len(lines) == 1
        for line in lines:
            at = json.loads(line)["ord"]
            assert at > ends.get(file.parent.parent, -1)
            ends[file.parent.parent] = at
    assert sum(b for _, b in found.values()) == sum(f.stat().st_size for f in (tmp_path / "s").glob("*/*/*.json"))


def test_reports(spark, tmp_path):
    metrics = spark.createDataFrame([(2, "Rate", 0.5), (1, "Corr", None)], "line_no int, metric string, value double")
    assert [r.line for r in reports.report(metrics).collect()] == ["Corr: nan", "Rate: 0.5000"]
    assert reports.report(metrics, 2, markdown=True).collect()[1].line == "- Rate: 0.50"
    reports.write_report(reports.report(metrics), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 2
    shares = crosstab.with_share(crosstab.value_counts(spark.createDataFrame([("a",), ("a",), ("b",)], "source string"), "source"), "n", "percent", 100.0)
    assert [r.line for r in reports.share_report(shares, "source", "n", "percent").collect()] == [
        f"{'a':<30}{2:<10}66.67%", f"{'b':<30}{1:<10}33.33%"
    ]


def test_pivot_display_and_missing_categories(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", None)], "source string, label string")
    wide = crosstab.pivot_counts(df, "source", "label", ["x", "y", "z"])
    got = {r.source: (r.x, r.y, r.z) for r in crosstab.pivot_display(wide, "source", ["x", "y", "z"]).collect()}
    assert got == {"a": ("2", "0", "0"), "b": ("0", "1", "0"), "Total": ("2 (0.6667)", "1 (0.3333)", "0 (0.0)")}


def test_lookup_join(spark):
    fact = spark.range(100).select("id", F.when(F.col("id") < 70, "hot").otherwise("none").alias("k"))
    dim = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    got = joins.lookup_join(fact, dim, ["k"], F.col("id"))
    assert got.count() == 100 and got.where("v = 1").count() == 70


def test_csv_header_is_enforced(spark, tmp_path):
    (tmp_path / "good.csv").write_text('question, "answer"\nq1,1\n"a, b",2\n')
    (tmp_path / "swapped.csv").write_text("answer,question\n1,q3\n")
    schema = "question string, answer int"
    with pytest.raises(ValueError, match="swapped.csv"):
        readers.read_table(spark, str(tmp_path), schema)
    got = readers.read_table(spark, str(tmp_path), schema, on_header="skip")
    assert sorted((r.source, r.question, r.answer) for r in got.collect()) == [("good", "a, b", 2), ("good", "q1", 1)]
    assert readers.read_table(spark, str(tmp_path), "other string", on_header="skip").count() == 0


def test_csv_headers_of_many_files(spark, tmp_path):
    """Names with separators and quotes, blanks around them, a name too few or too many, an empty file."""
    schema = "`a, b` string, `c \"d\"` int"
    headers = {"plain": '"a, b","c ""d"""', "blank": ' "a, b" , "c ""d""" ', "few": '"a, b"', "many": '"a, b","c ""d""",e', "split": 'a, b,"c ""d"""', "case": '"A, b","c ""d"""'}
    for i in range(40):
        for name, header in headers.items():
            (tmp_path / f"{name}{i}.csv").write_text(f'{header}\n"x, {i}",{i}\n')
    (tmp_path / "empty.csv").write_text("")
    got = readers.read_table(spark, str(tmp_path), schema, on_header="skip").collect()
    assert sorted(tuple(r) for r in got) == sorted((f"{name}{i}", f"x, {i}", i) for name in ("plain", "blank") for i in range(40))
    with pytest.raises(ValueError, match="case0.csv and 159 others"):
        readers.read_table(spark, str(tmp_path), schema)


def test_csv_bad_rows_go_whatever_is_selected(spark, tmp_path):
    (tmp_path / "t.csv").write_text("question,answer\nq1,1\nbad,x\nq2,2\n")
    got = readers.read_table(spark, str(tmp_path), "question string, answer int")
    assert got.count() == 2 and sorted(r.question for r in got.select("question").collect()) == ["q1", "q2"]
    kept = readers.read_table(spark, str(tmp_path), "question string, answer int", on_bad="keep")
    assert kept.count() == 3 and kept.where("answer IS NULL").first().question == "bad"
