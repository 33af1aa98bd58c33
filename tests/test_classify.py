"""Question and answer rules, one authored row per branch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import classify as cl
from corpusloom.operators.crosstab import typed_questions


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("question, phrase", [
    ("What year was it?", "what year was"),
    ("In what year was it?", "in what year was"),
    ("By who was it?", "by who was it"),
    ("Tell me now who won the cup", "who won the"),
    ("a b c who came when it was", "when it was"),
    ("What", "what"),
    ("Name the winner", "other"),
    ("", "other"),
    ("Écoute what né_1 dit", "what né_1 dit"),
    ("whatever is on top", "is on top"),
])
def test_question_phrase(spark, question, phrase):
    assert one(spark, cl.question_phrase(F.col("q")), q=question) == phrase


@pytest.mark.parametrize("answer, kind", [
    ("3 May 1999", "Date"), ("1999", "Date"), ("1/2/99", "Date"), ("may 3", "Date"), ("x 12 June", "Date"),
    ("19995", "Number"), ("é1999", "Number"), ("1999é", "Number"),
    ("john smith", "Person"), ("Jo  Smith", "Unknown"), ("éa bc", "Unknown"), ("a bc", "Unknown"),
    ("River", "Location"), ("rivers", "Unknown"), ("team", "Group"), ("battle", "Event"), ("opera", "Artwork"),
    ("only", "Adjective"), ("dog", "Common noun"), ("city", "Location"), ("-3.5 km", "Number"), ("km", "Unknown"),
    ("", "Unknown"), (None, "Unknown"),
])
def test_answer_type(spark, answer, kind):
    assert one(spark, cl.answer_type(F.col("a")), a=answer) == kind


@pytest.mark.parametrize("question, kind", [
    ("who directed the film that the writer of the long novel wrote", "Composition"),
    ("who directed the film that x wrote", "Simple"),
    ("who was it who has won the cup and the race in one year ok", "Composition"),
    ("which of the many listed railway stations is the one with platforms", "Composition"),
    ("who came with x and y in a or b", "Simple"),
    ("whole thing: who came with x", "Composition"),
    ("is x both tall and wide", "Intersection"),
    ("is x both tall\nand wide", "Simple"),
    ("goals in 1951 and points for the year", "Intersection"),
    ("name it in x and y", "Simple"),
    ("name it in x and in y", "Intersection"),
    ("what type of thing was discovered by x", "Intersection"),
    ("the league season 1951 or 1957", "Intersection"),
    ("the league season 1951", "Simple"),
    ("the league and season", "Intersection"),
    ("who came with the club and the match", "Intersection"),
    ("", "Simple"),
])
def test_question_type(spark, question, kind):
    assert one(spark, cl.question_type(F.col("q")), q=question) == kind


@pytest.mark.parametrize("question, answer, want", [
    ("the total of the highest before 1999 and different", "x", ["Aggregation", "Superlative", "Comparative"]),
    ("How many", "x", ["Counting"]), ("the number of x", "x", ["Counting"]),
    ("x", "5", ["Counting"]), ("x", "1999", ["Filtering time"]), ("x", "y", ["No skill"]),
    ("where the thing is big", "x", ["Filtering entity"]), ("where the\nthing is big", "x", ["No skill"]),
    ("casino night", "x", ["Negation"]),
    ("x first", "y", ["No skill"]), ("x first y", "z", ["Ordinal"]),
    ("every a > b, mean of it, how long lived", "x", ["All", "Filtering numeric", "Average"]),
])
def test_skills(spark, question, answer, want):
    assert one(spark, cl.skills(F.col("q"), F.col("a")), q=question, a=answer) == want


def test_skill_text_round_trip(spark):
    df = spark.createDataFrame([("All;Average",), ("  ",), (None,)], "s string")
    assert [r[0] for r in df.select(cl.skills_from_text(F.col("s"))).collect()] == [
        ["All", "Average"], ["No skill"], ["No skill"]
    ]


def test_typed_questions_runs_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("who won?", "team")], "question string, answer string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = typed_questions(stream).writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "state")
    ).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).first()
    assert (got.question_type, got.skills, got.answer_type) == ("Simple", ["No skill"], "Group")
