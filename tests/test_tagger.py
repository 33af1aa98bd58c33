"""Dictionary tagger and fitted topic weights against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import tagger, topics


def plain_entities(text, titles):
    out, at = [], 0
    while at < len(text or ""):
        best = 0
        for t in titles:
            end = at + len(t)
            if t and text.startswith(t, at) and len(t) > best:
                before = at and re.match(r"\w", text[at - 1]) and re.match(r"\w", t)
                after = end < len(text) and re.match(r"\w", text[end]) and re.match(r"\w", t[-1])
                best = best if before or after else len(t)
        if best:
            out.append(text[at : at + best])
        at += best or 1
    return out


@pytest.mark.parametrize("most_bytes", [1 << 24, 40])
def test_dictionary_entities(spark, most_bytes):
    """Nested and overlapping titles, ends that are no word characters, letters beyond the basic plane; one shard and many."""
    draw = random.Random(4)
    words = ["New", "York", "York City", "City", "Été", "été", "C++", "C", "(a)", "\U00010400x", "ab", "abc", "b c", "日本", "日本語"]
    titles = words + ["New York", "New York City", "York City Hall", "", "a b", "b a b"]
    texts = ["".join(draw.choice([*words, "a", "b", " ", " ", " ", "-", "_"]) for _ in range(draw.randint(0, 30))) for _ in range(200)] + [None, "", "New York City Hall"]
    frame = spark.createDataFrame(list(enumerate(texts)), "title int, text string")
    known = spark.createDataFrame([(t,) for t in [*titles, None, "New"]], "title string")
    got = {r["title"]: r["entities"] for r in tagger.dictionary_entities(frame, "text", known, most_bytes=most_bytes).collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain_entities(text, titles), text
    assert tagger.dictionary_entities(frame, "text", known.limit(0)).where("size(entities) > 0").count() == 0


def test_titles_of_one_shard_are_found_in_one_pass(spark):
    """One Python worker a task, and many of its pieces to an Arrow batch; rows stay in place."""
    frame = spark.range(0, 1500, 1, 2).select("id", F.concat_ws(" ", F.lit("ab"), F.col("id"), F.lit("x")).alias("text"))
    known = spark.createDataFrame([("ab 7",), ("ab",), ("x",)], "title string")
    found = tagger.dictionary_entities(frame, "text", known)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r["id"]: r["entities"] for r in found.collect()} == {i: ["ab 7" if i == 7 else "ab", "x"] for i in range(1500)}


def test_terms_are_counted_inside_the_row(spark):
    texts = ["", None, "a", "b a b", "!?", "Été été x_1 X_1 " * 50, "日本 a 日本"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r["k"]: r["c"] for r in frame.select("k", tx.term_counts(F.col("text")).alias("c")).collect()}
    for k, text in enumerate(texts):
        assert (got[k] and {r["term"]: r["n"] for r in got[k]} or {}) == Counter(re.findall(r"\w+", (text or "").lower()))


def test_fitted_topics_shuffle_document_terms_once(spark):
    """No shuffle for an aggregate over (document, term) before the join on the term."""
    from corpusloom.plans.catalog import QUERIES

    plan = QUERIES["fitted_topics"](spark, "/root/testdata/sf0.001")
    plan.collect()
    done = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(doc_id#\d+L, term#\d+", done)


def test_fitted_topic_weights(spark):
    rows = [(1, "a a b", "x"), (2, "b c", "y"), (3, "c c d", "y"), (4, "a d", None), (5, "q", "other"), (6, None, "x"), (7, "zzz", "x"), (8, "", "y")]
    frame = spark.createDataFrame(rows, "k int, text string, label string")
    labels = ["x", "y"]
    weights = topics.fit_topic_weights(frame, "text", "label", labels)
    counts = defaultdict(Counter)
    for _, text, label in rows:
        if label in labels:
            counts[label].update((text or "").split())
    terms, sizes = set(counts["x"]) | set(counts["y"]), {c: sum(counts[c].values()) for c in labels}
    want = {t: [math.log((counts[c][t] + 1) / (sizes[c] + len(terms))) - math.log((counts[o][t] + 1) / (sizes[o] + len(terms))) for c, o in (("x", "y"), ("y", "x"))] for t in terms}
    got = {r["term"]: r["weights"] for r in weights.collect()}
    assert set(got) == terms and all(got[t] == pytest.approx(want[t]) for t in terms)
    scores = {r["k"]: [s["score"] for s in r["scores"]] for r in topics.fitted_scores(frame, "k", "text", weights, labels).collect()}
    for k, text, _ in rows:
        found = [want[t] for t in (text or "").split() if t in want]
        means = [sum(w[i] for w in found) / len(found) if found else 0 for i in (0, 1)]
        assert scores[k] == pytest.approx([1 / (1 + math.exp(-m)) for m in means])


def test_fitted_weights_tell_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang IS NOT NULL")
    labels = ["de", "en", "es", "fr"]
    held = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    weights = topics.fit_topic_weights(docs.where(~held), "text", "lang", labels)
    scored = topics.fitted_scores(docs.where(held), "doc_id", "text", weights, labels).join(docs.select("doc_id", "lang"), "doc_id")
    best = scored.withColumn("best", topics.top_labels(F.col("scores"), 1)[0]["label"])
    right, n = best.agg(F.count_if(F.col("best") == F.col("lang")), F.count(F.lit(1))).first()
    assert n > 20 and right / n > 0.9
