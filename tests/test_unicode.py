"""Text primitives against Python's own Unicode rules, on random strings."""

from __future__ import annotations

import json
import random
import re
import string

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.classify import answer_type

POOL = (
    list("abcXYZ_09 \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      　")
    + list("éÈßñÖçİıſKДжΣ中かفא٣५²½Ⅳ") + list(string.punctuation) + ["​", "́", "\U0001f600"]
)


def samples(n=600, seed=11):
    rng = random.Random(seed)
    return ["".join(rng.choices(POOL, k=rng.randint(0, 12))) for _ in range(n)]


def test_primitives_follow_unicode_rules(spark):
    texts = samples()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    s = F.col("s")
    rows = df.orderBy("i").select(
        tx.strip(s), tx.collapse_ws(s), F.regexp_extract_all(s, F.lit(f"{tx.WORD}+"), F.lit(0)), tx.strip_punct(s),
        tx.has_text(s), tx.sanitize(s), F.regexp_count(s, F.lit(tx.bounded(r"\p{Nd}"))),
    ).collect()
    for text, row in zip(texts, rows):
        assert row[0] == text.strip(), repr(text)
        assert row[1] == " ".join(text.split()), repr(text)
        assert row[2] == re.findall(r"\w+", text), repr(text)
        assert row[3] == "".join(c for c in text if c not in string.punctuation), repr(text)
        assert row[4] == (row[5] != ""), repr(text)
        assert row[6] == len(re.findall(r"\b\d\b", text)), repr(text)


def test_lower_cased_tokens(spark):
    texts = [t for t in samples(300, 5) if not set(t) & set("İΣ")]  # special casing differs between runtimes
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(tx.tokens(F.col("s"))).collect()]
    assert got == [re.findall(r"\w+", t.lower()) for t in texts]


def test_digits_decide_numbers(spark):
    texts = [t for t in samples(300, 7) if not re.search(r"[^\W\d_]", t) and not re.search(r"\b\d{4}\b|/", t)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(answer_type(F.col("s"))).collect()]
    assert got == ["Number" if re.search(r"\d", t) else "Unknown" for t in texts]


def test_json_size_on_random_text(spark):
    texts = samples(200, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(tx.json_size(F.struct("i", "s"), 2)).collect()]
    assert got == [len(json.dumps({"i": i, "s": t}, ensure_ascii=False).encode()) for i, t in enumerate(texts)]
