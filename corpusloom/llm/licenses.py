"""License scans by diagonal voting.

The rolling word grams of all texts are joined to their positions in license templates. A hit votes for its diagonal, the
place in the text less the place in the template; votes are added up by diagonal, diagonals that lie next to each other
(a few words inserted or left out) are merged, and a merged span counts as found if it covers enough of the template's grams. Grams are
compared word by word, so a base phrase is found exactly where all grams of its diagonal are.

Texts are read once; a task only hands on grams that some template has (the templates are a fixed list). A hit is three
numbers and a short gram, so a text that is all license lines costs rows in proportion to its length.

Nulls: a null text has no words. Repeated rows are scanned once each; very short texts have no grams. Empty tables give
empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import slices, words, written

GRAM = 3
#: Words that may be inserted or left out inside a span, and the share of a template's grams that a span must cover;
#: templates of fewer than ``WHOLE`` grams, where one word tells licenses apart, must be covered whole.
DRIFT, COVER, WHOLE = 3, 0.7, 12

#: Phrases that are found as they stand, and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: Notices that are found in similar wording, and their labels.
NOTICES = [
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software",
        "mit",
    ),
    ("released under the MIT license", "mit"),
    (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "apache-2",
    ),
    ("licensed under the Apache License, Version 2.0", "apache-2"),
    ("licensed under the GNU General Public License, version 3", "gpl-3"),
    (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version",
        "gpl-3",
    ),
    ("licensed under the GNU General Public License, version 2", "gpl-2"),
    ("licensed under the GNU Lesser General Public License", "lgpl"),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "bsd",
    ),
    ("subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
    ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("licensed under CC BY 4.0", "cc-by"),
    ("licensed under CC BY-SA 4.0", "cc-by-sa"),
]


def templates(phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> list[tuple[int, str, bool, int, int, str]]:
    """``template``, ``label``, ``base``, ``grams`` (how many), ``place`` and ``gram`` of every gram of every template."""
    out = []
    for n, (text, label, base) in enumerate([(*p, True) for p in phrases] + [(*p, False) for p in notices]):
        found = words(text)
        if len(found) < GRAM:
            raise ValueError(f"a template has {GRAM} words at least: {text}")
        grams = [b" ".join(found[i : i + GRAM]).decode() for i in range(len(found) - GRAM + 1)]
        out += [(n, label, base, len(grams), place, gram) for place, gram in enumerate(grams)]
    return out


def scan(documents: DataFrame, known: set[bytes], key: str, text: str) -> DataFrame:
    """A row per document (``gram`` null, ``at`` its number of words) and per gram that a template has."""
    narrow = documents.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(narrow.schema["key"].dataType)
    parts = [{gram.split()[i] for gram in known} for i in range(GRAM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                numbers = part.column("row").to_pylist()
                sizes, rows, places, grams = [], [], [], []
                for number, t in zip(numbers, part.column("text").to_pylist(), strict=True):
                    found = words(t)
                    sizes.append(len(found))
                    if not all(map(set(found).intersection, parts)):
                        continue
                    for i, some in enumerate(zip(*(found[j:] for j in range(GRAM)), strict=False)):
                        if some[1] in parts[1] and (gram := b" ".join(some)) in known:
                            rows.append(number)
                            places.append(i)
                            grams.append(gram.decode())
                names = ["row", "key", "at", "gram"]
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), part.column("key"), pa.array(sizes, pa.int64()), pa.nulls(len(numbers), pa.string())], names)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.nulls(len(rows), kind), pa.array(places, pa.int64()), pa.array(grams, pa.string())], names)

    return narrow.mapInArrow(run, f"row bigint, key {narrow.schema['key'].dataType.simpleString()}, at bigint, gram string")


def spans(hits: DataFrame, table: DataFrame) -> DataFrame:
    """Merged diagonals: ``row``, ``template``, ``label``, ``base``, ``start``, ``stop`` (words), ``cover`` (share of its grams)."""
    voted = hits.join(F.broadcast(table), "gram").withColumn("diagonal", F.col("at") - F.col("place"))
    votes = voted.groupBy("row", "template", "label", "base", "grams", "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("at").alias("start"), (F.max("at") + GRAM).alias("stop"))
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    # a base phrase stands on one diagonal; other neighbours merge where their spans follow each other
    gap = F.col("diagonal") - F.lag("diagonal").over(near)
    apart = F.col("start") - F.lag("stop").over(near)
    fresh = F.col("base") | gap.isNull() | (gap > DRIFT) | (apart > DRIFT)
    numbered = votes.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(near))
    merged = numbered.groupBy("row", "template", "label", "base", "grams", "span").agg(
        F.sum("votes").alias("votes"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.select("row", "template", "label", "base", "start", "stop", "grams", F.least(F.lit(1.0), F.col("votes") / F.col("grams")).alias("cover"))


def license_scan(documents: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (``row``, key, ``n_words``) and the verified spans in them (see :func:`spans`)."""
    spark: SparkSession = documents.sparkSession
    rows = templates()
    table = spark.createDataFrame(rows, "template int, label string, base boolean, grams int, place int, gram string")
    found = written(scan(documents, {r[5].encode() for r in rows}, key, text))
    seen = spans(found.where("gram IS NOT NULL").select("row", "at", "gram"), table)
    return (found.where("gram IS NULL").select("row", F.col("key").alias(key), F.col("at").alias("n_words")),
            seen.where(F.col("cover") >= F.when(F.col("base") | (F.col("grams") < WHOLE), 1.0).otherwise(COVER)).drop("grams"))


def license_labels(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, places and labels of the base phrases, labels of all spans, and the best cover."""
    rows, found = license_scan(documents, key, text)
    base = F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  of a few labels at most
    summed = found.groupBy("row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("cover").alias("score"))
    return rows.join(summed, "row", "left").select(
        key, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
