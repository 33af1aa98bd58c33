"""The corpus pipeline: five stages, each over all that the one before has kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, language, quality, queries, simhash
from corpusloom.llm.common import read, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; null texts are judged as empty ones."""
    return quality.accepted(docs, queries.quality_model(docs, read(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language the models reject; texts without letters are rejected."""
    return language.accepted(docs, queries.language_model(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (three-word shingles, fingerprints linked at two bits or fewer) the document with
    the smallest id, of repeated rows one."""
    return simhash.representatives(docs)


#: Most digests of 16 bytes that are sent to every task.
SENT = 1 << 19


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark window. What a document holds depends on its text alone, so texts are
    known by their digest, and rows without id are judged like any other. The columns go by number meanwhile, so their
    names may hold anything. The digests to drop are counted: up to ``SENT`` go to the documents, beyond that both are shuffled."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = F.col(f"c{docs.columns.index('text')}")
    digest = F.unhex(F.md5(F.coalesce(text, F.lit(""))))
    found = decontaminate.contamination(plain.select(digest.alias("digest"), text.alias("text")), read(spark, sf_dir, "benchmark"), key="digest")
    bad = written(found.where("n_hit > 0").select("digest").distinct())
    if bad.count() <= SENT:
        bad = F.broadcast(bad)
    return plain.join(bad, digest == bad["digest"], "left_anti").toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences."""
    return queries.pack_all(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Models and token ids have no SQL form; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
