"""Text relatedness and summaries over similarity scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as tx
from ..functions.vectors import cosine
from ..sources.shared import kept
from .ordering import exact_quantiles, running_index

ALL_FILES = "ALL_FILES"
LOWEST = 100
WHISKER = 1.5
# Texts of a mini-batch, and their characters once all are as long as the longest.
BATCH_TEXTS, BATCH_CHARS = 64, 65_536


def token_relatedness(df: DataFrame, key: Sequence[str], left: Column, right: Column, name: str = "similarity_score") -> DataFrame:
    """Cosine similarity of the term counts of two texts per key, over whole texts.

    Counts are built relationally: both sides are exploded together and merged per (key, term) with map-side
    combining, so rows that share a key (segments of a large group) simply add up.
    """
    def terms(c: Column, side: int) -> Column:
        words = F.coalesce(tx.tokens(c), F.array().cast("array<string>"))
        return F.transform(words, lambda w: F.struct(w.alias("_term"), F.lit(side).alias("_side")))

    exploded = df.select(*key, F.inline_outer(F.concat(terms(left, 0), terms(right, 1))))
    counts = exploded.groupBy(*key, "_term").agg(
        F.count_if(F.col("_side") == 0).cast("double").alias("_l"),
        F.count_if(F.col("_side") == 1).cast("double").alias("_r"),
    )
    l, r = F.col("_l"), F.col("_r")
    score = F.try_divide(F.sum(l * r), F.sqrt(F.sum(l * l)) * F.sqrt(F.sum(r * r)))
    return counts.groupBy(*key).agg(F.coalesce(score, F.lit(0.0)).alias(name))


def _squared_counts(ordered: Column) -> Column:
    """Sum of the squared frequencies of the words of a sorted array (a bound one)."""
    return tx.bound(tx.run_begins(ordered), lambda at: F.aggregate(
        tx.run_lengths(ordered, at), F.lit(0).cast("bigint"), lambda total, n: total + n * n)).cast("double")


def text_relatedness(left: Column, right: Column) -> Column:
    """Cosine similarity of the term counts of two whole texts in a row; 0 where one has no term.

    Terms are sorted inside the row, so a task holds one row's terms. The inner product comes from the squared counts of both
    texts together, less those of each. Where a key's texts are spread over rows, use :func:`token_relatedness`.
    """
    def words(c: Column) -> Column:
        return F.sort_array(F.coalesce(tx.tokens(c), F.array().cast("array<string>")))

    def score(pair: Column) -> Column:
        both = tx.bound(F.sort_array(F.concat(pair["l"], pair["r"])), _squared_counts)
        sums = F.struct(_squared_counts(pair["l"]).alias("l"), _squared_counts(pair["r"]).alias("r"), both.alias("both"))
        return tx.bound(sums, lambda s: F.try_divide((s["both"] - s["l"] - s["r"]) / 2, F.sqrt(s["l"]) * F.sqrt(s["r"])))

    return F.coalesce(tx.bound(F.struct(words(left).alias("l"), words(right).alias("r")), score), F.lit(0.0))


def group_relatedness(groups: DataFrame, name: str = "similarity_score") -> DataFrame:
    """Score of each grouped table (``source, table, segment, num_pairs, qas``) against the text of its pairs.

    Returns the groups' rows with the score of their table.  The tokens travel with a digest of the table, the texts are
    joined to the scores at the end.
    """
    keyed = groups.withColumn("_key", F.sha2(F.col("table"), 256))
    table_once = F.when(F.col("segment") == 0, tx.strip_punct(F.col("table"))).otherwise("")
    scores = token_relatedness(keyed, ["source", "_key"], table_once, F.col("qas"), name)
    return keyed.join(scores, ["source", "_key"]).drop("_key")


def embed_texts(
    texts: DataFrame,
    text: str,
    embedder: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]],
    batch_texts: int = BATCH_TEXTS,
    batch_chars: int = BATCH_CHARS,
) -> DataFrame:
    """The columns of ``texts`` and ``vector``; ``embedder`` is a factory called once per task.

    A task orders its texts by length and hands them on in mini-batches: at most ``batch_texts`` texts, and as many as stay
    within ``batch_chars`` once all are filled up to the longest of them (one text at least).  Their size does not depend on
    the Arrow batches, which only carry the texts.
    """
    kind = T.StructType([*texts.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = embedder()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for begin, end in mini_batches([len(x or "") for x in column.to_pylist()], batch_texts, batch_chars):
                part = batch.slice(begin, end - begin)
                vectors = encode([x or "" for x in column.slice(begin, end - begin).to_pylist()])
                flat = pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, flat], [*part.schema.names, "vector"])

    return texts.sortWithinPartitions(F.length(text)).mapInArrow(run, kind)


def mini_batches(lengths: Sequence[int], batch_texts: int, batch_chars: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most ``batch_texts`` texts whose longest, times their number, is within ``batch_chars``."""
    begin, longest = 0, 0
    for i, length in enumerate(lengths):
        if i > begin and (i - begin >= batch_texts or max(longest, length) * (i - begin + 1) > batch_chars):
            yield begin, i
            begin, longest = i, 0
        longest = max(longest, length)
    if begin < len(lengths):
        yield begin, len(lengths)


def embedding_relatedness(
    df: DataFrame,
    left: Column,
    right: Column,
    embedder: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]],
    name: str = "similarity_score",
    batch_texts: int = BATCH_TEXTS,
    batch_chars: int = BATCH_CHARS,
) -> DataFrame:
    """Cosine similarity of dense embeddings of two texts per row; null texts count as empty.

    Each distinct text is embedded once, however many rows and sides hold it: texts are known by their digest, distinct
    pairs of digests take their vectors from one join, and rows take the score of their pair.  The similarity is native.
    """
    def digest(c: Column) -> Column:
        return F.sha2(F.coalesce(c, F.lit("")), 256)

    keyed = df.withColumns({"_left": digest(left), "_right": digest(right)})
    sides = df.select(F.inline(F.array(*[F.struct(digest(c).alias("_digest"), F.coalesce(c, F.lit("")).alias("_text")) for c in (left, right)])))
    once = sides.groupBy("_digest").agg(F.first("_text").alias("_text"))
    vectors = embed_texts(once, "_text", embedder, batch_texts, batch_chars).select("_digest", "vector")
    pairs = keyed.select("_left", "_right").distinct()
    wanted = pairs.select("_left", "_right", F.inline(F.array(
        F.struct(F.lit(0).alias("_side"), F.col("_left").alias("_digest")), F.struct(F.lit(1).alias("_side"), F.col("_right").alias("_digest")))))
    found = wanted.join(vectors, "_digest").groupBy("_left", "_right").agg(
        *[F.first(F.when(F.col("_side") == i, F.col("vector")), ignorenulls=True).alias(f"_{i}") for i in (0, 1)])
    scores = found.select("_left", "_right", cosine(F.col("_0"), F.col("_1")).alias(name))
    return keyed.join(scores, ["_left", "_right"]).select(*[f"`{c}`" for c in df.columns], name)


def question_table_texts(df: DataFrame, compat: bool = False) -> DataFrame:
    """Texts compared per question: version 1 cleaned segment and question, with and without punctuation."""
    from .extract import unwrap_question

    rows = df.select(
        "source", "ord",
        tx.clean_segment(F.col("input_seg"), 1, compat).alias("table"),
        tx.collapse_ws(F.translate(unwrap_question(F.col("question")), '"?', "")).alias("question"),
        F.col("input_seg"),
    ).where((F.col("input_seg") != "") & (F.col("question") != ""))
    return rows.select(
        "source", "ord", "question", "table",
        tx.strip_punct(F.col("question")).alias("question_text"),
        tx.strip_punct(F.col("table")).alias("table_text"),
    )


def _with_pooled(df: DataFrame, by: str, x: str, pooled: bool) -> DataFrame:
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
    if not pooled:
        return rows.select(by, x)
    return rows.select(F.explode(F.array(F.col(by), F.lit(ALL_FILES))).alias(by), x)


def score_summary(df: DataFrame, by: str = "source", x: str = "similarity_score", pooled: bool = True) -> DataFrame:
    """Mean, median, sample standard deviation, min, max and count per dataset, plus a pooled row.

    Names and scores are written once: moments, cut points and blocks each read them.
    """
    rows = _with_pooled(kept(df.select(by, x), "scores"), by, x, pooled)
    moments = rows.groupBy(by).agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.count(F.lit(1)).alias("count"),
    )
    medians = exact_quantiles(rows, [by], x, {"median": 0.5})
    return moments.join(medians, by).select(by, "mean", "median", "std", "min", "max", "count")


def box_stats(df: DataFrame, by: str = "source", x: str = "similarity_score") -> DataFrame:
    """Quartiles and 1.5 IQR whiskers per dataset; values beyond the whiskers are outliers.

    The quartiles are one row per dataset, so the scan for the whiskers joins a side that adaptive execution broadcasts.
    Names and scores are written once: cut points, blocks and whiskers each read them.
    """
    rows = _with_pooled(kept(df.select(by, x), "scores"), by, x, pooled=False)
    quartiles = exact_quantiles(rows, [by], x, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    fences = quartiles.withColumns({"_low": F.col("q1") - reach, "_high": F.col("q3") + reach})
    value = F.col(x)
    inside = F.when((value >= F.col("_low")) & (value <= F.col("_high")), value)
    return rows.join(fences, by).groupBy(by).agg(
        F.any_value("q1").alias("q1"), F.any_value("median").alias("median"), F.any_value("q3").alias("q3"),
        F.least(F.min(inside), F.any_value("q1")).alias("whisker_low"),
        F.greatest(F.max(inside), F.any_value("q3")).alias("whisker_high"),
        F.count_if((value < F.col("_low")) | (value > F.col("_high"))).alias("outliers"),
    )


def similarity_series(df: DataFrame, by: str = "source", order: str = "ord", x: str = "similarity_score") -> DataFrame:
    """Per-dataset series: 0-based running index and score, missing scores left out."""
    return running_index(df.where(F.col(x).isNotNull()), [by], order).select(by, "idx", x)


def lowest_k(df: DataFrame, k: int = LOWEST, x: str = "similarity_score", ties: Sequence[str] = ("source", "ord")) -> DataFrame:
    """The ``k`` rows with the lowest score over all datasets (top-k, no full sort)."""
    return df.orderBy(x, *ties).limit(k)


def sort_within(df: DataFrame, by: str = "source", x: str = "similarity_score") -> DataFrame:
    """Order for a per-dataset sink: dataset, then score descending.

    Range partitioning lets a large dataset span several tasks and files while staying in order.
    """
    return df.repartitionByRange(F.col(by), F.desc(x)).sortWithinPartitions(F.col(by), F.desc(x))
